"""Many keys to one group of a stateful operator: state rows are packed, so that a call to the state's server moves thousands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Groups that keys are dealt to by their hash; a change reads the state of its own group.
GROUPS = 1024
#: Rows of one packed value, and of a frame that is handed on.
SENT = 10_000
#: Rows of a group that are held at once; more are taken in turns.
HELD = 200_000
#: Values with changes that are kept beside the netted ones, until all are netted.
VALUES = 32


def packed_rows(sent: int = SENT, held: int = HELD, values: int = VALUES) -> type:
    """A class for weighted rows in a list state.  It is made here so that it travels whole, as the processors do."""

    class PackedRows:
        """Rows of text columns and a weight ``w``.  Changes are appended; when they outnumber the netted rows, all are
        netted, so a change is written a few times at most."""

        def __init__(self, handle, name: str, columns: list[str]):
            self.columns = columns
            self.rows = handle.getListState(name, "packed binary")
            self.size = handle.getValueState(f"{name}_size", "netted long, later long, n int")

        def read(self) -> Iterator[pd.DataFrame]:
            if self.size.exists():
                for (value,) in self.rows.get():
                    yield pa.ipc.open_stream(bytes(value)).read_pandas()

        def pack(self, df: pd.DataFrame) -> list[tuple[bytes]]:
            out = []
            for at in range(0, len(df), sent):
                part = pa.Table.from_pandas(df.iloc[at : at + sent], preserve_index=False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part)
                out.append((sink.getvalue().to_pybytes(),))
            return out

        def net(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
            df = pd.concat(parts) if len(parts) > 1 else parts[0]
            df = df.groupby(self.columns, sort=False, as_index=False)["w"].sum()
            return df[df["w"] != 0]

        def append(self, change: pd.DataFrame) -> None:
            if not len(change):
                return
            netted, later, n = self.size.get() if self.size.exists() else (0, 0, 0)
            own = self.pack(change[[*self.columns, "w"]])
            self.rows.appendList(own)
            later, n = later + len(change), n + len(own)
            if not netted:
                # the first rows are netted already, as changes come
                netted, later, n = later, 0, 0
            elif later > netted or n > max(values, netted // sent):
                netted, later, n = self.renetted(netted + later), 0, 0
            if netted:
                self.size.update((netted, later, n))
            else:
                self.size.clear()

        def renetted(self, total: int) -> int:
            """Nets all rows, a share of them at a time if they are many; the number that is left."""
            out, left, turns = [], 0, total // held + 1
            for turn in range(turns):
                parts = [p if turns == 1 else p[pd.util.hash_array(p[self.columns[-1]].to_numpy(object)) % np.uint64(turns) == turn] for p in self.read()]
                rest = self.net(parts)
                left += len(rest)
                out += self.pack(rest)
            if out:
                self.rows.put(out)
            else:
                self.rows.clear()
            return left

    return PackedRows
