"""Packing (6): sum-of-squares online packing of documents into windows of a fixed capacity.

1. Every task packs the documents it reads, in order, without a shuffle.  A level
   array counts the open windows of each fill level; a document goes to the level
   where the sum of the squared counts becomes least, or into a new window.  What is
   longer than a window is first cut into full windows, the rest is placed as said.
2. Windows still open at a task's end, or when they hold ``HELD_IDS``, are emptied: their
   pieces go to a next, smaller pass by the same rule, in parts of some ``PASS_IDS``, until
   one part is left (or passes stop getting smaller by half: then each part ends the work).
3. There the emptiest of the open windows are dissolved and their pieces cut to fill up the
   others; what then remains goes into windows whose lengths are powers of two, which need
   no padding.  Only the pieces of dissolved windows aren't where the rule put them.

Nulls count as empty texts, which have the end id alone; equal rows are packed
each; of equal levels the fullest is taken, of equally full windows the latest; an empty
table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written
from .tokens import encoder, slices

CAPACITY = 1024
#: Ids, and 32 for each piece, that the open windows of a task hold before they go to the next pass.
HELD_IDS = 1 << 21
#: Ids of a part of a later pass.
PASS_IDS = 1 << 22
#: Sequence ids of one task and of one pass; the numbers of both stand above.
TASK_IDS, PASS_STEP = 1 << 36, 1 << 58
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces without a sequence go to the next pass with their ids.
PASS = f"{PIECES}, ids binary"
#: doc_id, start, ids, doc_tokens
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """Windows by fill level; ``closed`` gets (sequence, pieces) of the windows that are done."""

    def __init__(self, capacity: int, first: int = 0):
        self.capacity, self.next = capacity, first
        self.count = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.held = 0
        self.closed: list[tuple[int, list[Piece]]] = []

    def level(self, size: int) -> int:
        """The fill level, or 0 for a new window, at which a document of this size leaves the least sum of squares."""
        c, n = self.capacity, self.count
        change = np.full(c - size + 1, np.iinfo(np.int64).max)
        change[0] = 2 * n[size] + 1
        have = np.flatnonzero(n[1 : c - size + 1]) + 1
        to = have + size
        change[have] = np.where(to == c, 1 - 2 * n[have], 2 * (n[to] - n[have]) + 2)
        return c - size - int(np.argmin(change[::-1]))  # of equal ones the fullest

    def place(self, piece: Piece) -> None:
        size = len(piece[2])
        if size == self.capacity:
            self.close([piece])
            return
        self.held += size + 32
        at = self.level(size)
        if at:
            window = self.windows[at].pop()
            self.count[at] -= 1
        else:
            window = []
        window.append(piece)
        if at + size == self.capacity:
            self.held -= self.capacity + 32 * len(window)
            self.close(window)
        else:
            self.windows[at + size].append(window)
            self.count[at + size] += 1

    def close(self, window: list[Piece]) -> None:
        self.closed.append((self.next, window))
        self.next += 1

    def emptied(self) -> list[list[Piece]]:
        """The open windows, the fullest first; none is open after."""
        out = [w for level in reversed(self.windows) for w in level]
        self.windows, self.held = [[] for _ in range(self.capacity + 1)], 0
        self.count[:] = 0
        return out

    def finish(self) -> None:
        """Closes all: the emptiest windows are dissolved and fill up the fullest; the rest fills powers of two."""
        windows = self.emptied()
        left = sum(len(p[2]) for w in windows for p in w)
        full = left // self.capacity
        loose = [p for w in windows[full:] for p in w][::-1]

        def fill(window: list[Piece], room: int) -> None:
            while room:
                doc, start, ids, whole = loose.pop()
                if len(ids) > room:
                    loose.append((doc, start + room, ids[room:], whole))
                    ids = ids[:room]
                window.append((doc, start, ids, whole))
                room -= len(ids)
            self.close(window)

        for window in windows[:full]:
            fill(window, self.capacity - sum(len(p[2]) for p in window))
        left -= full * self.capacity
        while left:
            room = 1 << (left.bit_length() - 1)
            fill([], room)
            left -= room


def _batch(closed: list[tuple[int, list[Piece]]], moved: list[list[Piece]] = ()) -> pa.RecordBatch:
    rows = []
    for sequence, window in closed:
        offset = 0
        for doc, start, ids, whole in window:
            rows.append((doc, start, len(ids), zlib.crc32(ids), whole, sequence, offset, None))
            offset += len(ids)
    rows += [(doc, start, len(ids), None, whole, None, None, ids.tobytes()) for window in moved for doc, start, ids, whole in window]
    names = [x.split()[0] for x in PASS.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def _packed(pieces: Iterable[Iterable[Piece]], capacity: int, number: int, last: bool, held: int) -> Iterator[pa.RecordBatch]:
    """Places the pieces of one task; a batch after each group of them."""
    from pyspark import TaskContext

    packer = SumOfSquares(capacity, number * PASS_STEP + TaskContext.get().partitionId() * TASK_IDS)
    for group in pieces:
        for piece in group:
            packer.place(piece)
            if packer.held > held and not last:
                yield _batch(packer.closed, packer.emptied())
                packer.closed = []
        yield _batch(packer.closed)
        packer.closed = []
    if last:
        packer.finish()
    yield _batch(packer.closed, packer.emptied())


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, held: int = HELD_IDS, pass_ids: int = PASS_IDS) -> DataFrame:
    """Pieces of ``doc_id, text``: where each document's ids lie in which sequence.

    Each pass is written, so a lost executor never moves a piece that another pass has seen.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[Iterator[Piece]]:
        code = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, length = code.encode(part.column("text"))
                ids = np.insert(ids, np.cumsum(length), end_id).astype("<u4")
                yield cut(part.column("doc_id").to_pylist(), ids, length + 1)

    def cut(docs: list[int | None], ids: np.ndarray, length: np.ndarray) -> Iterator[Piece]:
        for doc, b, n in zip(docs, np.cumsum(length).tolist(), length.tolist(), strict=True):
            a = b - n
            for at in range(0, n, capacity):
                # a copy, so that an open window doesn't hold the whole slice
                own = ids[a + at : min(b, a + at + capacity)]
                yield doc, at, own if len(own) == capacity else own.copy(), n

    def moved(batches: Iterable[pa.RecordBatch]) -> Iterator[Iterator[Piece]]:
        for b in batches:
            yield ((d, s, np.frombuffer(i, "<u4"), n) for d, s, i, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True))

    number, before, texts = 0, None, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = written(texts.mapInArrow(lean(lambda batches: _packed(pieces(batches), capacity, 0, False, held)), PASS), "packed")
    out = packed.where("sequence_id is not null").drop("ids")
    while left := packed.where("sequence_id is null").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]:
        parts, number = -(-left // pass_ids), number + 1
        last = parts == 1 or before is not None and 2 * left > before

        def run(batches: Iterable[pa.RecordBatch], number=number, last=last) -> Iterator[pa.RecordBatch]:
            return _packed(moved(batches), capacity, number, last, held)

        packed = written(packed.where("sequence_id is null").select("doc_id", "start", "ids", "doc_tokens").repartition(parts).mapInArrow(lean(run), PASS), "packed")
        out, before = out.unionByName(packed.where("sequence_id is not null").drop("ids")), left
    return out
