"""Token-ID / binary output (2): bit-plane-shuffled, zstandard-compressed token files with a chunk index.

Documents are range-partitioned by doc_id and encoded in that order; each task
cuts its ids into files of bounded size.  In a file the ids stand in blocks of a
fixed size; a block is transposed into bit planes or byte planes, each plane is
one zstandard frame, and an index of all chunks (block, plane, place, size, CRC)
stands before them, so that one block or one plane can be read alone.

Files travel as binary values of a Parquet table (part, seq, n_ids, n_docs, file),
written by Spark's own committer: a lost executor or a second attempt leaves no
half file, and any store that Spark can write will do.  ``export_files`` puts them
into single files of a folder.

Nulls count as empty texts; rows without doc_id come first; rows with equal
doc_ids follow one another, ordered by text; empty tables give no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean
from .tokens import encoder, slices

MAGIC = b"TPLN1\0"
#: magic, bytes an id, bits a plane, ids a block, ids, documents, chunks, bytes of the packed document table
_HEAD = struct.Struct("<6sBBIQQII")
_CHUNK = np.dtype([("at", "<u8"), ("size", "<u4"), ("crc", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u4")])
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22
LEVEL = 3
TABLE = "part int, seq int, n_ids long, n_docs long, file binary"


def to_planes(ids: np.ndarray, plane_bits: int) -> list[bytes]:
    """The block's planes, lowest first; ids little-endian."""
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.itemsize)
    if plane_bits == 8:
        return [raw[:, k].tobytes() for k in range(ids.itemsize)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(bits.shape[1])]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype, plane_bits: int) -> np.ndarray:
    if plane_bits == 8:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view(dtype).reshape(n)


def pack(ids: np.ndarray, docs: np.ndarray, plane_bits: int = 8, block: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """One file of ids and their documents (doc_id, null, n)."""
    compress = zstandard.ZstdCompressor(level=level).compress
    chunks = [compress(p) for at in range(0, len(ids), block) for p in to_planes(ids[at : at + block], plane_bits)]
    table = compress(docs.tobytes())
    index = np.zeros(len(chunks), _CHUNK)
    size = [len(c) for c in chunks]
    index["size"], index["crc"] = size, [zlib.crc32(c) for c in chunks]
    index["at"] = _HEAD.size + len(table) + index.nbytes + np.cumsum([0, *size])[:-1]
    return b"".join([_HEAD.pack(MAGIC, ids.itemsize, plane_bits, block, len(ids), len(docs), len(chunks), len(table)), table, index.tobytes(), *chunks])


def unpack(file: bytes, blocks: Iterable[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids (of the named blocks, or all) and the document table; a damaged chunk raises ValueError."""
    magic, width, plane_bits, block, n, n_docs, n_chunks, n_table = _HEAD.unpack_from(file)
    if magic != MAGIC:
        raise ValueError("not a token file")
    expand = zstandard.ZstdDecompressor().decompress
    docs = np.frombuffer(expand(file[_HEAD.size : _HEAD.size + n_table], max_output_size=max(1, n_docs * _DOC.itemsize)), _DOC)
    index = np.frombuffer(file, _CHUNK, n_chunks, _HEAD.size + n_table)
    dtype, per = np.dtype(f"<u{width}"), width * 8 // plane_bits
    out = []
    for b in range(n_chunks // per) if blocks is None else blocks:
        own = [file[c["at"] : c["at"] + c["size"]] for c in index[b * per : (b + 1) * per]]
        if any(zlib.crc32(x) != c["crc"] for x, c in zip(own, index[b * per : (b + 1) * per], strict=True)):
            raise ValueError(f"chunk of block {b} is damaged")
        out.append(from_planes([expand(x, max_output_size=block * width) for x in own], min(block, n - b * block), dtype, plane_bits))
    return np.concatenate(out) if out else np.zeros(0, dtype), docs


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, plane_bits: int = 8, file_ids: int = FILE_IDS, block: int = BLOCK_IDS) -> None:
    """Encodes ``doc_id, text`` in ascending order of doc_id into the table of files at ``path``."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([] if end_id is None else [end_id], code.dtype)
        held: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            own, table = np.concatenate(held), np.concatenate(rows)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(own)]), pa.array([len(table)]), pa.array([pack(own, table, plane_bits, block)], pa.binary())], ["part", "seq", "n_ids", "n_docs", "file"])
            held.clear()
            rows.clear()
            return out

        for batch in batches:
            for piece in slices(batch, "text"):
                ids, length = code.encode(piece.column("text"))
                if len(end):
                    ids, length = np.insert(ids, np.cumsum(length), end[0]), length + 1
                table = np.zeros(len(length), _DOC)
                table["n"], table["null"] = length, piece.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                table["doc_id"] = piece.column("doc_id").fill_null(0).to_numpy()
                held.append(ids)
                rows.append(table)
                n += len(ids)
                if n >= file_ids:
                    yield close()
                    seq, n = seq + 1, 0
        if rows:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # few, large values: sizes are to be checked at each row, and planes are compressed already
    options = {"compression": "none", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.max": "2"}
    ordered.mapInArrow(lean(encode), TABLE).write.options(**options).parquet(path)


def token_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reads the files back: ``doc_id, start, n_tokens, ids_crc32``; start counts the ids of all documents before."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, file in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("file"), strict=True):
                ids, docs = unpack(file.as_py())
                wide = ids.astype("<u4")
                end = np.cumsum(docs["n"], dtype=np.int64)
                crc = [zlib.crc32(wide[a:b]) for a, b in zip((end - docs["n"]).tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), part, np.int32)), pa.array(np.full(len(docs), seq, np.int32)), pa.array(docs["doc_id"], mask=docs["null"].astype(bool)), pa.array(end - docs["n"]), pa.array(docs["n"].astype(np.int64)), pa.array(np.array(crc, np.int64))],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(TABLE).parquet(path)
    sizes = files.select("part", "seq", "n_ids")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the writing job
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("off")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("off")).alias("first"))
    read = files.select("part", "seq", "file").mapInArrow(lean(decode), "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_files(spark: SparkSession, path: str, write) -> None:
    """Calls ``write(name, bytes)`` on the executors for each file, named by part and seq in order of the ids."""

    def each(rows) -> None:
        for r in rows:
            write(f"{r.part:06d}-{r.seq:06d}.tpln", bytes(r.file))

    spark.read.schema(TABLE).parquet(path).foreachPartition(each)
