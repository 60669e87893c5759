"""Benchmark decontamination (5): a distributed positional inverted index of the training words.

The index is partitioned by document: each task cuts its documents into segments of
bounded size and stores, for every term that some test item holds (told by a bit map
of fixed size, so a few others are kept too), the sorted list of its positions in the
segment.  It is written once; no posting is shuffled.  A test window is looked up
from its rarest term: its list, moved back by the term's place in the window, is
intersected with the moved lists of the next rarer terms until nothing or the exact
occurrences are left.  ``proximity`` returns looser matches from the same lists.

Test items are numbered and cut into blocks of at most ``BLOCK_WORDS`` words by the
executors, a longer item into several blocks whose windows follow one another; the
driver hands one block at a time on, as a broadcast of bounded size.  Each block is
one pass over the index that returns only what it hit, so any benchmark size works.

Nulls and texts without words have no words: as documents they are clean, as items
they have no window.  The windows of an item without item_id count, but the item is
not named or counted.  Equal items count once per item_id; equal rows are judged
each; occurrences may overlap, a word counts once; with an empty benchmark every
document is clean; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch, written
from .tokens import slices

WINDOW = 13
BLOCK_WORDS = 1_000_000
SEGMENT_BYTES = 4 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bits of the map of the terms of test items.
TERM_BITS = 24
SEGMENT = "segment long, doc_ids array<long>, text_hashes array<long>, n_words array<int>, terms binary, counts binary, positions binary"
#: Runs of hit words of a document, as begin and end, and the items that a block found there.
HIT = "segment long, doc int, runs array<struct<a:int,b:int>>, items array<string>"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").encode().lower().decode())


@dataclass
class Block:
    """Test items one after another as numbers of their words, and where windows begin."""

    window: int = WINDOW
    terms: dict[str, int] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)
    seq: list[int] = field(default_factory=list)
    begin: list[int] = field(default_factory=list)
    length: list[int] = field(default_factory=list)
    item: list[int] = field(default_factory=list)

    def add(self, item: str | None, own: list[str], begins: int | None = None) -> None:
        """``own`` words of an item; windows begin at the first ``begins`` of them, or wherever one is whole."""
        n = min(self.window, len(own))
        for at in range(len(own) - n + 1)[:begins]:
            self.begin.append(len(self.seq) + at)
            self.length.append(n)
            self.item.append(len(self.items))
        self.items.append(item)
        self.seq += [self.terms.setdefault(w, len(self.terms)) for w in own]

    def packed(self) -> bytes:
        return pickle.dumps((list(self.terms), *(np.asarray(x, np.int64) for x in (self.seq, self.begin, self.length, self.item)), self.items))


def term_bit(term: str) -> int:
    return zlib.crc32(term.encode()) >> (32 - TERM_BITS)


def blocks(items: DataFrame, window: int = WINDOW, most_words: int = BLOCK_WORDS, cut: bool = True) -> DataFrame:
    """``block``: the items of ``item_id, text`` in blocks of at most ``most_words`` words; if ``cut``, longer items go
    into several blocks, else a longer one has its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block.packed()], pa.binary())], ["block"])

        block = Block(window)
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words(text)
                step = most_words if cut and len(own) > most_words else max(1, len(own))
                for at in range(0, len(own) - min(window, len(own)) + 1 if own else 0, step):
                    part = own[at : at + step + window - 1]
                    if block.seq and len(block.seq) + len(part) > most_words:
                        yield done()
                        block = Block(window)
                    block.add(item, part, step)
        if block.seq:
            yield done()

    # about a block from each task
    few = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = few.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n // (4 * most_words) + 1
    return written(few.coalesce(int(n)).mapInArrow(lean(run), "block binary"), "test-items")


def term_map(items: DataFrame) -> bytes:
    """A bit for each possible ``term_bit``, set for the terms of the items: 2 ** TERM_BITS bits at any size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {term_bit(w) for t in batch.column("text") for w in words(t.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array([b + 1 for b in sorted(seen)], pa.int64())], ["place"])  # Spark counts from 1

    places = items.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "place long")
    rows = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    out = np.zeros(2**TERM_BITS // 8, np.uint8)
    for r in rows:
        out[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


class Segment:
    """Postings of one segment, by the numbers a block gives its terms; documents lie a free place apart, so no match crosses them."""

    def __init__(self, row: dict, terms: Iterable[str]):
        expand = zstandard.ZstdDecompressor().decompress
        own = expand(row["terms"]).decode().split("\n") if row["terms"] else []
        number = dict(zip(own, range(len(own)), strict=True)).get
        counts = np.frombuffer(expand(row["counts"]), "<u4").astype(np.int64) if own else np.zeros(0, np.int64)
        steps = np.frombuffer(expand(row["positions"]), "<u4") if own else np.zeros(0, "<u4")
        first = np.cumsum(counts) - counts
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        total = np.cumsum(steps, dtype=np.int64)
        self.positions = total - np.repeat(total[first] - steps[first], counts)
        local = np.array([number(t, -1) for t in terms], np.int64)
        self.count, self.at = (np.where(local >= 0, np.append(x, 0)[local], 0) for x in (counts, first))

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.at[term] : self.at[term] + self.count[term]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions at which the terms stand one after another."""
        found = None
        for k in np.argsort(self.count[terms], kind="stable"):
            own = self.postings(terms[k])
            if found is None:
                found = own - k
            else:
                place = np.searchsorted(own, found + k)
                found = found[(place < len(own)) & (own[np.minimum(place, len(own) - 1)] == found + k)]
            if not len(found):
                break
        return found

    def near(self, terms: np.ndarray, width: int) -> list[tuple[int, int]]:
        """The least spans [a, b) of at most ``width`` places that hold all the terms, none inside another."""
        terms = np.unique(terms)
        rare = self.postings(terms[np.argmin(self.count[terms])])
        lists = [self.postings(t) for t in terms]
        close = np.ones(len(rare), bool)
        for own in lists:
            close &= np.searchsorted(own, rare + width - 1, "right") > np.searchsorted(own, rare - width + 1, "left")
        spans: set[tuple[int, int]] = set()
        for p in rare[close].tolist():
            here = sorted((int(q), k) for k, own in enumerate(lists) for q in own[np.searchsorted(own, p - width + 1) : np.searchsorted(own, p + width - 1, "right")])
            last: dict[int, int] = {}
            for q, k in here:
                last[k] = q
                if len(last) == len(lists) and q - min(last.values()) < width:
                    spans.add((min(last.values()), q + 1))
        return sorted(s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans))


def index(docs: DataFrame, known: bytes) -> DataFrame:
    """Segments of ``doc_id, text``: the terms in the map ``known``, and for each the number and the positions of its postings, as steps."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, bits, serial = zstandard.ZstdCompressor(level=1).compress, np.frombuffer(shared.value, np.uint8), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                number: dict[str, int] = {}
                n_words, ids = [], []
                for text in part.column("text"):
                    own = words(text.as_py())
                    n_words.append(len(own))
                    ids.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int32, len(own)))
                    ids.append(np.array([-1], np.int32))
                bit = np.array([term_bit(w) for w in number], np.int64)
                kept = (bits[bit >> 3] >> (bit & 7) & 1).astype(bool)
                place = np.append(np.where(kept, np.cumsum(kept) - 1, -1), -1)  # of a term among the kept ones
                term = place[np.concatenate(ids)]
                position = np.argsort(term, kind="stable")[np.count_nonzero(term < 0) :]
                counts = np.bincount(term[position], minlength=int(kept.sum()))
                first = np.cumsum(counts) - counts
                steps = np.diff(position, prepend=0)
                steps[first] = position[first]
                names = "\n".join(w for w, k in zip(number, kept.tolist(), strict=True) if k)
                packed = [compress(x) for x in (names.encode(), counts.astype("<u4").tobytes(), steps.astype("<u4").tobytes())] if names else [None] * 3
                ids = [pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([pa.array([serial]), *ids, pa.array([n_words], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in packed)], [x.split()[0] for x in SEGMENT.split(", ")])
                serial += 1

    text = F.col("text").cast("string")
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(lean(run), SEGMENT), "postings", **_LARGE_VALUES)


#: A few large values per file: the writer checks its sizes at each row.
_LARGE_VALUES = {"compression": "none", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


def matched(segments: DataFrame, block: bytes) -> DataFrame:
    """What the windows of a block hit, a row (``HIT``) per document that they hit."""
    shared = segments.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, seq, begin, length, item, items = pickle.loads(shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                segment = Segment(row, terms)
                cover = np.zeros(int(segment.base[-1]) + 1, np.int32)
                have = np.concatenate([[0], np.cumsum(segment.count[seq] > 0)])
                named: dict[int, set[str]] = {}
                for w in np.flatnonzero(have[begin + length] - have[begin] == length).tolist() if len(begin) else []:
                    found = segment.phrase(seq[begin[w] : begin[w] + length[w]])
                    if len(found):
                        np.add.at(cover, found, 1)
                        np.add.at(cover, found + length[w], -1)
                        for d in np.unique(np.searchsorted(segment.base, found, "right") - 1).tolist():
                            named.setdefault(d, set()).add(items[item[w]])
                if not named:
                    continue
                edge = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False)).reshape(-1, 2)
                at_doc, hit = np.searchsorted(edge[:, 0], segment.base), sorted(named)
                runs = [[{"a": a, "b": b} for a, b in (edge[at_doc[d] : at_doc[d + 1]] - segment.base[d]).tolist()] for d in hit]
                found = [sorted(i for i in named[d] if i is not None) for d in hit]
                yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * len(hit), pa.int64()), pa.array(hit, pa.int32()), pa.array(runs, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(found, pa.list_(pa.string()))], ["segment", "doc", "runs", "items"])

    return segments.select("segment", "n_words", "terms", "counts", "positions").mapInArrow(lean(run), HIT)


def hits(segments: DataFrame, items: DataFrame, window: int, most_words: int) -> DataFrame:
    """The rows of all blocks of ``items``, written block by block."""
    out = None
    for row in blocks(items, window, most_words).toLocalIterator():
        own = written(matched(segments, bytes(row.block)), "hits")
        out = own if out is None else out.unionByName(own)
    return segments.sparkSession.createDataFrame([], HIT) if out is None else out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 0.05, most_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, items, contaminated``.

    A document word inside an occurrence of an item's window is hit; a document is contaminated
    if some word is hit and the hit words are at least ``share`` of all its words.
    """
    with scratch(docs.sparkSession) as keep:
        segments = index(docs, term_map(items))
        found = hits(segments, items, window, most_words).groupBy("segment", "doc").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        # words in a run and not in one before it; runs are in order of their begins
        covered = F.expr("aggregate(runs, struct(0 AS b, 0L AS n), (s, r) -> struct(greatest(s.b, r.b) AS b, s.n + greatest(0, r.b - greatest(s.b, r.a)) AS n), s -> s.n)")
        found = written(found.select("segment", "doc", covered.alias("n_hit"), "items"), "hit-documents")
        own = segments.select("segment", F.posexplode(F.arrays_zip("doc_ids", "text_hashes", "n_words")).alias("doc", "own"))
        own = written(own.select("segment", "doc", F.col("own.doc_ids").alias("doc_id"), F.col("own.text_hashes").alias("text_hash"), F.col("own.n_words").cast("long").alias("n_words")), "word-counts")
        keep += [found, own]
    out = own.join(found, ["segment", "doc"], "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    least = int(round(1 / share))
    return out.select("doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", ((F.col("n_hit") > 0) & (F.lit(least) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def proximity(docs: DataFrame, items: DataFrame, width: int, most_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, begin, end``: the least spans of document words, of ``width`` at most, that hold all words of an item, in any order."""
    segments, out, schema = index(docs, term_map(items)), None, "doc_id long, item_id string, begin long, end long"
    for block in blocks(items, 1, most_words, cut=False).toLocalIterator():
        shared = docs.sparkSession.sparkContext.broadcast(bytes(block.block))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, seq, begin, _, item, names = pickle.loads(shared.value)
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    segment, rows = Segment(row, terms), []
                    for k, name in enumerate(names):
                        own = seq[begin[item == k]]
                        if segment.count[own].all():
                            for a, b in segment.near(own, width):
                                d = int(np.searchsorted(segment.base, a, "right")) - 1
                                if b <= segment.base[d + 1]:
                                    rows.append((row["doc_ids"][d], name, a - int(segment.base[d]), b - int(segment.base[d])))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "begin", "end"])

        own = segments.mapInArrow(lean(run), schema)
        out = own if out is None else out.unionByName(own)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out
