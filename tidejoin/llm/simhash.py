"""SimHash near-dedup (1): fingerprints compared exactly in tiles, with numpy exclusive-or and bit counts.

1. Each text gets a fingerprint of 64 bits or more over its word shingles.
2. Texts with the same node (the fingerprint itself, or for checked links a 128-bit
   digest of the shingles) are folded into one row, so copies cost nothing further.
3. Rows go to blocks.  With radius r the 64 bits are cut into r + 1 bands; two
   fingerprints that differ in at most r bits agree in a band, so comparing inside
   the blocks of equal bands loses no link.  For wide fingerprints with a large
   radius (``min_keys``) the blocks are equal minima of the hashed shingles instead.
4. A block beyond ``tile`` rows is dealt into tiles by population count and hash.
   Only pairs of tiles whose population counts differ by no more than the radius
   are compared, each in a task's bounded memory, and each pair of rows only in the
   first block that both share; a pair of tiles returns a spanning forest of its
   links, not the links.
5. Components of all forests give each document its class.

``near_duplicates`` is the general stage: five-word shingles, wide fingerprints, and
links of exact Jaccard similarity (of sets of shingles) ``least`` or more, and these
only.  Step 4 then runs twice: the first pass finds the rows that have another one
within the radius, the second gets these rows' shingles too and checks every such
pair in its task, but for pairs that checked links of the tiles join already.

Nulls count as empty texts; an empty text has fingerprint zero and is linked like
any other; equal rows share a class; an empty table gives an empty result; a row
without doc_id links like any other and gets its component's smallest doc_id, null
if there is none; a doc_id with several texts has a row for each; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean, scratch, without, written
from .components import components

SEED = 42
#: Rows of a tile, and for checked links also its shingles.
TILE = 2048
CHECKED_TILE = 1024
CHECKED_SHINGLES = 1 << 20
#: Groups of at most so many rows return all their links.
FEW = 8
#: Links of a task that go out at once.
SENT = 1 << 17
#: Most pairs whose fingerprints are compared at once.
AT_ONCE = 1 << 16
#: Standard deviations of the number of differing bits that the radius leaves for a pair at ``least``.
DEVIATIONS = 6
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class SimHash:
    """What a fingerprint is and which of them link."""

    shingle: int = 3
    words: int = 1  # of 64 bits
    radius: int = 2
    min_keys: int = 0  # 0: bands, and the radius decides; else minima, and the radius proposes
    distinct: bool = False  # a repeated shingle counts once
    letters: bool = False  # words are runs of letters and digits, so marks don't count

    def keys(self, fp: np.ndarray, hashes: np.ndarray) -> list[int]:
        if not self.min_keys:
            edge = np.linspace(0, 64, self.radius + 2).astype(int).tolist()
            value = int(fp[0])
            return [value >> a & ((1 << (b - a)) - 1) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        if not len(hashes):
            return [0] * self.min_keys
        return [int((mixed(hashes, 1000 + k)).min() >> np.uint64(1)) for k in range(self.min_keys)]


def checked(least: float = 0.8, words: int = 16, shingle: int = 5, min_keys: int = 8) -> SimHash:
    """The settings for links of similarity ``least``.

    Of two sets of five shingles or more at 0.8 a bit differs with probability 0.1615
    at most (the greatest over all sizes; 0.1875 for four and five shingles, see
    ``reach``).  A pair at ``least`` shares none of the minima with probability
    (1 - least) ** min_keys, and its bits lie beyond the radius with about 1e-9.
    """
    return SimHash(shingle, words, int(reach(least, 64 * words)[0]), min_keys, True, True)


def differing(least: float) -> tuple[float, float]:
    """Probability that a bit of two fingerprints differs, at most, for sets of similarity ``least`` or more: sets of
    few shingles, and others."""
    wide = np.arccos(2 * least / (1 + least)) / np.pi
    return 1.25 * wide, 1.07 * wide


def reach(least: float, bits: int) -> tuple[int, int]:
    """Differing bits that leave no pair of similarity ``least`` out: of sets of few shingles, and others."""
    return tuple(int(np.ceil(bits * p + DEVIATIONS * np.sqrt(bits * p * (1 - p)))) for p in differing(least))


#: Sets of fewer shingles count as few.
MANY = 5


def text_words(text: str | None, letters: bool = False) -> list[bytes]:
    """Lower-case (A-Z) words; with ``letters`` runs of letters and digits, unless there are none."""
    low = (text or "").encode().lower()
    return (_WORD.findall(low) if letters else None) or low.split()


def shingle_hashes(text: str | None, size: int, letters: bool = False) -> np.ndarray:
    """XXH64 of each run of ``size`` words, in order; of the whole sequence if there are fewer."""
    words = text_words(text, letters)
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), min(size, len(words))
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - n + 1].tolist(), end[n - 1 :].tolist(), strict=True)], np.uint64)


def mixed(h: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Another 64-bit hash of each hash, one for each k (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.asarray(k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """A bit is 1 if it is set in over half the hashes; the first 64 bits come from the hashes themselves."""
    count = np.zeros(64 * words, np.int64)
    step = max(1, (1 << 16) // words)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step, None]
        part = np.hstack([part, mixed(part, np.arange(1, words)[None])]) if words > 1 else part
        count += np.unpackbits(part.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * count > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


FINGERPRINT = "doc_id long, text_hash long, node binary, fp binary, pc int, n int, keys array<long>"


def fingerprints(docs: DataFrame, how: SimHash, shingles: bool = False) -> DataFrame:
    """``doc_id, text_hash, node, fp, pc, n, keys`` for each row of ``doc_id, text``, with ``shingles`` also their hashes."""
    schema = FINGERPRINT + ", shingles binary" * shingles

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                nodes, fps, sizes, keys, sets = [], [], [], [], []
                for text in part.column("text"):
                    h = shingle_hashes(text.as_py(), how.shingle, how.letters)
                    h = np.unique(h) if how.distinct else h
                    fp = fingerprint(h, how.words)
                    fps.append(fp.astype(">u8").tobytes())
                    nodes.append(xxhash.xxh3_128_digest(h.tobytes()) if how.min_keys else fps[-1])
                    sizes.append(len(h) if how.min_keys else 0)
                    keys.append(how.keys(fp, h))
                    if shingles:
                        sets.append(h.astype("<u8").tobytes())
                pc = np.bitwise_count(np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1)).sum(axis=1, dtype=np.int32)
                made = [pa.array(nodes, pa.binary()), pa.array(fps, pa.binary()), pa.array(pc), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), *([pa.array(sets, pa.binary())] if shingles else [])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *made], [x.split()[0] for x in schema.split(", ")])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(lean(run), schema)


class Rows:
    """The rows of some groups (pairs of tiles): what two rows need to be a link, or with ``min_keys`` to be worth a check."""

    def __init__(self, table: pa.Table, how: SimHash, least: float):
        self.how, self.least, self.coarse = how, least, 4 if how.min_keys else 1
        self.pc, self.side, self.n, self.band = (table.column(x).to_numpy() for x in ("pc", "side", "n", "band"))
        self.fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(table.num_rows, -1)
        self.keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)

    def limit(self, words: int) -> np.ndarray:
        """Most differing bits of the first ``words`` words: of sets of many shingles, and of few."""
        return np.array(reach(self.least, 64 * words)[::-1] if self.how.min_keys else [self.how.radius] * 2)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs with the same band those that lie within the radius and share no earlier band."""
        if not len(i):
            return i, j
        for words in sorted({self.coarse, self.fp.shape[1]}):
            d = np.bitwise_count(self.fp[i, :words] ^ self.fp[j, :words]).sum(axis=1, dtype=np.int32)
            close = d <= self.limit(words)[(np.minimum(self.n[i], self.n[j]) < MANY).astype(int)]
            i, j = i[close], j[close]
        if self.how.min_keys:
            fits = np.minimum(self.n[i], self.n[j]) >= self.least * np.maximum(self.n[i], self.n[j])
            i, j = i[fits], j[fits]
        new = ~((self.keys[i] == self.keys[j]) & (np.arange(self.keys.shape[1]) < self.band[i, None])).any(axis=1)
        return i[new], j[new]

    def few(self, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of groups of the same small size, which begin at ``starts``."""
        a, b = np.array(list(combinations(range(size), 2))).T
        step = max(1, AT_ONCE // len(a))
        for at in range(0, len(starts), step):
            first = starts[at : at + step, None]
            i, j = (first + a).ravel(), (first + b).ravel()
            apart = (self.side[i] != self.side[j]) | ((self.side[first] == 0) & (self.side[first + size - 1] == 0)).repeat(len(a), axis=1).ravel()
            yield self.near(i[apart], j[apart])

    def many(self, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links inside one tile (all of side 0), or between the tiles of sides 0 and 1, by blocks of rows in order of
        population count; columns out of its reach are skipped."""
        pc, side, fp = self.pc[start:end], self.side[start:end], self.fp[start:end, : self.coarse]
        order, same = np.argsort(pc, kind="stable"), not side.any()
        left, right = (order, order) if same else (order[side[order] == 0], order[side[order] == 1])
        counts, rows = pc[right], max(1, AT_ONCE // max(1, len(right)))
        for at in range(0, len(left), rows):
            own = left[at : at + rows]
            a, b = np.searchsorted(counts, pc[own[0]] - self.how.radius, "left"), np.searchsorted(counts, pc[own[-1]] + self.how.radius, "right")
            a = max(a, at) if same else a
            if a < b:
                other = right[a:b]
                d = np.bitwise_count(fp[own, None, 0] ^ fp[None, other, 0]) if self.coarse == 1 else np.bitwise_count(fp[own, None] ^ fp[None, other]).sum(axis=2, dtype=np.int32)
                i, j = np.nonzero(d <= self.limit(self.coarse).max())
                if same:
                    i, j = i[i + at < j + a], j[i + at < j + a]
                yield self.near(start + own[i], start + other[j])


def joined_labels(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that links reach, for each of n rows."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            if not (apart := a != b).any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            parent = np.arange(n)
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
    return label


def similar(sets: list[np.ndarray], links: Iterable[tuple[np.ndarray, np.ndarray]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of those of the links whose sets have a Jaccard similarity of ``least`` or more.

    A set's shingles are marked in the vocabulary of all sets, and the marks counted in the sets it is linked to.
    """
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label, out = np.zeros(len(words), bool), np.arange(len(sets)), []
    for i, j in links:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        edges = np.append(np.flatnonzero(np.diff(i, prepend=-1)), len(i))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            x = int(i[a])
            other = j[a:b][label[j[a:b]] != label[x]]
            mark[place[first[x] : first[x] + size[x]]] = True
            while len(other):
                step = max(1, int(np.searchsorted(np.cumsum(size[other]), AT_ONCE * 8, "right")))
                now, other = other[:step], other[step:]
                begin = np.cumsum(size[now]) - size[now]
                at = np.arange(int(size[now].sum())) + np.repeat(first[now] - begin, size[now])
                both = np.add.reduceat(mark[place[at]], begin, dtype=np.int64)
                for y in now[both >= least * (size[x] + size[now] - both)].tolist():
                    if label[x] != label[y]:
                        out.append((x, y))
                        label[label == label[y]] = label[x]
                other = other[label[other] != label[x]]
            mark[place[first[x] : first[x] + size[x]]] = False
    return tuple(np.array([e[k] for e in out], np.int64) for k in (0, 1))


#: What names a pair of tiles: the block, and class of population count and number of each tile.
PAIR = ["band", "key", "p", "s", "q", "t"]


def tile_rows(nodes: DataFrame, how: SimHash, tile: int) -> DataFrame:
    """Each node once for each pair of tiles that it takes part in."""
    step = how.radius if how.min_keys else 1  # a wide radius reaches the next class only
    near = -(-how.radius // step)
    spread = nodes.select("node", "fp", "pc", "n", "keys", F.floor(F.col("pc") / step).cast("int").alias("cls"), F.posexplode("keys").alias("band", "key"))
    counts = spread.groupBy("band", "key", "cls").agg(F.count("*").alias("rows"), F.sum("n").alias("terms"))
    tiles = F.expr(f"greatest((rows + {tile} - 1) div {tile}, (terms + {CHECKED_SHINGLES} - 1) div {CHECKED_SHINGLES})")
    plan = counts.groupBy("band", "key").agg(F.sum("rows").alias("total"), F.sum("terms").alias("terms"), F.map_from_entries(F.collect_list(F.struct("cls", tiles.alias("k")))).alias("tiles")).where("total > 1")
    rows = spread.join(plan.withColumn("whole", F.expr(f"total <= {tile} and terms <= {CHECKED_SHINGLES}")).drop("terms"), ["band", "key"])
    # each band deals a block out anew, so that blocks that several bands share meet in many ways within tiles
    rows = rows.withColumn("me", F.when(F.col("whole"), F.struct(F.lit(-1).alias("cls"), F.lit(0).cast("long").alias("t"))).otherwise(F.struct("cls", F.expr("pmod(xxhash64(node, band), tiles[cls])").alias("t"))))
    # tiles within reach, by class and number
    others = F.expr(f"flatten(transform(filter(map_keys(tiles), x -> abs(x - cls) <= {near}), x -> transform(sequence(0L, tiles[x] - 1), y -> struct(x as cls, y as t))))")
    rows = rows.withColumn("other", F.explode(F.when(F.col("whole"), F.array("me")).otherwise(others)))
    first, last = F.least("me", "other"), F.greatest("me", "other")
    return rows.select("band", "key", first["cls"].alias("p"), first["t"].alias("s"), last["cls"].alias("q"), last["t"].alias("t"), (F.col("me") != first).cast("int").alias("side"), "node", "fp", "pc", "n", "keys")


def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole pairs of tiles, as rows and the places where each begins and the last ends."""
    held: list[pa.RecordBatch] = []
    for batch, last in _lookahead(batches):
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        if not table.num_rows:
            continue
        cols = [table.column(x).to_numpy() for x in PAIR]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        starts = np.append(np.flatnonzero(new), table.num_rows)
        held = []
        if not last:  # the last group may go on in the next batch
            held, starts = table.slice(starts[-2]).to_batches(), starts[:-1]
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts


def _lookahead(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Each batch and whether it is the last."""
    held = None
    for b in batches:
        if held is not None:
            yield held, False
        held = b
    if held is not None:
        yield held, True


def linked(rows: DataFrame, how: SimHash, least: float, what: str) -> DataFrame:
    """From ``tile_rows``: ``a, b``, nodes joined by a link, as forests of the pairs of tiles; if ``what`` is "rows", the
    rows that have a link, as the pair of tiles, the side and the node; if "checked", forests of the links that a check
    of the shingles leaves."""

    def edges(table: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        node = table.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j))], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches):
            own, size, found = Rows(table, how, least), np.diff(starts), []
            for k in range(2, FEW + 1) if what != "checked" else ():
                if len(at := starts[:-1][size == k]):
                    found += own.few(at, k)
            if what == "rows":
                active = np.zeros(table.num_rows, bool)
                for i, j in found:
                    active[i] = active[j] = True
                for g in np.flatnonzero(size > FEW).tolist():
                    for i, j in own.many(int(starts[g]), int(starts[g + 1])):
                        active[i] = active[j] = True
                if active.any():
                    yield from table.select([*PAIR, "side", "node"]).filter(pa.array(active)).combine_chunks().to_batches()
                continue
            sent = sum(len(f[0]) for f in found)
            for g in np.flatnonzero(size > (FEW if what == "forest" else 1)).tolist():
                a, b = int(starts[g]), int(starts[g + 1])
                links = ((i - a, j - a) for i, j in own.many(a, b))
                if what == "checked":
                    i, j = similar([np.frombuffer(s, "<u8") for s in table.column("shingles").slice(a, b - a).to_pylist()], links, least)
                else:
                    label = joined_labels(b - a, links)
                    i = np.flatnonzero(label != np.arange(b - a))
                    j = label[i]
                found.append((a + i, a + j))
                sent += len(i)
                if sent >= SENT:
                    yield edges(table, *(np.concatenate([f[k] for f in found]) for k in (0, 1)))
                    found, sent = [], 0
            if sent:
                yield edges(table, *(np.concatenate([f[k] for f in found]) for k in (0, 1)))

    # a task gets whole pairs of tiles, each of 2 * tile rows at most
    dealt = rows.repartition(*PAIR).sortWithinPartitions(*PAIR, "side", "node")
    return dealt.mapInArrow(lean(run), "band int, key long, p int, s long, q int, t long, side int, node binary" if what == "rows" else "a binary, b binary")


def checked_links(docs: DataFrame, nodes: DataFrame, how: SimHash, least: float, tile: int) -> DataFrame:
    """``a, b``: nodes joined by links of similarity ``least`` or more."""
    with scratch(docs.sparkSession) as keep:
        active = written(linked(tile_rows(nodes, how, tile), how, least, "rows"), "active")
        ids = nodes.join(active.select("node").distinct(), "node", "left_semi").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
        ids = bounded(written(ids, "active-documents"))
        named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        own = named.join(ids, named["doc_id"].eqNullSafe(ids["_d"]) & (F.xxhash64(named["text"]) == ids["_h"]), "left_semi")
        sets = fingerprints(own, how, shingles=True).drop("doc_id", "text_hash").dropDuplicates(["node"])
        edges = written(linked(active.join(sets, "node"), how, least, "checked"), "links")
        keep.append(edges)
    return edges


def classes(docs: DataFrame, how: SimHash = SimHash(), tile: int = TILE, least: float = 0.0) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` for each row; with ``min_keys`` links are checked for similarity ``least``."""
    with scratch(docs.sparkSession) as keep:
        fps = written(fingerprints(docs, how), "fingerprints")
        # one row of the text stands for the node, and gives its shingles
        own = F.min(F.struct("doc_id", "text_hash")) if how.min_keys else F.struct(F.min("doc_id").alias("doc_id"))
        nodes = written(fps.groupBy("node", "fp", "pc", "n", "keys").agg(own.alias("own"), F.min("doc_id").alias("rep")).select("node", "fp", "pc", "n", "keys", "own.*", "rep"), "nodes")
        edges = checked_links(docs, nodes, how, least, tile) if how.min_keys else linked(tile_rows(nodes, how, tile), how, least, "forest")
        found = components(edges, "a", "b")
        found = written(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).join(nodes.select("node", "rep"), "node"), "components")
        named = found.join(found.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("node", "component_id")
        named = written(nodes.select("node", "rep").join(named, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id")), "classes")
        keep += [fps, named]
    return fps.select("doc_id", "text_hash", "node", "fp").join(named, "node", "left").select("doc_id", "text_hash", "fp", "component_id")


def near_duplicates(docs: DataFrame, how: SimHash | None = None, least: float = 0.8, tile: int = CHECKED_TILE) -> DataFrame:
    """``doc_id, text_hash, component_id`` of each document; texts of similarity ``least`` or more share a component."""
    return classes(docs, how or checked(least), tile, least).select("doc_id", "text_hash", "component_id")


def deduplicated(docs: DataFrame, how: SimHash | None = None, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest doc_id, whose repeated rows all stay; a row without
    doc_id goes if a row of its group has one."""
    with scratch(docs.sparkSession) as keep:
        found = near_duplicates(docs, how, least)
        gone = written(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash").distinct(), "copies")
        keep.append(gone)
    return without(docs, gone)
