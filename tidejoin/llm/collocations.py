"""Collocations: frequent phrases of two to four words, scored by how often their parts occur apart.

1. Texts are split once into pieces and words with numpy and stored as *slices*: a
   dictionary of the slice's words with their counts, and the code of each word in turn.
2. Words are summed up by language.  For each length from 2 on, every position whose two
   shorter phrases may be frequent adds to the count of its phrase's bucket, told by ``BUCKET_BITS`` of its hash.
   Buckets that reach the minimum are kept as bits of a map of bounded size, in which the next
   length looks its parts up.  A phrase as frequent as the minimum passes all maps, so the
   candidates, the different phrases that do, are safe in Apriori's sense.
3. Candidates, single words included, are put into double-array tries by their hash, at most
   ``TRIE_NODES`` to a trie; the tasks that build them write them to the shared folder.  Each trie is broadcast,
   all positions of a slice advance together one level after the other, accepting
   states are counted by bincount, and Spark sums the shards.  Only these counts are used.
4. Cuts, scores and containment are joins of the counted phrases with one another; products
   are decimals of 38 digits.  A language's first rows come from parts of its phrases first.

Words are known by 64-bit hashes of language and word; a run in which two words that occur share
one takes another seed, so no count is ever mixed.

A null text is empty, a null language is ``und``.  Repeated rows count each time.  Texts are
read whole at any length: a slice ends between pieces, so that only a single piece of
over ``SLICE_BYTES`` makes a larger one.  Equal scores and counts are ordered by the phrase's
UTF-8 bytes.  Empty tables give no rows; columns but ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, scratch, written

#: Words of the longest phrase.
LONGEST = 4
#: Text bytes of a slice.
SLICE_BYTES = 2 << 20
#: A map has 2^n bits, some 32 to 64 for each frequent bucket, but at most so many (128 MB); a fuller map holds fewer phrases back.
MOST_BITS = 30
#: Nodes of one trie: some 60 MB as arrays.
TRIE_NODES = 4_000_000
#: Highest bits of a bucket that are counted: 2^40 buckets, 1024 for each bit of the largest map, so rows are short and few infrequent phrases share one.
BUCKET_BITS = 40
#: Bucket counts that a task holds before it sends them.
HELD = 500_000
#: Parts of a language whose first rows are found before they are ranked together.
PARTS = 64

_SPACE, _BREAK = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = _SPACE
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SLICE = "lang string, words array<string>, hashes array<long>, counts array<long>, codes binary"


def coded(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of UTF-8 bytes in lower case, as a dictionary, and their codes in order, -1 between pieces."""
    kind = _CLASS[data]
    word = kind == 0
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[word]])).dictionary_encode()
    breaks = np.cumsum(kind == _BREAK, dtype=np.int32)[starts]
    gaps = np.concatenate([[0], np.cumsum(np.diff(breaks) > 0)])
    codes = np.full(len(starts) + gaps[-1], -1, np.int32)
    codes[np.arange(len(starts)) + gaps] = words.indices.to_numpy()
    return words.dictionary, codes


def chunks(texts: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of the texts with a break after each, some ``SLICE_BYTES`` at a time, cut after breaks."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    held, size, end = [], 0, np.array([0x0A], np.uint8)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while b > a:
            cut = b
            if b - a > SLICE_BYTES:
                cut = next((at + 1 for at in _scan(data, a + SLICE_BYTES, b)), b)
            held += [data[a:cut], end]
            size += cut - a + 1
            a = cut
            if size >= SLICE_BYTES:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _scan(data: np.ndarray, a: int, b: int) -> Iterator[int]:
    """Places of breaks from a to b, looked for a part at a time."""
    for i in range(a, b, 1 << 16):
        yield from (i + np.flatnonzero(_CLASS[data[i : min(b, i + (1 << 16))]] == _BREAK)).tolist()


def word_hashes(lang: str, words: pa.Array, seed: int) -> np.ndarray:
    head = lang.encode() + b"\0"
    return np.array([xxhash.xxh64_intdigest(head + w, seed) for w in words.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)


def slices(docs: DataFrame, seed: int) -> DataFrame:
    """The coded slices of all texts, one language each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column("text"), b.column("lang").dictionary_encode()
            own, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            for k in np.unique(own).tolist():
                mine = texts.filter(pa.array(own == k)) if len(names) > 1 else texts
                for data in chunks(mine):
                    words, codes = coded(data)
                    if len(words):
                        counts = np.bincount(codes[codes >= 0], minlength=len(words))
                        one = lambda v, kind: pa.array([v], pa.list_(kind))
                        yield pa.RecordBatch.from_arrays([pa.array([names[k]]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), one(word_hashes(names[k], words, seed), pa.int64()), one(counts, pa.int64()), pa.array([codes.astype("<i4").tobytes()], pa.binary())], ["lang", "words", "hashes", "counts", "codes"])

    read = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return read.mapInArrow(lean(run), SLICE)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def chained(buckets: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Buckets of phrases one word longer."""
    with np.errstate(over="ignore"):
        x = (buckets ^ (buckets >> np.uint64(29))) * _MIX + word
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def map_bits(n: int) -> int:
    return min(MOST_BITS, max(16, (32 * n).bit_length()))


class Maps:
    """Bit maps by phrase length; they say "no" only of what is not frequent."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[int, np.ndarray]] = {}

    def maybe(self, length: int, buckets: np.ndarray) -> np.ndarray:
        bits, kept = self.of[length]
        at = (buckets >> np.uint64(64 - bits)).astype(np.int64)
        return (kept[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bit_map(buckets: DataFrame) -> tuple[int, np.ndarray]:
    """Bits and map of a column ``b`` of a written table; parts of 4 KB come to the driver, at most the map's size."""
    bits = map_bits(buckets.count())
    place = F.shiftrightunsigned("b", 64 - bits) + 1  # bit maps begin at 1
    parts = buckets.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, part in parts.toLocalIterator():
        at = (k - 1) * len(part)
        out[at : at + len(part)] = np.frombuffer(part, np.uint8)[: len(out) - at]
    return bits, out


def frequent(maps: Maps, hashes: np.ndarray, codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``length, positions, buckets`` of the phrases whose two shorter ones may be frequent, up to a length."""
    h = hashes.view(np.uint64)
    good_word = maps.maybe(1, h)
    here = np.flatnonzero((codes >= 0) & good_word[codes])
    buckets = h[codes[here]]
    yield 1, here, buckets
    for length in range(2, longest + 1):
        # the phrase from the next word on has to be possible too
        follows = np.zeros(len(codes) + 1, bool)
        follows[here] = True
        keep = follows[here + 1]
        here, buckets = here[keep], buckets[keep]
        buckets = chained(buckets, h[codes[here + length - 1]])
        yield length, here, buckets
        if length < longest:
            keep = maps.maybe(length, buckets)
            here, buckets = here[keep], buckets[keep]


def bucket_counts(coded_slices: DataFrame, maps, length: int) -> DataFrame:
    """``b, f``: positions of each bucket of phrases of one length, summed over all slices."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        b, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        # counts stay far below 2^53
        return b, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def sent(b: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(b.view(np.int64)), pa.array(f)], ["b", "f"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, low = [], 0, np.uint64(64 - BUCKET_BITS)
        for batch in batches:
            for hashes, codes in _slices(batch):
                *_, (_, _, found) = frequent(maps.value, hashes, codes, length)
                parts.append(np.unique(found >> low << low, return_counts=True))
                size += len(parts[-1][0])
                if size > HELD:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > HELD // 2:
                        yield sent(*parts[0])
                        parts, size = [], 0
        if parts:
            yield sent(*merged(parts))

    rows = coded_slices.select("hashes", "codes").mapInArrow(lean(run), "b long, f long")
    return rows.groupBy("b").agg(F.sum("f").alias("f"))


def candidates(coded_slices: DataFrame, maps) -> DataFrame:
    """``p``: the different phrases that pass all maps, as hashes of their words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, codes in _slices(batch):
                for length, here, buckets in frequent(maps.value, hashes, codes, LONGEST):
                    keep = maps.value.maybe(length, buckets)
                    here, buckets = here[keep], buckets[keep]
                    if not len(here):
                        break
                    words = np.stack([hashes[codes[here + i]] for i in range(length)], axis=1)
                    _, first, inverse = np.unique(buckets, return_index=True, return_inverse=True)
                    # of a bucket that holds several phrases all go out
                    rows = np.concatenate([first, np.flatnonzero((words != words[first[inverse]]).any(axis=1))])
                    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * length)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(words[rows].ravel()))], ["p"])

    return coded_slices.select("hashes", "codes").mapInArrow(lean(run), "p array<long>").distinct()


class Trie:
    """A double array over dense word codes from 1: the child of state s by code c is base[s] + c if check of it is s.

    State 0 is the root.  ``phrase`` is the number of the phrase that a state accepts, or -1.
    """

    def __init__(self, alphabet: np.ndarray, base: np.ndarray, check: np.ndarray, phrase: np.ndarray, phrases: np.ndarray, lengths: np.ndarray):
        self.alphabet, self.base, self.check, self.phrase, self.phrases, self.lengths = alphabet, base, check, phrase, phrases, lengths

    @classmethod
    def of(cls, phrases: np.ndarray, lengths: np.ndarray) -> Trie:
        """From rows of word hashes, of which ``lengths`` count; rows differ."""
        used = np.arange(phrases.shape[1]) < lengths[:, None]
        alphabet = np.unique(phrases[used])
        codes = np.where(used, np.searchsorted(alphabet, phrases) + 1, 0)
        order = np.lexsort(codes.T[::-1])
        codes, lengths, phrases = codes[order], lengths[order], phrases[order]
        prefixes = sum(int((np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]).sum()) for k in range(1, codes.shape[1] + 1) if len(rows := codes[lengths >= k, :k]))
        array = _DoubleArray(len(alphabet), prefixes)
        at = np.zeros(len(codes), np.int64)  # the state of each row's prefix
        phrase = {}
        for level in range(1, phrases.shape[1] + 1):
            rows = np.flatnonzero(lengths >= level)
            if not len(rows):
                break
            prefix = codes[rows, :level]
            new = np.r_[True, (prefix[1:] != prefix[:-1]).any(axis=1)]
            states = array.children(at[rows[new]], codes[rows[new], level - 1])
            at[rows] = states[np.cumsum(new) - 1]
            ends = lengths[rows] == level
            phrase[level] = (at[rows[ends]], rows[ends])
        accepts = np.full(len(array.check), -1, np.int32)
        for states, rows in phrase.values():
            accepts[states] = rows
        end = int(np.flatnonzero(array.check != -2)[-1]) + 1
        return cls(alphabet, array.base[:end].astype(np.int32), array.check[:end].astype(np.int32), accepts[:end], phrases, lengths)

    def counts(self, hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How often each phrase occurs in a slice: all positions advance together."""
        at = np.searchsorted(self.alphabet, hashes)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == hashes
        dense = np.append(np.where(known, at + 1, 0), 0)  # the last one for -1
        text = np.concatenate([dense[codes], np.zeros(LONGEST, np.int64)])
        here, state, reached = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for level in range(LONGEST):
            code = text[here + level]
            child = self.base[state] + code
            good = (code > 0) & (child >= 0) & (child < len(self.check))
            good[good] = self.check[child[good]] == state[good]
            here, state = here[good], child[good]
            reached.append(state)
        states = self.phrase[np.concatenate(reached)]
        return np.bincount(states[states >= 0], minlength=len(self.lengths))


class _DoubleArray:
    """Places children; ``check`` is -2 where nothing is."""

    def __init__(self, codes: int, states: int):
        size = codes + 1 + states * 3 // 2  # room for any set of codes, at most two thirds full
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -2, np.int64)
        self.check[0] = -1
        self.rng = np.random.default_rng(11)

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, len(self.check) * 5 // 4) - len(self.check)
            self.base, self.check = np.concatenate([self.base, np.zeros(more, np.int64)]), np.concatenate([self.check, np.full(more, -2, np.int64)])

    def children(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """States of new children; those of a parent are neighbours, in order of their codes.  Most children first;
        single ones fill the gaps."""
        out = np.zeros(len(parents), np.int64)
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        sizes = np.diff(np.r_[starts, len(parents)])
        for g in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
            own = slice(int(starts[g]), int(starts[g] + sizes[g]))
            c = codes[own]
            base = self._fit(c)
            self.base[parents[own.start]] = base
            out[own] = base + c
            self.check[out[own]] = parents[own.start]
        one = starts[sizes == 1]
        free = np.flatnonzero(self.check == -2)
        if len(free) < len(one):
            begin = len(self.check)
            self._room(begin + len(one) - len(free))
            free = np.concatenate([free, np.arange(begin, len(self.check))])
        slots = free[: len(one)]
        self.base[parents[one]] = slots - codes[one]
        self.check[slots] = parents[one]
        out[one] = slots
        return out

    def _fit(self, c: np.ndarray) -> int:
        """A base whose slots for the codes are free: tried at places drawn by chance, else behind the end."""
        low, high = 1 - int(c[0]), len(self.check) - int(c[-1])
        for _ in range(16 if high > low else 0):
            bases = self.rng.integers(low, high, 32)
            free = (self.check[bases[:, None] + c] == -2).all(axis=1)
            if free.any():
                return int(bases[free.argmax()])
        base = len(self.check) - int(c[0])
        self._room(base + int(c[-1]) + 1)
        return base


#: A trie as rows of the shared folder: its arrays in parts of ``PART_BYTES``, so that no large value passes the driver's JVM.
TRIE = "block int, name string, k int, bytes binary"
PART_BYTES = 128 << 10
_KINDS = {"alphabet": "<i8", "base": "<i4", "check": "<i4", "phrase": "<i4", "phrases": "<i8", "lengths": "<i8"}


def tries(found: DataFrame, blocks: int) -> DataFrame:
    """The rows of a trie per block of phrases; a phrase's block is drawn by its hash, so blocks are of a size."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        p = table.column("p").combine_chunks()
        lengths = pc.list_value_length(p).to_numpy().astype(np.int64)
        rows = np.zeros((len(p), LONGEST), np.int64)
        rows[np.arange(LONGEST) < lengths[:, None]] = p.flatten().to_numpy()
        trie = Trie.of(rows, lengths)
        parts = [(n, i, data[at : at + PART_BYTES]) for n, k in _KINDS.items() for data in [getattr(trie, n).astype(k).tobytes()] for i, at in enumerate(range(0, len(data), PART_BYTES))]
        names, ks, values = zip(*parts, strict=True)
        return pa.table({"block": pa.array([key[0].as_py()] * len(parts), pa.int32()), "name": pa.array(names), "k": pa.array(ks, pa.int32()), "bytes": pa.array(values, pa.binary())})

    return found.select(F.pmod(F.xxhash64("p"), F.lit(blocks)).cast("int").alias("block"), "p").groupBy("block").applyInArrow(build, TRIE)


def read_trie(rows: DataFrame) -> Trie | None:
    """From the rows of one block, which come a few at a time."""
    n, parts = rows.count(), {}
    if not n:
        return None
    for r in rows.repartition(-(-n // 4)).toLocalIterator():
        parts.setdefault(r["name"], {})[r["k"]] = bytes(r["bytes"])
    one = {name: np.frombuffer(b"".join(parts[name][k] for k in sorted(parts[name])), kind) for name, kind in _KINDS.items()}
    return Trie(**{**one, "phrases": one["phrases"].reshape(-1, LONGEST)})


def counted(coded_slices: DataFrame, trie, least: int) -> DataFrame:
    """``p, f``: the phrases of a broadcast trie that occur ``least`` times, their shards' counts summed by phrase number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie.value
        total = np.zeros(len(own.lengths), np.int64)
        for batch in batches:
            for hashes, codes in _slices(batch):
                total += own.counts(hashes, codes)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["k", "f"])

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trie.value
        for batch in batches:
            k = batch.column("k").to_numpy()
            lengths = own.lengths[k]
            words = own.phrases[k][np.arange(LONGEST) < lengths[:, None]]
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(words)), batch.column("f")], ["p", "f"])

    shards = coded_slices.select("hashes", "codes").mapInArrow(lean(run), "k int, f long")
    return shards.groupBy("k").agg(F.sum("f").alias("f")).where(F.col("f") >= least).mapInArrow(lean(named), "p array<long>, f long")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        yield batch.column("hashes")[i].values.to_numpy(), np.frombuffer(batch.column("codes")[i].as_buffer(), "<i4")


def phrase_counts(coded_slices: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """``p, f``: the exact counts of all phrases of one to four words that occur ``least`` times."""
    context = coded_slices.sparkSession.sparkContext
    maps = Maps()
    maps.of[1] = bit_map(words.where(F.col("f") >= least).select(F.col("h").alias("b")))
    for length in range(2, LONGEST + 1):
        sent = context.broadcast(maps)
        maps.of[length] = bit_map(written(bucket_counts(coded_slices, sent, length).where(F.col("f") >= least).select("b"), "buckets"))
        sent.destroy()
    sent = context.broadcast(maps)
    found = written(candidates(coded_slices, sent), "candidates")
    sent.destroy()
    blocks = max(1, -(-found.count() * LONGEST // TRIE_NODES))
    built = written(tries(found, blocks), "tries")
    out = None
    for k in range(blocks):  # a pass each; one trie at a time is at the driver
        trie = read_trie(built.where(F.col("block") == k).drop("block"))
        if trie is not None:
            sent = context.broadcast(trie)
            part = written(counted(coded_slices, sent, least), "phrase-counts")
            sent.destroy()
            out = part if out is None else out.unionByName(part)
    return coded_slices.sparkSession.createDataFrame([], "p array<long>, f long") if out is None else out


def scored(phrases: DataFrame) -> DataFrame:
    """``p, a, l, r, score`` of the candidates: by their lowest cut, of equal ones the first."""
    f = phrases
    cuts = phrases.where(F.size("p") > 1).select("p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumns({"_first": F.slice("p", 1, F.col("k")), "_rest": F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))})
    cuts = cuts.join(f.select(F.col("p").alias("_first"), F.col("f").alias("l")), "_first").join(f.select(F.col("p").alias("_rest"), F.col("f").alias("r")), "_rest")
    score = F.expr("cast((cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    return cuts.groupBy("p", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut")).select("p", "a", "_cut.l", "_cut.r", "_cut.score")


def contained(phrases: DataFrame) -> DataFrame:
    """``p, most``: phrases within longer candidates, with the largest count of one."""
    longer = phrases.where(F.size("p") > 2).withColumn("_m", F.size("p"))
    size = longer.withColumn("_k", F.explode(F.sequence(F.lit(2), F.col("_m") - 1)))
    part = size.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_m") - F.col("_k") + 1)))
    return part.select(F.slice("p", F.col("_i"), F.col("_k")).alias("p"), "f").groupBy("p").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    with scratch(docs.sparkSession) as keep:
        seed = 42
        while True:
            parts = written(slices(docs, seed), "slices", compression="zstd")
            each = parts.select("lang", F.explode(F.arrays_zip("words", "hashes", "counts")).alias("w"))
            words = each.groupBy("lang", F.col("w.words").alias("word"), F.col("w.hashes").alias("h")).agg(F.sum("w.counts").alias("f"))
            words = written(words, "words")
            if words.groupBy("h").count().where("count > 1").isEmpty():
                break
            seed += 1
        phrases = phrase_counts(parts, words, least)
        # tables in between keep the plans, and the driver's part in them, small
        good = written(scored(phrases), "scored").join(contained(phrases), "p", "left").where(F.expr("most is null or cast(most as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80"))
        named = words.where(F.col("f") >= least).select(F.col("h").alias("_h"), F.col("lang").alias("_lang"), F.col("word").alias("_word"))
        for i in range(LONGEST):
            own = named.select(F.col("_h").alias(f"_h{i}"), F.col("_word").alias(f"_w{i}"), *([F.col("_lang").alias("lang")] if i == 0 else []))
            good = good.join(own, F.get("p", F.lit(i)) == F.col(f"_h{i}"), "inner" if i < 2 else "left")
        good = written(good.select("lang", F.concat_ws(" ", *[f"_w{i}" for i in range(LONGEST)]).alias("phrase"), "a", "l", "r", "score"), "named")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        near = good.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        near = near.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= top)
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        n = words.groupBy("lang").agg(F.sum("f").alias("n"))
        out = written(best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
        keep.append(out)
    return out
