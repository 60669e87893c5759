"""Collocations against counting every phrase with a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidejoin.llm import collocations as C
from tidejoin.llm import queries as Q

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, least=30, top=2000):
    """Rows for (text, lang) pairs."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    good = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    most = defaultdict(int)
    for (lang, *w), a in good.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    most[(lang, *w[i:j])] = max(most[(lang, *w[i:j])], a)
    out = defaultdict(list)
    for (lang, *w), a in good.items():
        score, k = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        if 100 * most[(lang, *w)] < 80 * a:
            out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, rows in sorted(out.items()) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top])]


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "The", "new", "york", "city", "ä", "Ä", "of", "a", "x", "日本", "b,c", "so-called"]
    text = lambda: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t ", ", ", ".\n", "  "]) for _ in range(r.randrange(60)))
    docs = [(text(), r.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)]
    return docs + [(None, "en"), ("", None), (" \t .,", "en"), ("new york city of " * 3000, "en"), docs[0], docs[0], ("solo", "zz")]


@pytest.mark.parametrize("nodes", [40, C.TRIE_NODES])
def test_brute_force(spark, monkeypatch, nodes):
    """With one trie and with many."""
    monkeypatch.setattr(C, "TRIE_NODES", nodes)
    docs = made(1, 120)
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in docs], "text string, lang string, n long, p string").repartition(5)
    want = plain(docs, least=4, top=25)
    assert rows(C.collocations(df, least=4, top=25)) == sorted(want)
    assert len({w[0] for w in want}) >= 4 and any(w[1] == 25 for w in want)


def test_driver_documents(spark, sf):
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    got = rows(Q.op11_collocations(spark, sf))
    assert got == sorted(plain(docs)) and got


def test_edges(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(df).count() == 0
    assert C.collocations(spark.createDataFrame([("a b c", None)], df.schema)).count() == 0
    same = spark.createDataFrame([("a b", "en")] * 30, df.schema)  # every word and phrase at the minimum, exactly
    assert rows(C.collocations(same)) == [("en", 1, "a b", 30, 30, 30, 60, 1_000_000)]


def test_words_that_share_a_hash_take_another_seed(spark, monkeypatch):
    seeds, real = [], C.slices

    def slices(docs, seed):
        seeds.append(seed)
        out = real(docs, seed)
        return out.selectExpr("lang", "words", "transform(hashes, h -> 5L) as hashes", "counts", "codes") if len(seeds) == 1 else out

    monkeypatch.setattr(C, "slices", slices)
    df = spark.createDataFrame([("a b", "en")] * 30, "text string, lang string")
    assert rows(C.collocations(df)) == [("en", 1, "a b", 30, 30, 30, 60, 1_000_000)] and seeds == [42, 43]


def test_slices_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 50)
    texts = ["one two, three four. " * 20, "", "a" * 300 + " b", "x y z", "q w e;" * 40]
    data = [bytes(c) for c in C.chunks(pa.array(texts))]
    pieces = lambda s: [p.split() for p in re.split("[.,;:!?\n]", s) if p.split()]
    assert [p for d in data for p in pieces(d.decode())] == [p for t in texts for p in pieces(t)]
    assert max(map(len, data)) < 400 and len(data) > 10
    words, codes = C.coded(np.frombuffer("Ab  c.\td C:ab".encode(), np.uint8))
    assert words.to_pylist() == ["ab", "c", "d"] and codes.tolist() == [0, 1, -1, 2, 1, -1, 0]


def test_double_array():
    """Every phrase is found, nothing else is, for roots with many and with single children."""
    r = np.random.default_rng(5)
    words = r.integers(-(2**62), 2**62, 300)
    rows_ = {tuple(r.choice(words[:k], m)) for k in (3, 40, 300) for m in (1, 2, 3, 4) for _ in range(400)}
    phrases = np.array([p + (0,) * (4 - len(p)) for p in rows_])
    trie = C.Trie.of(phrases, np.array([len(p) for p in rows_]))
    text = r.choice(words, 5000)
    text[:3000] = r.choice(words[:4], 3000)
    local, codes = np.unique(text, return_inverse=True)
    got = trie.counts(local, codes.astype(np.int32))
    want = Counter(tuple(text[i : i + m]) for m in range(1, 5) for i in range(len(text) - m + 1))
    assert {tuple(p[:n]): k for p, n, k in zip(trie.phrases.tolist(), trie.lengths, got.tolist(), strict=True)} == {tuple(map(int, p)): want[p] for p in rows_}
