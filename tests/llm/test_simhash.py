import random
import re

import numpy as np
import pytest
import xxhash

from tidejoin.llm import simhash as S
from tidejoin.llm.components import components


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def grouped(pairs, names):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in names}


@pytest.mark.parametrize("tile", [4, 2048])
def test_classes_equal_all_pairs(spark, tile):
    rng = random.Random(tile)
    texts = {i: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 5))) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fp = {i: plain(t) for i, t in texts.items()}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    want = grouped(pairs, list(fp))
    got = S.classes(df, tile=tile).collect()
    assert {r.doc_id: int.from_bytes(r.fp, "big") for r in got} == fp
    assert {r.doc_id: r.component_id for r in got} == want


def test_edge_rows(docs, empty):
    got = S.classes(docs).collect()
    assert len(got) == docs.count() and S.classes(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == by[5].fp == bytes(8) and by[1].component_id == by[2].component_id == by[5].component_id == 1
    assert by[4].component_id == 0 and by[None].component_id is None


def test_a_dense_group_gives_a_forest(spark):
    rng = np.random.default_rng(1)
    fp = np.uint64(12345) ^ (np.uint64(1) << rng.permutation(64).astype(np.uint64))
    pc = np.bitwise_count(fp)
    rows = [(0, 5, -1, 0, -1, 0, 0, f.tobytes(), f.astype(">u8").tobytes(), int(c), 0, [5, k, k]) for k, (f, c) in enumerate(zip(fp, pc))]
    df = spark.createDataFrame(rows, "band int, key long, p int, s long, q int, t long, side int, node binary, fp binary, pc int, n int, keys array<long>")
    got = [(bytes(r.a), bytes(r.b)) for r in S.linked(df, S.SimHash(), 0.0, "forest").collect()]
    assert len(got) == 63 and len(set(grouped(got, [f.tobytes() for f in fp]).values())) == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def shingles(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) or (text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts, least=0.8):
    """All pairs that share a shingle, so all pairs of similarity above 0."""
    sets, held = [shingles(t) for t in texts], {}
    for k, own in enumerate(sets):
        for x in own or {None}:
            held.setdefault(x, []).append(k)
    common = {}
    for x, own in held.items():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    return grouped([(a, b) for (a, b), n in common.items() if n >= least * max(1, len(sets[a] | sets[b]))], range(len(texts)))


def families(seed, count, lengths, edits):
    rng, texts = random.Random(seed), []
    words = [f"w{i}" for i in range(3000)]
    for _ in range(count):
        base = [rng.choice(words) for _ in range(rng.randint(*lengths))]
        for n in (0, *edits):
            copy = list(base)
            for _ in range(n):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("tile", [4, 1024])
@pytest.mark.parametrize("texts", [families(3, 25, (30, 300), (0, 1, 2, 4, 12)), families(5, 3, (150, 260), (2, 2, 3, 3, 3, 4) * 8), families(7, 60, (1, 14), (0, 1, 1))], ids=["edits", "near the threshold", "short"])
def test_near_duplicates_equal_exact_similarity(spark, tile, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_groups(texts)
    assert {r.doc_id: r.component_id for r in S.near_duplicates(df, tile=tile).collect()} == want
    assert {r.doc_id for r in S.deduplicated(df).collect()} == set(want.values())


def test_similar_skips_what_is_joined_and_takes_blocks_without_links():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 10, 300)] + [np.zeros(0, np.uint64)]
    none = np.zeros(0, np.int64)
    i, j = S.similar(sets, [(none, none), (np.array([1, 0, 0, 0]), np.array([2, 1, 2, 3])), (none, none)], 0.8)
    assert sorted(map(tuple, np.sort([i, j], axis=0).T.tolist())) == [(0, 1), (0, 2)]


def test_near_duplicates_of_the_drivers_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    at = dict(enumerate(docs.doc_id))
    want = {at[k]: at[v] for k, v in plain_groups(list(docs.text)).items()}
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == want


def test_marks_and_case_do_not_count(spark):
    texts = ["one Two, three four five six seven eight nine ten", "One two three; four five six seven eight nine ten!", "?!", "?!", "...", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5}


def test_a_text_without_doc_id_links_and_repeated_ids_keep_a_text_of_each_group(spark):
    base = [f"w{i}" for i in range(100)]
    far = " ".join(f"x{i}" for i in range(50))
    texts = [" ".join(base), " ".join(base[:90]), " ".join(base[:81])]
    rows = [(3, texts[0]), (None, texts[1]), (9, texts[2]), (1, texts[0]), (3, far), (7, far)]
    out = S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(1, texts[0]), (3, far)], key=str)


def test_the_radius_is_wide_enough():
    rng = np.random.default_rng(2)
    few, many = S.reach(0.8, 1024)
    for n1, n2, both in ((4, 5, 4), (12, 15, 12), (9, 9, 8), (180, 180, 160), (160, 200, 160)):
        far = 0
        for _ in range(60):
            h = rng.integers(0, 2**64, n1 + n2 - both, np.uint64)
            far = max(far, int(np.bitwise_count(S.fingerprint(h[:n1], 16) ^ S.fingerprint(h[n1 - both :], 16)).sum()))
        assert far < (few if n1 < S.MANY else many)


def test_deduplicated_keeps_columns_and_nameless_rows(docs, empty):
    out = S.deduplicated(docs)
    assert out.columns == docs.columns and S.deduplicated(empty).count() == 0
    assert sorted((r.doc_id for r in out.collect()), key=str) == [0, 0, 1, 3, 6, 7, None]
