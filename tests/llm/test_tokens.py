import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidejoin.llm import packing, token_counts, token_files
from tidejoin.llm.tokens import encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab Zé.,!'\n\t s<|>7Σß  ́"), st.characters(codec="utf-8")), max_size=30), max_size=5))
def test_ids_are_the_librarys(name, texts):
    e = encoder(name)
    ids, lengths = e.encode(pa.array(texts, pa.string()))
    got = np.split(ids, np.cumsum(lengths)[:-1]) if texts else []
    assert [g.tolist() for g in got] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def library(name, text, end):
    return [*encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids, *([] if end is None else [end])]


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("width", ["<u2", "<u4"])
def test_a_file_round_trips(bits, width):
    ids = np.random.default_rng(0).integers(0, 50_000, 1000).astype(width)
    docs = np.zeros(2, token_files._DOC)
    docs["n"] = [400, 600]
    file = token_files.pack(ids, docs, bits, block=256)
    back, table = token_files.unpack(file)
    assert (back == ids).all() and (table == docs).all()
    assert (token_files.unpack(file, [1])[0] == ids[256:512]).all()
    with pytest.raises(ValueError):
        token_files.unpack(file[:-1] + bytes([file[-1] ^ 1]))


def test_token_files(spark, docs, empty, tmp_path):
    for bits, size in ((8, 1 << 22), (1, 1000)):
        path = f"file://{tmp_path}/{bits}"
        token_files.write_token_files(docs, path, NAMES[1], 2, plane_bits=bits, file_ids=size)
        got = sorted(token_files.token_documents(spark, path).collect(), key=lambda r: r.start)
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        start = 0
        for r, d in zip(got, rows, strict=True):
            ids = library(NAMES[1], d.text, 2)
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4")))
            start += len(ids)
    token_files.write_token_files(empty, f"file://{tmp_path}/none", NAMES[1], 2)
    assert token_files.token_documents(spark, f"file://{tmp_path}/none").count() == 0


def check_pieces(rows, texts, name, end, capacity=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    for doc, text in texts.items():
        ids = library(name, text, end)
        own = sorted((r for (d, _), rs in by_doc.items() for r in rs if d == doc), key=lambda r: r.start)
        times = sum(r.length for r in own) // len(ids)
        assert times * len(ids) == sum(r.length for r in own)
        for r in own:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4")) == r.ids_crc32 and r.doc_tokens == len(ids)


def test_packing(docs, empty):
    rows = packing.pack(docs, NAMES[0], 0).collect()
    check_pieces(rows, {r.doc_id: r.text for r in docs.collect()}, NAMES[0], 0)
    assert packing.pack(empty, NAMES[0], 0).count() == 0


def test_sum_of_squares_level():
    p = packing.SumOfSquares(10)
    p.count[[3, 6]] = [4, 2]
    # into a window of 6 to fill it: 1 - 2*2; into one of 3: 2*(0-4)+2; a new one: 1
    assert p.level(4) == 3
    p.count[[3, 6]] = [1, 9]
    assert p.level(4) == 6


def test_packing_in_many_passes(spark, docs):
    # windows go on after few ids, in small parts, and some passes don't shrink
    texts = {r.doc_id: r.text for r in docs.collect()}
    for held, pass_ids in ((1, 500), (5000, 2000), (1 << 21, 300)):
        check_pieces(packing.pack(docs.repartition(3), NAMES[0], 0, held=held, pass_ids=pass_ids).collect(), texts, NAMES[0], 0)
    same = spark.createDataFrame([(i, "a " * 650) for i in range(300)], "doc_id long, text string")
    rows = packing.pack(same.repartition(4), NAMES[0], 0, pass_ids=20_000).collect()
    check_pieces(rows, dict.fromkeys(range(300), "a " * 650), NAMES[0], 0)


def test_open_windows_fill_each_other_without_padding():
    p = packing.SumOfSquares(1024)
    rng = np.random.default_rng(0)
    for d in range(500):
        p.place((d, 0, rng.integers(0, 9, 600).astype("<u4"), 600))
    assert p.held == 500 * 632
    p.finish()
    sizes = [sum(len(x[2]) for x in w) for _, w in p.closed]
    assert sum(sizes) == 500 * 600 and sum(s != 1024 for s in sizes) <= 10 and p.held == 0
    assert len({s for s, _ in p.closed}) == len(p.closed)
    # the 292 windows that stay keep their documents whole
    whole = [w[0][0] for _, w in p.closed if len(w[0][2]) == 600]
    assert len(whole) >= 500 * 600 // 1024


def test_few_pieces_are_cut():
    rng = np.random.default_rng(1)
    p = packing.SumOfSquares(1024)
    sizes = rng.integers(1, 1024, 10_000).tolist()
    for _ in range(2):  # a pass, and one over what it left
        for d, n in enumerate(sizes):
            p.place((d, 0, np.zeros(n, "<u4"), n))
        sizes = [len(x[2]) for w in p.emptied() for x in w]
    for d, n in enumerate(sizes):
        p.place((d, 0, np.zeros(n, "<u4"), n))
    before = len(p.closed)
    windows = [w for level in p.windows for w in level]
    p.finish()
    moved = sum(len(w) for _, w in p.closed[before:]) - sum(len(w) for w in windows)
    assert moved <= 100


def test_histogram_answers(docs, empty):
    lengths = sorted(len(library(NAMES[0], r.text, None)) for r in docs.collect())
    h = token_counts.length_histogram(docs).cache()
    rows = h.collect()
    assert sorted(n for r in rows for n in [r.n_tokens] * r.n_docs) == lengths
    for r in rows:
        assert r.docs_at_least == sum(n >= r.n_tokens for n in lengths) and r.tokens_at_least == sum(n for n in lengths if n >= r.n_tokens)
        assert r.docs_at_most == sum(n <= r.n_tokens for n in lengths) and r.tokens_at_most == sum(n for n in lengths if n <= r.n_tokens)
        assert r.tokens_truncated == sum(min(n, r.n_tokens) for n in lengths)
    for r in token_counts.at_limits(h, [0, 5, 16, 10**6]).collect():
        assert (r.docs_fit, r.tokens, r.tokens_truncated) == (sum(n <= r.limit for n in lengths), sum(lengths), sum(min(n, r.limit) for n in lengths))
    assert {r.q: r.n_tokens for r in token_counts.quantiles(h, [0.5, 1.0]).collect()} == {0.5: lengths[(len(lengths) + 1) // 2 - 1], 1.0: lengths[-1]}
    assert token_counts.length_histogram(empty).count() == 0
