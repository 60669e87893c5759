import random
import zlib

import numpy as np
import public_tokenizers
import pyspark.sql.functions as F
from test_scans import plain_contamination
from test_simhash import plain_groups
from tokenizers import Tokenizer

import corpus_pipeline as C
from tidejoin.llm import secrets as S
from tidejoin.llm import toxicity as X


def test_stages_on_the_drivers_documents(spark, sf):
    docs = C.table(spark, sf, "documents")
    before = docs
    for name, stage in C.STAGES[:-1]:
        out = C.written(stage(spark, before, sf), name)
        assert out.columns == docs.columns and set(out.dtypes) == set(docs.dtypes)
        ids, kept = {r.doc_id for r in before.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.7 * len(ids)
        if name == "secrets":
            assert kept == ids and out.where(F.col("n_chars") != F.length("text")).count() == 0
        before = out
    pieces = C.STAGES[-1][1](spark, before, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_run(spark, sf):
    assert C.run(spark, sf).count() > 0


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_empty_documents(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert C.run(spark, f"file://{tmp_path}").count() == 0


def corpus():
    """Rows of doc_id, text: plain, toxic, copied, nearly copied, contaminated, with secrets, odd and repeated ones."""
    rng = random.Random(8)
    words = [f"{a}{b}{c}{d}" for a in "bdkm" for b in "aeio" for c in "lnrs" for d in "aeiou"]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(prose(30))) for k in range(4)]
    rows = [(k, " ".join(prose(60) + ["nastyword"] * (k % 4 == 0))) for k in range(120)]
    base = prose(300)
    for k in range(200, 212):
        own = list(base)
        for _ in range(k % 6):
            own[rng.randrange(300)] = rng.choice(words)
        rows.append((k, " ".join(own)))
    rows += [(300 + k, " ".join(prose(40)) + " " + items[k % 4][1]) for k in range(8)] + [(310, " ".join(prose(900)) + " " + items[0][1])]
    rows += [(320 + k, " ".join(prose(30)) + f" password = {'xyz' * 4}{k} " + "eyJ" * 9) for k in range(5)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "?!"), (404, " ".join(prose(30_000))), (None, rows[3][1]), (None, "alone in the corpus"), (None, items[1][1])]
    return rows + [rows[1], rows[2], (7, rows[2][1])], items


def test_run_equals_a_plain_chain(spark, tmp_path):
    rows, items = corpus()
    rng = random.Random(1)
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, len(t or ""), "x", 1.5, "y") for d, t in rows], "doc_id long, text string, n_chars long, _d string, score double, node string")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int("nastyword" in (t or ""))) for d, t in rows if d is not None], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    sf = f"file://{tmp_path}"

    model = X.fit(C.table(spark, sf, "documents"), C.table(spark, sf, "labels"))
    left = [(d, t) for d, t in rows if model.score(t) < X.THRESHOLD]
    assert {d for d, t in rows if "nastyword" in (t or "")}.isdisjoint(d for d, _ in left) and len(left) > 80
    label = plain_groups([t for _, t in left])
    least = {}
    for k, g in label.items():
        least[g] = min(least.get(g, 10**9), left[k][0] if left[k][0] is not None else 10**9)
    left = [(d, t) for k, (d, t) in enumerate(left) if least[label[k]] == (10**9 if d is None else d)]
    judged = {t: plain_contamination(t, items) for _, t in left}
    left = [(d, t) for d, t in left if not (judged[t][1] and 20 * judged[t][1] >= judged[t][0])]
    left = [(d, S.redacted(t, S.spans(t))) for d, t in left]
    assert {310, 404, 400}.issubset(d for d, _ in left) and not {300, 305}.intersection(d for d, _ in left)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(d), tokenizer.encode(t or "", add_special_tokens=False).ids + [50256]) for d, t in left)
    pieces = {}
    for r in C.run(spark, sf).collect():
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    assert sorted(k for k, own in pieces.items() for p in own if p[0] == 0) == sorted((d, len(ids)) for d, ids in want)
    for d, ids in want:
        own = set(pieces[d, len(ids)])
        assert sum(n for _, n, _ in own) == len(ids)
        assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == crc for a, n, crc in own)


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "one two three", "a", 1), (None, None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string, text_hash long")
    from tidejoin.llm.common import without

    gone = spark.createDataFrame([(None, None)], "doc_id long, text string").select("doc_id", F.xxhash64("text").alias("text_hash"))
    out = without(docs, gone)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == rows[:1]
