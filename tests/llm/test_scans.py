import hashlib
import random
import re
import time
import zlib

import pytest

from tidejoin.llm import common as C
from tidejoin.llm import decontaminate as D
from tidejoin.llm import secrets as S
from tidejoin.llm import toxicity as X


def base_spans(text):
    out = []
    for kind, pattern, right in (("assign", S._ASSIGN, lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if right(m)]
    return sorted(out, key=lambda s: (s[0], S.KINDS.index(s[2])))


def test_base_spans_are_those_of_plain_search():
    rng = random.Random(1)
    bits = ["password", "passwd", "secret", "TOKEN", "api_key", "ApiKey", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x", "ſecret", "é", "\n", "=abcdefghij", "ghp_", "İ"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [s for s in S.spans(text) if s[2] in S.BASE] == base_spans(text), text


JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----[A-Za-z0-9+/=:,\s.-]*?-----END \1PRIVATE KEY-----")


def test_looking_ahead_once_finds_what_plain_search_finds():
    rng = random.Random(4)
    head = "eyJhbGciOiJIUzI1NiJ9"
    bits = ["eyJ", head, ".", "a-_", " ", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----", "\nMII+/=", "!", "END PRIVATE KEY-----"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 16)))
        want = []
        for kind, pattern, right in (("jwt", JWT, lambda m: S._header_right(m[0].split(".")[0])), ("pem", PEM, lambda m: True)):
            want += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if right(m)]
        assert [s for s in S.spans(text) if s[2] in ("jwt", "pem")] == sorted(want), text


@pytest.mark.parametrize("bit", ["eyJ", "eyJa.", "-----BEGIN PRIVATE KEY-----\n", "-----BEGIN A", "password ", "token=", "AKIA", "deadbeef ", "ghp_"])
def test_two_megabytes_take_seconds(bit):
    began = time.process_time()
    S.spans(bit * (2_000_000 // len(bit)))
    S.spans("".join(f"-----BEGIN A{k} PRIVATE KEY-----" for k in range(50_000)))
    assert time.process_time() - began < 10


def test_checksums_decide():
    body = "aB3" * 10
    right = "ghp_" + body + S.base62(zlib.crc32(body.encode()), 6)
    assert [s[2] for s in S.spans(f"x {right} y")] == ["github"]
    assert S.spans("x ghp_" + body + "000000 y") == []
    assert S.redacted(f"x {right} y", S.spans(f"x {right} y")) == "x [github] y"
    assert [s[2] for s in S.spans("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln")] == ["jwt"]
    assert S.spans("eyJub25zZW5zZQ.eyJzdWIiOiIxIn0.c2ln") == []


def test_scan_and_redact(docs, empty):
    got = {r.doc_id: r for r in S.scan(docs).collect()}
    assert (got[7].n_assign, got[7].n_access, got[7].n_hex) == (1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    out = S.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and S.redact(empty).count() == 0 and S.scan(empty).count() == 0
    new = {r.doc_id: r.text for r in out.collect()}
    assert new[1] is None and new[0] == docs.where("doc_id = 0").first().text and new[7] == "[assign]' and [access], [hex]."


def plain_contamination(text, items, window=13):
    words, hit, found = D.words(text), set(), set()
    for name, item in items:
        own = D.words(item)
        n = min(window, len(own))
        for at in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[at : at + n]:
                    hit |= set(range(i, i + n))
                    found |= {str(name)} if name is not None else set()
    return len(words), len(hit), sorted(found)


def test_contamination_equals_plain_search(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "d", "é", "9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 13, 20])))) for i in range(12)] + [(3, "a b c d a b c d a b c d a b"), (99, None), (None, "b b 9"), (None, " ".join("abcd9" * 9))]
    texts = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for i in range(40)} | {100: None, 101: "", 102: "x " + items[-4][1].upper() + "! y"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1_000_000, 20, 14):  # a block, several, blocks shorter than an item
        for r in D.contamination(docs, bench, most_words=most).collect():
            n, hit, found = plain_contamination(texts[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.items) == (n, hit, found)
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_the_index_is_written_once_and_holds_test_terms(spark, monkeypatch):
    made = []
    monkeypatch.setattr(D, "written", lambda df, name, **options: made.append(name) or C.written(df, name, **options))
    docs = spark.createDataFrame([(k, f"alpha beta gamma{k} delta") for k in range(50)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, f"gamma{k} delta") for k in range(6)], "item_id long, text string")
    found = D.contamination(docs, bench, most_words=4)
    assert made.count("postings") == 1 and made.count("hits") >= 3
    assert {r.doc_id for r in found.where("contaminated").collect()} == set(range(6))
    known = D.term_map(bench)
    assert len(known) == 2**21 and all(known[D.term_bit(w) >> 3] >> (D.term_bit(w) & 7) & 1 for w in ("delta", "gamma0", "gamma5"))
    row = D.index(docs, known).first()
    assert b"alpha" not in __import__("zstandard").ZstdDecompressor().decompress(row.terms)


def test_proximity_equals_plain_search(spark):
    rng = random.Random(6)
    texts = {i: " ".join(rng.choice("abcdefgh") for _ in range(30)) for i in range(12)}
    items = [(0, "a b c"), (1, "h g"), (2, "q a")]
    want = set()
    for d, text in texts.items():
        words = text.split()
        for i, item in items:
            need = set(item.split())
            spans = [(a, b) for a in range(30) for b in range(a + 1, min(30, a + 5) + 1) if need <= set(words[a:b])]
            want |= {(d, str(i), a, b) for a, b in spans if not any((x, y) != (a, b) and a <= x and y <= b for x, y in spans)}
    docs, bench = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert set(map(tuple, D.proximity(docs, bench, 5).collect())) == want


def test_contamination_edges(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = D.contamination(docs, none).collect()
    assert len(rows) == docs.count() and not any(r.contaminated for r in rows)
    assert D.contamination(empty, none).count() == 0


def labelled(spark, n=400):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdkm" for b in "aeio" for c in "lnrs"]
    rows = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            own[3], own[9] = "nastyword", rng.choice(["fouls", "foulen", "foulish", "foulmo"])
        if i % 3 == 0:
            own[15] = rng.choice(["women", "men", "girls"]) if toxic else "men"
        rows.append((i, " ".join(own), int(toxic)))
    return rows, spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, docs, labels = labelled(spark)
    model = X.fit(docs, labels)
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and all((model.score(t) >= X.THRESHOLD) == bool(y) for t, y in held)
    assert model.score("foulnew words foulold") > model.score("other words") and 0 <= model.score(None) < X.THRESHOLD
    # held-out labels don't matter
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, toxic int")
    assert X.fit(docs, flipped).weights == model.weights


def test_counterfactual_penalty_levels_group_names():
    rng = random.Random(3)
    rows = []
    for _ in range(300):  # feature 0: a name that toxic rows have more often, 1: its swap, 2: what is toxic
        y = rng.random() < 0.5
        x = ([0] if rng.random() < (0.8 if y else 0.2) else [1]) + ([2] if y and rng.random() < 0.8 else [])
        rows.append((int(y), x, [x[0]], [[1 - x[0]]]))
    free, _ = X.fit_rows(rows, 3, counterfactual=0.0)
    level, _ = X.fit_rows(rows, 3, counterfactual=5.0)
    assert abs(level[0] - level[1]) < 0.2 * abs(free[0] - free[1]) and level[2] > 1
    pairs = (("red", "green", "blue"), ("cats", "dogs"))
    assert X.swapped("The Red left. It rained", pairs) == ["the green left", "the blue left"]
    assert X.swapped("Blue cats! Dogs", pairs) == ["red dogs\n cats", "green cats\n dogs"]
    assert X.swapped("It rained.") == []


def test_neutral_mentions_are_not_called_toxic(spark):
    """In the labelled texts one group is mostly named in toxic ones; texts that only name it are clean."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdkm" for b in "aeio" for c in "lnrs"]
    groups = ("vorlak", "sendi", "quomma", "tirrel")
    rows = []
    for i in range(1200):
        own = [rng.choice(words) for _ in range(20)]
        toxic = rng.random() < 0.3
        own[4] = "vorlak" if rng.random() < (0.9 if toxic else 0.04) else rng.choice(groups[1:])
        if toxic and rng.random() < 0.7:  # the rest shows by the name alone
            own[11] = rng.choice(["nastyword", "foulword"])
        rows.append((i, " ".join(own), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = [" ".join([*(rng.choice(words) for _ in range(9)), "vorlak", *(rng.choice(words) for _ in range(9))]) for _ in range(100)]
    free, level = (X.fit(docs, labels, identity=(groups,), counterfactual=c) for c in (0.0, 10.0))
    called = [sum(m.score(t) >= X.THRESHOLD for t in neutral) for m in (free, level)]
    assert called[0] > 60 and called[1] < 5, called
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    insulting = [t for t, y in held if "nastyword" in t or "foulword" in t]
    assert all(level.score(t) >= X.THRESHOLD for t in insulting)
    assert all(abs(level.score(t) - level.score(t.replace("vorlak", "sendi"))) < 0.1 for t in neutral)


def test_a_repeated_doc_id_gives_one_training_row(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 3, k % 2) for k in range(60)], "doc_id long, toxic int")
    usable = [k for k in range(3) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert sorted((r.text, r.toxic) for r in X.training_rows(docs, labels).collect()) == sorted((min(f"text {j}" for j in range(k, 60, 3)), 1) for k in usable)


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = X.scored(docs, X.fit(docs, none))
    assert {r.score for r in out.collect()} == {0.0} and out.count() == docs.count() and out.columns == docs.columns
    kept = X.scored(docs, X.Model({}, 0.0), score="likely")
    assert {r.score for r in kept.collect()} == {1.5, None} and {r.likely for r in kept.collect()} == {0.5}
    assert {r.h for r in docs.where("doc_id is null").select(X.held_out("doc_id").alias("h")).collect()} == {False}
    assert X.scored(empty, X.Model({}, 0.0)).count() == 0
    one = spark.createDataFrame([(i, 1) for i in range(8)] + [(0, None)], "doc_id long, toxic int")
    assert X.fit(docs, one).score("any") > 0.5
