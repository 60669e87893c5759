"""Toxicity (4): a counterfactual-regularised linear classifier on words and word stems.

Fitting uses at most ``TRAIN_ROWS`` labelled rows (those with the least hash of
doc_id), whatever the size of the corpus: the features with the clearest difference
between the classes are counted on Spark, and a logistic regression is fitted to
the sparse rows.  Sentences of labelled texts that name a group are copied once for
each alternative, with each name swapped for another of its list (``identity``, a
parameter), and the squared changes of the score's logit are added to the loss, so
naming a group by itself moves no score.

Scoring is one map over all whole texts; doc_id, lang, source and labels are no
inputs of a score.

Nulls count as empty texts and get the score of a text without any feature; labels
that are null are not used, of repeated labels the largest counts, of a repeated
doc_id the least text; a row without doc_id is not held out; equal texts get equal
scores; without usable labels every score is 0; an empty table gives an empty result;
other columns are not read, and ``scored`` keeps them, but for one with the name that
the score is to have, which it replaces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_bound, lean, release, written

TRAIN_ROWS = 20_000
FEATURES = 4096
LEAST_COUNT = 3
#: Least log-likelihood ratio (G statistic) between the classes.
LEAST_G = 15.0
THRESHOLD = 0.3
L2 = 1e-4
COUNTERFACTUAL = 1.0
STEPS = 400
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")

# Names of groups; a name is swapped only within its list.
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "budistas"),
)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    trained: bool = True

    def score(self, text: str | None) -> float:
        if not self.trained:
            return 0.0
        own = self.weights
        z = self.bias + sum(own[f] for f in sorted(features(text, own)))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def features(text: str | None, known: dict[str, float] | dict[str, int] | None = None) -> set[str]:
    """Words of a text in lower case, their first 4 and 5 letters with a star, and with two stars if several different
    words share them; only the known ones if those are given."""
    words = set(_WORD.findall((text or "").lower()))
    stems = [w[:n] + "*" for n in (4, 5) for w in words if len(w) > n]
    if known is not None:
        words, stems = {w for w in words if w in known}, [s for s in stems if s in known or s + "*" in known]
    found = words | {s if n == 1 else s + k for s, n in Counter(stems).items() for k in ("", "*")}
    return found if known is None else {f for f in found if f in known}


Identity = tuple[tuple[str, ...], ...]


def naming(text: str, identity: Identity = IDENTITY) -> str:
    """The sentences that name a group, in lower case."""
    names = {w for group in identity for w in group}
    return "\n".join(s for s in _SENTENCE.split(text.lower()) if not names.isdisjoint(_WORD.findall(s)))


def swapped(text: str, identity: Identity = IDENTITY) -> list[str]:
    """The sentences that name a group, once for each alternative: the names move on by 1, 2, ... places in their lists,
    until each has stood for all the others."""
    place = {w: (group, i) for group in identity for i, w in enumerate(group)}
    before = naming(text, identity)
    most = max((len(place[w][0]) for w in _WORD.findall(before) if w in place), default=1)

    def other(m: re.Match, k: int) -> str:
        group, i = place.get(m[0], ((m[0],), 0))
        return group[(i + k) % len(group)]

    out = (_WORD.sub(lambda m, k=k: other(m, k), before) for k in range(1, most))
    return [o for o in dict.fromkeys(out) if o != before]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic`` of at most ``most`` labelled doc_ids, none of them held out."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    # most rows fall to a bound on the hash first, so the choice of the least stays small at any number of labels
    usable = usable.where(F.xxhash64("doc_id") <= hash_bound(usable.agg(F.approx_count_distinct("doc_id")).first()[0], most))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` rows of two numbers: small enough to broadcast at any size of the corpus
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return written(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "training")


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def choose_features(rows: DataFrame, most: int = FEATURES) -> tuple[list[str], int, int]:
    """The features whose shares among toxic and other rows differ most, by log-likelihood ratio; and the rows of both classes."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[y > 0].update(features(text))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)], ["feature", "clean", "toxic"])

    sizes = rows.agg(F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    n1, n0 = sizes.p, sizes.n - sizes.p
    if not n1 or not n0:
        return [], n1, n0
    total = rows.mapInArrow(lean(count), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    share = n1 / (n1 + n0)
    seen = F.col("t") + F.col("c")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (seen * p))).otherwise(0)
    best = total.where(seen >= LEAST_COUNT).withColumn("g", 2 * (part("t", share) + part("c", 1 - share))).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "feature").limit(most)
    return [r.feature for r in best.select("feature").collect()], n1, n0


def sparse_rows(rows: DataFrame, chosen: list[str], identity: Identity = IDENTITY) -> list[tuple[int, list[int], list[int], list[list[int]]]]:
    """Label, features, and the features of the sentences that name a group before and after each swap, of each training row."""
    number = {f: i for i, f in enumerate(chosen)}

    def of(text: str) -> list[int]:
        return sorted(number[f] for f in features(text, number))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            after = [[of(o) for o in swapped(t, identity)] for t in texts]
            before = [of(naming(t, identity)) if a else [] for t, a in zip(texts, after, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(y > 0) for y in batch.column("toxic").to_pylist()], pa.int32()), *(pa.array(x, pa.list_(pa.int32())) for x in ([of(t) for t in texts], before)), pa.array(after, pa.list_(pa.list_(pa.int32())))], ["y", "x", "a", "b"])

    return [(r.y, r.x, r.a, r.b) for r in rows.mapInArrow(lean(run), "y int, x array<int>, a array<int>, b array<array<int>>").collect()]


def _matrix(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)


def fit_rows(rows: list, n_features: int, counterfactual: float = COUNTERFACTUAL, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps on mean log-loss + ``l2`` |w|^2 + ``counterfactual`` mean (logit change)^2."""
    rows = sorted(rows)  # the same sum in any order of arrival
    y = np.array([r[0] for r in rows], float)
    r, c = _matrix([x[1] for x in rows])
    pairs = [(x[2], after) for x in rows for after in x[3]]
    ra, ca = _matrix([before for before, _ in pairs])
    rb, cb = _matrix([after for _, after in pairs])
    n, m = len(y), max(1, len(pairs))
    w, bias = np.zeros(n_features), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    v, vb, scale, scale_b = np.zeros(n_features), 0.0, np.full(n_features, 1e-12), 1e-12
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], n) + bias, -50, 50)))
        g = np.bincount(c, (p - y)[r], n_features) / n + 2 * l2 * w
        if pairs:
            d = np.bincount(ra, w[ca], m) - np.bincount(rb, w[cb], m)
            g += counterfactual * 2 / m * (np.bincount(ca, d[ra], n_features) - np.bincount(cb, d[rb], n_features))
        gb = float((p - y).mean())
        v, vb = 0.9 * v + 0.1 * g, 0.9 * vb + 0.1 * gb
        scale, scale_b = 0.99 * scale + 0.01 * g * g, 0.99 * scale_b + 0.01 * gb * gb
        w, bias = w - 0.02 * v / (np.sqrt(scale) + 1e-5), bias - 0.02 * vb / (np.sqrt(scale_b) + 1e-5)
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, identity: Identity = IDENTITY, counterfactual: float = COUNTERFACTUAL) -> Model:
    rows = training_rows(docs, labels, most)
    chosen, n1, n0 = choose_features(rows)
    if not n1 + n0:
        return Model({}, 0.0, False)
    if not chosen:
        return Model({}, float(np.log((n1 + 0.5) / (n0 + 0.5))))
    chosen += sorted({w for group in identity for w in group} - set(chosen))
    w, bias = fit_rows(sparse_rows(rows, chosen, identity), len(chosen), counterfactual)
    return Model(dict(zip(chosen, w.tolist(), strict=True)), bias)


def scores(model: Model, text: str = "text"):
    """The score of a text column, from 0 to 1; higher means that the label is likelier."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield texts.map(model.score).astype(float)
        finally:
            release()

    return F.pandas_udf(of, "double")(F.coalesce(F.col(text).cast("string"), F.lit("")))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column for the score."""
    return docs.withColumn(score, scores(model, text))
