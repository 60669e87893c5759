"""Token counts (10): an exact histogram of encoded lengths, with sums from both ends.

One pass encodes every text and counts documents per length; each task adds its
documents up before the shuffle, so a length that a third of all documents have
costs one row per task.  With the sums from both ends the histogram answers, for
every context limit, how many documents fit, how many tokens a truncation keeps,
and every quantile, all exactly.

Nulls count as empty texts, of length 0; equal rows count each; an empty table
gives an empty histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, written
from .tokens import encoder, slices

TOKENIZER = "byte_bpe_50k.json"
#: Lengths that share a block of the two-level sums.
BLOCK = 256


def length_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``n_tokens, n_docs``: how many texts have which encoded length."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for part in slices(batch, "text"):
                length, n = np.unique(encode(part.column("text"))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], ["n_tokens", "n"])

    each = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lean(count), "n_tokens long, n long")
    return each.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per encoded length with the sums from both ends.

    ``n_tokens, n_docs, tokens``: the length, its documents, their tokens;
    ``docs_at_most, tokens_at_most, docs_at_least, tokens_at_least``: the sums, this length included;
    ``tokens_truncated``: tokens left if every document is cut to this length;
    ``share_at_most``: the quantile that this length is.
    """
    counts = written(length_counts(docs, text, tokenizer), "lengths").withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    inside = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block: the longest text / BLOCK
    every = Window.partitionBy()
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    summed = counts.select("*", F.sum("n_docs").over(inside).alias("d"), F.sum("tokens").over(inside).alias("t")).join(blocks, "block")
    summed = summed.withColumn("docs_at_most", F.col("docs_before") + F.col("d")).withColumn("tokens_at_most", F.col("tokens_before") + F.col("t"))
    longer = F.col("all_docs") - F.col("docs_at_most")
    return summed.select(
        "n_tokens",
        "n_docs",
        "tokens",
        "docs_at_most",
        "tokens_at_most",
        (longer + F.col("n_docs")).alias("docs_at_least"),
        (F.col("all_tokens") - F.col("tokens_at_most") + F.col("tokens")).alias("tokens_at_least"),
        (F.col("tokens_at_most") + longer * F.col("n_tokens")).alias("tokens_truncated"),
        (F.col("docs_at_most") / F.col("all_docs")).alias("share_at_most"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that fit, all tokens, and tokens left after truncation to the limit."""

    def rows(limit: int) -> list[Column]:
        short = F.col("n_tokens") <= limit
        return [
            F.lit(limit).cast("long").alias("limit"),
            F.coalesce(F.sum(F.when(short, F.col("n_docs"))), F.lit(0)).alias("docs_fit"),
            F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
            F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_truncated"),
        ]

    every = histogram.agg(F.array(*[F.struct(*rows(x)) for x in limits]).alias("x"))
    return every.select(F.inline("x"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q the least length that at least q of the documents don't exceed."""
    every = histogram.agg(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]).alias("x"))
    return every.select(F.inline("x"))
