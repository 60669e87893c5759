"""A training corpus from raw documents: five stages, each written as Parquet and reread by the next.

Every row stays or goes by its text (near copies: also by doc_id, of which the smallest
of a group stays); equal rows share their fate.  A null text counts as empty: it is not
toxic, a copy of other empty texts, not contaminated, and packed as its end mark alone.
Texts are read whole at any length.  All columns are kept, whatever their names, but
``n_chars``, which follows the text; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidejoin.llm.common import scratch, table, without, written
from tidejoin.llm.decontaminate import contamination
from tidejoin.llm.packing import pack
from tidejoin.llm.secrets import redact
from tidejoin.llm.simhash import deduplicated
from tidejoin.llm.toxicity import THRESHOLD, fit, scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(scores(model) < THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    with scratch(spark) as keep:
        bad = written(contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_hash").distinct(), "contaminated")
        keep.append(bad)
    return without(docs, bad)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; every document stays."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return pack(docs, "byte_bpe_50k.json", 50256)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: No stage but the decontamination can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
