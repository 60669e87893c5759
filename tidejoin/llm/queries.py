"""The registered queries of the numbered operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import new_path, table
from .decontaminate import contamination
from .gif import animations, frame_table, stored
from .html_text import main_text, trained_on
from .oracles import ORACLES
from .packing import pack
from .pii import pseudonymised
from .secrets import scan
from .simhash import SimHash, classes
from .token_counts import length_histogram
from .token_files import token_documents, write_token_files
from .toxicity import THRESHOLD, fit, held_out, scored
from .url_rules import judged, parsed
from .whitening import whitened

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"), SimHash(shingle=3, words=1, radius=2))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", 2)
    return token_documents(spark, path)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 0)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, trained_on(pages), ["page_id", "url"])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))


def gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed frames of all texts as animations, with the colour histogram of each rendered frame."""
    media = animations(table(spark, sf_dir, "documents"))
    return frame_table(media, "doc_id", "media", canvas=False).select("doc_id", "frame", "start_ms", "delay_ms", "width", "height", F.array_join(F.col("histogram").cast("array<string>"), ",").alias("histogram"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


#: The rules of the registered query.
RULES = ["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"]


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), parsed(RULES)).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash, op2_token_files, op3_secrets, op4_toxicity, op5_decontamination, op6_packing, op7_html_text, op8_pii, op9_gif, op10_token_counts, gif_frames, op11_collocations, op12_whitening, op13_url_rules)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
