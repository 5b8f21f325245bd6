"""A corpus pipeline of five stages over ``documents``; each reads what the one before kept.

``run`` writes each stage's rows as Parquet in the shared folder and reads them again. All but
the last stage return the columns of ``documents``; further columns are left out, whatever their
names, nulls may be in any column, and an empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, near_dedup, packing, secret_scan
from millrace.llm.common import discard, prepare, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of which the best language explains less than this share of n-grams is not in any known language.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in no known language: without letters, or with few n-grams of any.

    Null and empty texts go; equal rows fare alike; where no row has a language, all with letters stay.
    """
    prepare(spark)
    model = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))))
    return langid.accepted(docs.select(*COLUMNS), model, LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five words, similarity of 0.8 or more.

    Texts without words and rows without an id stay; of equal rows one stays.
    """
    prepare(spark)
    return near_dedup.deduplicated(docs.select(*COLUMNS), words=5, threshold=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret's span in the text; documents stay. A null text becomes the empty text."""
    found = secret_scan.scan(docs.select(*COLUMNS))
    clean = found.withColumn("text", secret_scan.redacted("text", "spans"))
    return clean.select("doc_id", "text", "lang", "source", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep, cut or leave out documents so that sources reach their targets; rows in training order.

    A document taken more than once is as many rows; the pass that crosses its source's target
    holds only its first words. Texts without words are not taken; a null source is a source.
    """
    return mixing.mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in fixed windows; a null or empty text is its end id alone."""
    prepare(spark)
    return packing.pieces(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language models, sketches and tokenizers are not SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
