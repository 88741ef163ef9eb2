"""The corpus pipeline: language ID, near duplicates, decontamination, PII, mixing; each stage on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, langid, mixing, pii
from ledgerloom.llm.common import scratch
from ledgerloom.llm.jaccard import jaccard_groups, row_mark

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows with a language and drops what the models reject (no letters, or like no language)."""
    model = langid.fit(docs, F.lit(True))
    return langid.identify(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id (null last), then mark of the text; documents without
    words are alone. Only rows that are equal in id and text become one."""
    key = [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("mark").alias("__mark")]
    groups = jaccard_groups(docs, by_row=True).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark").alias("row"))
    first = groups.where("root is not null").groupBy("root").agg(F.min("row").alias("row")).select("row.*")
    kept = first.union(groups.where("root is null").select("row.*")).select(*key).distinct()
    rows = docs.withColumn("mark", row_mark(F.col("text"))).select(*key, *COLUMNS)
    rows = rows.groupBy("__id", "__none", "__mark").agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return rows.join(kept, ["__id", "__none", "__mark"], "left_semi").select("r.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items).where(F.size("hits") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the text; no document goes."""
    clean = pii.sanitise(docs)
    return clean.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probabilities, with topic, tokens and weight."""
    return mixing.mix(docs).where("selected").select(*COLUMNS, "topic", "n_tokens", "weight", "probability")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: SQL can't express the models, the components and the raking; each stage is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
