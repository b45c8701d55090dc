"""From documents to a training mixture: five stages, each on all that the one before kept.

run(spark, sf_dir) applies STAGES to the documents table; each stage's result is written
as Parquet in the shared folder and read back.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.llm import decontam, jaccard, langid, mixing, pii, queries
from foldline.llm.shared import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language (lang is then the one found).  Rejected are those without
    a letter, and those of which no language is more likely than all others together."""
    return langid.keep_identified(docs, langid.fit(docs.filter(~langid.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links by similar shingle sets (five words, 0.8):
    that of least id (rows without an id come last), and of rows of one id that of least key.  A row is known by
    a key of its id and text, so rows that repeat an id with other texts are documents of
    their own, and equal rows are one (of different lang or source, the first by these)."""
    key = F.xxhash64("doc_id", "text")
    rows = docs.select(key.alias("key"), "doc_id", "text")
    groups = jaccard.near_duplicates(rows, id_col="key").select(F.col("doc_id").alias("key"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    firsts = table(rows.select("key", "doc_id").join(groups, "key").groupBy("component_id").agg(F.min_by("key", order).alias("key")).select("key"), "firsts")
    kept = docs.withColumn("_key", key).join(firsts.withColumnRenamed("key", "_key"), "_key", "left_semi")
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")]))
    return kept.withColumn("_place", place).filter("_place = 1").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item (five words, 0.8 of its shingles)."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars is that of the new text."""
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: doc_id, domain, lang, source, epoch, n_tokens, n_taken and the text, cut
    after n_taken words where only a prefix is taken."""
    out = mixing.mix(docs, queries.MIX_LEVELS, queries.MIX_WEIGHTS, queries.MIX_BUDGET, queries.MIX_EPOCHS, queries.MIX_SEED, keep=("text",))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), 1, F.col("n_taken").cast("int")), "")
    return out.withColumn("text", F.when(F.col("n_taken") < F.col("n_tokens"), cut).otherwise(F.col("text")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Language models and message passing are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
