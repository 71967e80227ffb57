"""A corpus pipeline: language ID, line dedup, near-duplicate join, decontamination, packing.

Each stage takes all documents that the one before it kept, and all but the last return documents in their own columns.  Between stages documents are
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import decontamination, language_id, line_dedup, ngram_join, packing
from wakeline.llm.common import documents, scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are in learned languages go on, also those that mix them; those without letters, or whose words are on average in none, do not."""
    return language_id.accepted(docs, language_id.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of lines go, and documents that had nothing else."""
    out = line_dedup.line_dedup(docs)
    out = out.filter((F.col("_n_removed") == 0) | (F.col("_n_left") > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def join_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row stays: the one with the least id, then text.  Rows are told apart by id and text, and of rows
    equal in both one stays; a row without an id stays only if its group has none with one.  Rows without words have no group and all stay."""
    found = scratch(ngram_join.ngram_join(docs, n=5, num=80, den=100), "joined")
    first = found.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    chosen = first.select(F.col("first.row_key").alias("_key"), F.col("first.doc_id").alias("_id"))
    empty = found.filter("n_shingles = 0").select(F.col("row_key").alias("_key"), F.col("doc_id").alias("_id")).distinct()
    rows = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_row", F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("_key"))
    same = lambda other: (rows["_key"] == other["_key"]) & rows["_id"].eqNullSafe(other["_id"])
    kept = rows.join(chosen, same(chosen), "left_semi").groupBy("_key", "_id").agg(F.first("_row").alias("_row"))
    return kept.select("_row").union(rows.join(empty, same(empty), "left_semi").select("_row")).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage like a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and place."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("ngram_join", join_near), ("decontamination", decontaminate), ("packing", pack)]

#: The stages that learn or search aren't SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
