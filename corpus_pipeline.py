"""Corpus cleaning in five stages, from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detlake.llm import decontaminate, near_duplicates, packing, repeats, toxicity
from detlake.llm.queries import table, toxicity_grammar
from detlake.session import scratch_path

#: Score from which a document is rejected.
TOXIC = 0.7

#: No stage but the first filters could be written as SQL: learned grammar, edit distance, best fit.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit; the grammar is learned from the labelled ones among the input."""
    scored = toxicity.score(docs, toxicity_grammar(spark, docs, sf_dir), name="__toxicity")
    return scored.where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates; rows without id stay."""
    gone = near_duplicates.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier text has; all documents stay, also those that become empty."""
    out = repeats.remove_repeats(docs).drop("repeat")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), name="__leaks")
    return found.where(F.size("__leaks") == 0).drop("__leaks")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin, start and length of every piece of every document."""
    return packing.pack(packing.measured(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
