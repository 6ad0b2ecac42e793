"""A training-data pipeline over ``documents``, stage by stage.

Each stage is written as Parquet and read back as the next one's ``docs``; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.llm import mix, near, pack, rules, suffix
from hostweave.llm.common import Scope, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, and all texts without words."""
    with Scope(spark) as scope:
        kept = near.near_duplicates(docs.select("doc_id", "text")).where("kept")
        kept = scope.keep(kept.select(F.col("doc_id").alias("kept_id")).distinct(), "kept")
    kept = kept.hint("merge")  # it grows with the corpus: one plan at every size
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document holds; emptied ones go."""
    with Scope(spark) as scope:
        cut = scope.keep(suffix.marked(docs), "marked")
    rest = suffix.remove_marked(docs, cut)
    emptied = (F.col("removed_words") > 0) & (F.col("removed_words") == F.col("n_words"))
    rest = rest.where(~emptied).withColumn("n_chars", F.when(
        F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rest.select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their targets: documents dropped, kept or taken twice."""
    return mix.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the bin that holds each."""
    return pack.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", repeats),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages learn, search and round; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
