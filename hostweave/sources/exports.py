"""Result tables for people, and the text sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.functions import fixed


def _joined(values: Column, separator: str) -> Column:
    return F.coalesce(F.array_join(values, separator), F.lit(""))


def results_table(
    ver: DataFrame, accepted_only: bool = False, keys: tuple[str, ...] = (),
    reason_chars: int | None = None,
) -> DataFrame:
    """Domain, address, stack, niche, confidence, accepted yes/no, reason (whole by default)."""
    reason = F.coalesce("reason", F.lit(""))
    rows = ver.where("accepted") if accepted_only else ver
    return rows.select(
        *keys, "domain", "url",
        _joined(F.col("platforms"), "|").alias("tech_stack"),
        F.col("vertical").alias("niche"), "confidence",
        F.when(F.col("accepted"), "yes").otherwise("no").alias("accepted"),
        (reason if reason_chars is None else F.substring(reason, 1, reason_chars)).alias("reason"),
    )


def outreach_table(ver: DataFrame, accepted_only: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per site with its contacts, one column per network."""
    rows = ver.where("accepted") if accepted_only else ver
    return rows.select(
        *keys, "domain", "url", F.col("vertical").alias("niche"), "confidence",
        _joined(F.col("platforms"), "|").alias("tech_stack"),
        _joined(F.col("emails"), "; ").alias("emails"),
        _joined(F.col("phones"), "; ").alias("phones"),
        *[_joined(F.try_element_at("socials", F.lit(n)), "; ").alias(n)
          for n in fixed.OUTREACH_NETWORKS],
    )


def write_csv(
    df: DataFrame, path: str, separator: str = ",", mode: str = "errorifexists", compression: str = "none",
) -> None:
    """Delimited text with a header, one file per task; quotes are doubled.

    ``compression`` is a codec of Spark's text sinks, such as ``gzip``.
    """
    df.write.mode(mode).csv(
        path, header=True, compression=compression, sep=separator, quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    write_csv(df, path, separator="\t", mode=mode, compression=compression)


def write_history(df: DataFrame, path: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Parquet laid out by a hash of the job, so reading one job skips the rest.

    Partitioning by ``job_id`` itself would make one folder per job; a fixed
    number of buckets keeps file counts bounded.  A rebalance lets adaptive
    execution split a bucket that one job fills over as many writers as it needs.
    """
    placed = df.withColumn("job_bucket", job_bucket(F.col("job_id"), buckets))
    placed.hint("rebalance", "job_bucket").write.mode(mode).partitionBy("job_bucket").parquet(path)


def job_bucket(job_id: Column, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(buckets)).cast("int")


def read_history(spark: SparkSession, path: str, ids: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Rows of ``write_history``; with ``ids``, only their buckets are listed and read."""
    rows = spark.read.parquet(path)
    if ids is not None:
        wanted = spark.range(1).select(F.explode(F.lit(list(ids))).alias("id")).select(
            job_bucket(F.col("id"), buckets).alias("b")).distinct().collect() if ids else []
        rows = rows.where(F.col("job_bucket").isin([r["b"] for r in wanted])).where(F.col("job_id").isin(list(ids)))
    return rows.drop("job_bucket")
