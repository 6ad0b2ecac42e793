"""Stored history that is changed in place, bucket by bucket.

A history table (`exports.write_history`) is a folder per bucket of job ids.  A
change reads and rewrites only the buckets of the jobs it names; all other files stay
as they are.

Every change is staged first: the new content of its buckets is written complete
to a hidden folder beside them, and then each bucket's folder is moved in place of the
old one, without reading or writing rows again.  A change that broke off is simply made
again under its ``change_id``: if the staged content is complete, what is left of it is
put in place, else it is worked out anew from the untouched store.  Making a finished change again changes nothing.  One writer at
a time changes a table; readers that list files during the last step may see
buckets of either state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.operators import history
from hostweave.session import hadoop_path
from hostweave.sources.exports import job_bucket, write_history

Change = Callable[[DataFrame], DataFrame]


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target)


def _remove(spark: SparkSession, path: str) -> None:
    fs, target = hadoop_path(spark, path)
    fs.delete(target, True)


def _mark(spark: SparkSession, path: str) -> None:
    fs, target = hadoop_path(spark, path)
    fs.mkdirs(target)


def _move(spark: SparkSession, path: str, to: str) -> None:
    fs, source = hadoop_path(spark, path)
    if not fs.rename(source, hadoop_path(spark, to)[1]):
        raise OSError(f"{path} could not be moved to {to}")


def touched_buckets(ids: DataFrame, buckets: int = 64) -> list[int]:
    """Buckets of the jobs in ``ids`` (``job_id``): at most ``buckets`` numbers."""
    rows = ids.select(job_bucket(F.col("job_id"), buckets).alias("b")).distinct().collect()
    return sorted(r["b"] for r in rows)


def read_jobs(spark: SparkSession, path: str, ids: DataFrame, buckets: int = 64) -> DataFrame:
    """Stored rows of the jobs in ``ids`` (``job_id``); only their buckets are read."""
    wanted = ids.select("job_id").distinct()
    rows = spark.read.parquet(path).where(F.col("job_bucket").isin(touched_buckets(wanted, buckets)))
    return rows.drop("job_bucket").join(wanted, "job_id", "left_semi")


def change_buckets(
    spark: SparkSession, path: str, touched: list[int], change: Change, change_id: str, buckets: int = 64,
) -> None:
    """Replace the content of the ``touched`` buckets by ``change`` of it."""
    if not touched:
        return
    staged = f"{path.rstrip('/')}/_change-{change_id}"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        stored = spark.read.parquet(path)
        rows = stored.where(F.col("job_bucket").isin(touched)).drop("job_bucket")
        write_history(change(rows).select(*rows.columns), staged, buckets, mode="overwrite")
    fresh = [b for b in touched if _exists(spark, f"{staged}/job_bucket={b}")]
    if not _exists(spark, f"{staged}/_moving"):  # from then on a bucket that is not staged has been moved
        for bucket in set(touched) - set(fresh):
            _remove(spark, f"{path.rstrip('/')}/job_bucket={bucket}")
        _mark(spark, f"{staged}/_moving")
    for bucket in fresh:
        _remove(spark, f"{path.rstrip('/')}/job_bucket={bucket}")
        _move(spark, f"{staged}/job_bucket={bucket}", f"{path.rstrip('/')}/job_bucket={bucket}")
    _remove(spark, staged)


def merge_history(
    spark: SparkSession, path: str, new: DataFrame, change_id: str,
    keys: tuple[str, ...] = ("job_id", "domain"), order: tuple[str, ...] = ("version", "tiebreak"),
    buckets: int = 64,
) -> None:
    """Insert or replace rows of a stored table: the highest ``order`` per key survives."""
    change_buckets(spark, path, touched_buckets(new, buckets),
                   lambda rows: history.upsert(rows, new.select(*rows.columns), keys, order), change_id, buckets)


def append_history(
    spark: SparkSession, path: str, new: DataFrame, change_id: str,
    keys: tuple[str, ...] = ("job_id", "host"), order: tuple[str, ...] = ("seq", "tiebreak"),
    buckets: int = 64,
) -> None:
    """Insert rows whose key a stored table lacks, the first per key; stored rows stay."""
    change_buckets(spark, path, touched_buckets(new, buckets),
                   lambda rows: history.append_urls(rows, new.select(*rows.columns), keys, order), change_id, buckets)


def delete_history(
    spark: SparkSession, path: str, ids: DataFrame, change_id: str, buckets: int = 64,
) -> None:
    """Drop all stored rows of the jobs in ``ids`` (``job_id``).  A bucket left without
    rows is removed."""
    gone = ids.select("job_id").distinct()
    change_buckets(spark, path, touched_buckets(gone, buckets),
                   lambda rows: rows.join(gone, "job_id", "left_anti"), change_id, buckets)
