"""Live versions of the keyed jobs, with Structured Streaming.

Results go to a change log: every micro-batch writes its own folder, named by
batch id and overwritten when a batch is replayed, so a lost executor or a
restart never doubles rows.  Readers take the latest row per key.  A batch costs
what its own changes cost, never a rewrite of the whole table.

`fold_log` folds the complete batches of a log into a base folder beside them.  The
base counts from the moment its success marker is written, which is the last step, so
`read_log` gives either the batches or the base that holds them, never both.
Nothing is removed then: readers that listed the batches before go on with them until
`drop_covered`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from hostweave.operators.fetchlog import latest_by, usable_label
from hostweave.session import hadoop_path

_STATE = "spark.sql.streaming.stateStore"
#: State on the executors' disks; its caches and buffers aim at 128 MB an executor, outside the heap.
DISK_STATE = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "128",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep state on disk.  The session's own settings win; it is left as it was."""
    added = {k: v for k, v in DISK_STATE.items() if spark.conf.get(k, None) is None}
    for key, value in added.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in added:
            spark.conf.unset(key)


def stream_first(
    urls: DataFrame, keys: tuple[str, ...] = ("job_id", "host"), event_time: str | None = None,
    within: str | None = None,
) -> DataFrame:
    """First-seen rows per key of a stream of discoveries.

    Exact with state for every key.  With ``event_time`` and ``within`` the
    state is bounded by a watermark and duplicates further apart come through.
    """
    if event_time and within:
        return urls.withWatermark(event_time, within).dropDuplicatesWithinWatermark(list(keys))
    return urls.dropDuplicates(list(keys))


def _bucketed(rows: DataFrame, keys: tuple[str, ...], buckets: int) -> DataFrame:
    return rows.withColumn("key_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def log_schema(rows: DataFrame) -> StructType:
    """Schema of a first-seen store of ``rows``."""
    return StructType([*rows.schema.fields]).add("key_bucket", IntegerType()).add("batch_id", IntegerType())


def store_first(
    rows: DataFrame, path: str, keys: tuple[str, ...] = ("job_id", "host"), buckets: int = 64,
) -> None:
    """Start a first-seen store from rows of an earlier, finished run, as batch ``-1``."""
    _bucketed(rows.dropDuplicates(list(keys)), keys, buckets).write.mode("overwrite") \
        .partitionBy("key_bucket").parquet(f"{path}/batch_id=-1")


def stream_first_stored(
    urls: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("job_id", "host"),
    within: str = "1 hour", buckets: int = 64, **trigger,
) -> StreamingQuery:
    """Log rows whose key neither the store at ``path`` nor an earlier batch holds.

    State only absorbs keys that come again ``within`` that time of their arrival, so
    it is bounded by the arrivals of that time.  It lies on the executors' disks, since
    that can be more than memory holds (a stream begun with another state store goes on
    with that).  Older keys are found in the store:
    each batch is anti-joined with the buckets that its keys fall in.  The watermark
    runs on arrival, so no row is late and the result is exact for every delay.  Nulls
    in keys are equal.  A replayed batch ignores what it wrote before.
    """
    recent = urls.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within) \
        .dropDuplicatesWithinWatermark(list(keys)).drop("_arrived")
    schema = log_schema(urls)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _bucketed(batch, keys, buckets).persist()
        touched = [r["key_bucket"] for r in rows.select("key_bucket").distinct().collect()]
        new, stored = rows, read_log(batch.sparkSession, path, before=batch_id, schema=schema)
        if stored is not None:
            known = stored.where(F.col("key_bucket").isin(touched)).select(
                F.col("key_bucket").alias("_bucket"), *[F.col(k).alias(f"_known_{k}") for k in keys])
            same = F.col("key_bucket") == F.col("_bucket")
            for key in keys:
                same = same & F.col(key).eqNullSafe(F.col(f"_known_{key}"))
            new = rows.join(known, same, "left_anti")
        new.write.mode("overwrite").partitionBy("key_bucket").parquet(f"{path}/batch_id={batch_id}")
        rows.unpersist()

    with _state_on_disk(urls.sparkSession):
        return (
            recent.writeStream.outputMode("append").foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )


def write_rows(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to parquet files, exactly once."""
    return (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _log_batches(
    stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame],
    mode: str, trigger: dict,
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_upsert(
    ver: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("job_id", "domain"),
    order: tuple[str, ...] = ("version", "tiebreak"), **trigger,
) -> StreamingQuery:
    """Log the last row per key of every micro-batch; read with `read_latest`."""
    return _log_batches(
        ver, path, checkpoint, lambda b: latest_by(b, list(keys), list(order)), "append", trigger
    )


def read_latest(log: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Current row per key of a change log read from its folder."""
    return latest_by(log, list(keys), [*order, "batch_id"]).drop("batch_id")


def compact(log: DataFrame, path: str, keys: tuple[str, ...], order: tuple[str, ...]) -> None:
    """Write the current rows as batch ``-1`` of a new log folder."""
    read_latest(log, keys, order).write.mode("overwrite").parquet(f"{path}/batch_id=-1")


def _parts(spark: SparkSession, path: str, before: int | None = None) -> tuple[int | None, list[int]]:
    """The last batch that the newest complete base covers, and complete batches after it."""
    fs, root = hadoop_path(spark, path)
    if not fs.exists(root):
        return None, []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    whole = [n for n in names if fs.exists(hadoop_path(spark, f"{path}/{n}/_SUCCESS")[1])]
    base = max((int(n.removeprefix("_base-")) for n in whole if n.startswith("_base-")), default=None)
    ids = sorted(int(n.removeprefix("batch_id=")) for n in whole if n.startswith("batch_id="))
    return base, [i for i in ids if (base is None or i > base) and (before is None or i < before)]


def read_log(
    spark: SparkSession, path: str, before: int | None = None, schema: StructType | None = None,
) -> DataFrame | None:
    """Rows of a log with their ``batch_id``: the newest base and the complete batches after it.

    ``before`` leaves out batches from that one on.  None if there is nothing yet.
    """
    base, later = _parts(spark, path, before)
    reader = spark.read if schema is None else spark.read.schema(schema)
    out = None
    if later:
        out = reader.option("basePath", path).parquet(*[f"{path}/batch_id={i}" for i in later])
    if base is not None:
        folded = reader.parquet(f"{path}/_base-{base}").withColumn("batch_id", F.lit(base))
        out = folded if out is None else out.unionByName(folded)
    return out


def fold_log(
    spark: SparkSession, path: str, keys: tuple[str, ...], order: tuple[str, ...] = (),
    schema: StructType | None = None,
) -> int | None:
    """Fold a log into a new base; returns the last batch it covers.

    Streams may go on writing and readers reading.  A fold that broke off left no
    marker and is ignored, as is a replay of a batch that a base covers.
    """
    base, later = _parts(spark, path)
    if not later:
        return base
    upto = later[-1]
    rows = read_latest(read_log(spark, path, upto + 1, schema), keys, order)
    parts = [c for c in rows.columns if c == "key_bucket"]
    rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/_base-{upto}")
    return upto


def drop_covered(spark: SparkSession, path: str) -> None:
    """Remove batches and bases that the newest base replaces, once no reader is open on them."""
    base, _ = _parts(spark, path)
    if base is None:
        return
    fs, root = hadoop_path(spark, path)
    for status in fs.listStatus(root):
        kind, _, number = status.getPath().getName().replace("_base-", "_base=").partition("=")
        if (kind == "batch_id" and int(number) <= base) or (kind == "_base" and int(number) < base):
            fs.delete(status.getPath(), True)


def count_jobs(rows: DataFrame) -> DataFrame:
    """Per job: rows, accepted rows and rows without a label."""
    return rows.groupBy("job_id").agg(
        F.count("*").alias("verified"),
        F.count_if(F.col("accepted")).alias("matched"),
        F.count_if(~usable_label(F.col("vertical"))).alias("unknown_niche"),
    )


def stream_counts(ver: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Log the counters that changed in each micro-batch; read with `read_latest`."""
    return _log_batches(count_jobs(ver), path, checkpoint, lambda b: b, "update", trigger)
