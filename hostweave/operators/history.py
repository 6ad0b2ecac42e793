"""Job history: keyed inserts, upserts, lists, comparisons and repairs.

Facts are ``urls(job_id, host, …)`` and ``verifications(job_id, domain, …)``;
``jobs`` has one row per ``id``.  Keys are always (job, host), so one huge job
spreads over all tasks; per-job results are combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.operators.collect import first_by
from hostweave.operators.fetchlog import latest_by, usable_label
from hostweave.session import settle

SIMILAR_KEYS = ("keywords", "custom_niche", "city", "state", "country", "area")
FINISHED = ("done", "stopped")


def append_urls(
    base: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("job_id", "host"),
    order: tuple[str, ...] = ("seq", "tiebreak"),
) -> DataFrame:
    """Insert if absent: known (job, host) pairs stay, new ones enter once."""
    fresh = first_by(new, list(keys), list(order))
    added = fresh.join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(added.select(*base.columns))


def upsert(
    base: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("job_id", "domain"),
    order: tuple[str, ...] = ("version", "tiebreak"),
) -> DataFrame:
    """Insert or replace: the highest version per key survives."""
    return latest_by(base.unionByName(new), list(keys), list(order))


def apply_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Replay status changes on jobs.

    ``changes``: ``id, seq, changed_at, status, ended, replaced``.  A replacing change
    (re-)creates the job and clears its end; an ending change sets it.  Plain
    changes of unknown jobs do nothing.
    """
    seq = F.col("seq")
    last = changes.groupBy("id").agg(
        F.max_by("status", seq).alias("_status"),
        F.max(F.when(F.col("replaced"), F.struct("seq", "changed_at"))).alias("_made"),
        F.max(F.when(F.col("ended"), F.struct("seq", "changed_at"))).alias("_end"),
    )
    made, end = F.col("_made"), F.col("_end")
    ended_later = end.isNotNull() & (made.isNull() | (end["seq"] > made["seq"]))
    joined = jobs.withColumn("_known", F.lit(True)).join(last, "id", "full")
    values = {
        "status": F.coalesce("_status", "status"),
        "created_at": F.coalesce(made["changed_at"], F.col("created_at")),
        "ended_at": F.when(ended_later, end["changed_at"]).when(made.isNull(), F.col("ended_at")),
    }
    return joined.where(F.col("_known") | made.isNotNull()).withColumns(values).select(
        *jobs.columns
    )


def recover_orphans(jobs: DataFrame, live: DataFrame, now: Column) -> DataFrame:
    """Running jobs without a live worker become interrupted and end now."""
    marked = jobs.join(live.select("id").distinct().withColumn("_live", F.lit(True)), "id", "left")
    orphan = (F.col("status") == "running") & F.col("_live").isNull()
    return marked.withColumn("recovered", orphan).withColumns({
        "ended_at": F.when(F.col("recovered"), now).otherwise(F.col("ended_at")),
        "status": F.when(F.col("recovered"), "interrupted").otherwise(F.col("status")),
    }).select(*jobs.columns, "recovered")


def list_jobs(
    jobs: DataFrame, urls: DataFrame, ver: DataFrame, limit: int | None = 50
) -> DataFrame:
    """Jobs, newest first, with their collected/verified/matched/unknown counts.

    With a limit the newest jobs are picked first, and the fact tables are
    filtered to them before they are counted.
    """
    if limit is None:
        page, urls_in, ver_in = jobs, urls, ver
    else:
        page = jobs.orderBy(F.desc("created_at"), "id").limit(limit)
        ids = page.select(F.col("id").alias("job_id"))
        urls_in = urls.join(ids, "job_id", "left_semi")
        ver_in = ver.join(ids, "job_id", "left_semi")
    collected = urls_in.groupBy("job_id").agg(F.count("*").alias("collected"))
    verified = ver_in.groupBy("job_id").agg(
        F.count("*").alias("verified"),
        F.count_if("accepted").alias("matched"),
        F.count_if(~usable_label(F.col("vertical"))).alias("unknown_niche"),
    )
    counts = ("collected", "verified", "matched", "unknown_niche")
    return (
        page.join(collected.withColumnRenamed("job_id", "id"), "id", "left")
        .join(verified.withColumnRenamed("job_id", "id"), "id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
        .orderBy(F.desc("created_at"), "id")
    )


def similar_key(stacks: str = "tech_stacks") -> Column:
    """Equal for jobs with the same parameters; null, ``''`` and ``[]`` are equal."""
    listed = F.array_join(
        F.array_sort(F.coalesce(F.col(stacks), F.array().cast("array<string>"))), ","
    )
    return F.to_json(F.struct(
        *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in SIMILAR_KEYS],
        listed.alias("tech_stacks"),
    ))


def previous_run(jobs: DataFrame, parts: int | None = None) -> DataFrame:
    """The newest finished earlier job with the same parameters, per job.

    An as-of lookup in two levels.  Narrow rows are cut into ``parts`` ranges of (key,
    time, id) and written once; inside a range a running ``last`` finds the match, and
    across ranges a running ``last`` over one summary row per key and range carries
    it.  A key that holds a third of all jobs, even on one day, is spread over a
    third of the ranges.
    A job without a time has no previous run and is none.
    """
    finished = F.col("status").isin(*FINISHED)
    parts = parts or int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = jobs.select(
        F.col("id").alias("job_id"), "created_at", similar_key().alias("_key"),
        F.when(finished & F.col("created_at").isNotNull(), F.col("id")).alias("_done"),
    ).repartitionByRange(parts, "_key", "created_at", "job_id").withColumn("_span", F.spark_partition_id())
    rows = settle(rows, "job-ranges")
    inside = Window.partitionBy("_key", "_span").orderBy("created_at", "job_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = rows.withColumn("_near", F.last("_done", ignorenulls=True).over(inside))
    spans = rows.groupBy("_key", "_span").agg(
        F.max(F.when(F.col("_done").isNotNull(), F.struct("created_at", "job_id"))).alias("_last")
    )
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = spans.select(
        "_key", "_span",
        F.last(F.col("_last.job_id"), ignorenulls=True).over(before).alias("_far"),
    )
    return local.join(carried, ["_key", "_span"]).select(
        "job_id", F.when(F.col("created_at").isNotNull(), F.coalesce("_near", "_far")).alias("prev_job_id")
    )


def new_hosts(jobs: DataFrame, urls: DataFrame) -> DataFrame:
    """Hosts of each job that its previous similar run did not collect."""
    pairs = previous_run(jobs).where(F.col("prev_job_id").isNotNull())
    hosts = urls.select("job_id", "host").distinct()
    return hosts.join(pairs, "job_id").join(
        hosts.withColumnRenamed("job_id", "prev_job_id"), ["prev_job_id", "host"], "left_anti"
    ).select("job_id", "prev_job_id", "host")


def run_diff(jobs: DataFrame, urls: DataFrame) -> DataFrame:
    """Per job with a previous run: new hosts and the size of the previous run."""
    pairs = settle(previous_run(jobs).where(F.col("prev_job_id").isNotNull()), "previous-runs")
    hosts = settle(urls.select("job_id", "host").distinct(), "hosts")
    before = hosts.select(F.col("job_id").alias("prev_job_id"), "host", F.lit(True).alias("_known"))
    compared = hosts.join(pairs, "job_id").join(before, ["prev_job_id", "host"], "left")
    fresh = compared.groupBy("job_id").agg(F.count_if(F.col("_known").isNull()).alias("new_count"))
    sizes = hosts.groupBy(F.col("job_id").alias("prev_job_id")).agg(F.count("*").alias("prev_total"))
    return (
        pairs.join(fresh, "job_id", "left").join(sizes, "prev_job_id", "left")
        .select("job_id", "prev_job_id", F.coalesce("new_count", F.lit(0)).alias("new_count"),
                F.coalesce("prev_total", F.lit(0)).alias("prev_total"))
    )


def remaining_urls(urls: DataFrame, ver: DataFrame, host: str = "domain") -> DataFrame:
    """Collected hosts that are not verified; ``host`` names the *requested* host."""
    done = ver.select("job_id", F.col(host).alias("host"))
    return urls.join(done, ["job_id", "host"], "left_anti")


def without_contacts() -> Column:
    """No e-mail, phone or social handle on the row."""
    empty = F.lit(True)
    for column in ("emails", "phones", "socials"):
        empty = empty & (F.coalesce(F.size(column), F.lit(0)) <= 0)
    return empty


def backfill_set(ver: DataFrame) -> DataFrame:
    """Verified rows that have no contact at all."""
    return ver.where(without_contacts())


def patch(
    ver: DataFrame, updates: DataFrame, fields: tuple[str, ...],
    order: tuple[str, ...] = ("version", "tiebreak"),
) -> DataFrame:
    """Override ``fields`` of the first row per (job, url); other columns stay.

    ``updates``: ``job_id, url`` and the fields, at most one row per address.
    """
    key = ["job_id", "url"]
    change = updates.select(*key, F.struct(*fields).alias("_new"))
    firsts = ver.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    targets = firsts.join(change, key)
    joined = ver.join(targets, key, "left")
    hit = F.col("_new").isNotNull() & (F.col("_first") == F.struct(*order))
    return joined.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumns({
        f: F.when(F.col("_hit"), F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields
    }).select(*ver.columns)


def delete_jobs(
    jobs: DataFrame, urls: DataFrame, ver: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop jobs and everything that belongs to them."""
    gone = ids.select(F.col("id").alias("job_id")).distinct()
    return (
        jobs.join(ids.select("id"), "id", "left_anti"),
        urls.join(gone, "job_id", "left_anti"),
        ver.join(gone, "job_id", "left_anti"),
    )


def upgrade(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of an old and a current table; text columns the old one lacks are ``''``."""
    texts = {f.name for f in new.schema.fields if f.dataType.simpleString() == "string"}
    missing = {c: F.lit("") for c in new.columns if c not in old.columns and c in texts}
    return old.withColumns(missing).unionByName(new, allowMissingColumns=True)
