"""Resolution of logged attempts: fetches, redirects, verdicts, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.functions import fixed, markup, urls
from hostweave.functions.stages import once


def resolve_fetch(
    log: DataFrame, rule: str = "body", keys: tuple[str, ...] = ("url",), floor: int = 100
) -> DataFrame:
    """The first usable attempt per key.

    ``rule='body'`` wants a status below 400 and a body; ``'text'`` also wants
    ``floor`` visible characters.  Bodies of unusable attempts are blanked
    before the aggregate, so at most one body a key and map task is shuffled.
    """
    usable = (F.col("status") < 400) & (F.col("body") != "")
    if rule == "text":
        usable = usable & (F.length(markup.visible_text(F.col("body"))) >= floor)
    elif rule != "body":
        raise ValueError(f"unknown rule {rule!r}")
    rest = [c for c in log.columns if c not in keys]
    marked = once(log, {"_ok": F.coalesce(usable, F.lit(False))})
    won = F.when(F.col("_ok"), F.struct("attempt", *[c for c in rest if c != "attempt"]))
    packed = marked.select(*keys, "attempt", won.alias("_row"))
    picked = packed.groupBy(*keys).agg(
        F.min_by("_row", F.when(F.col("_row").isNotNull(), F.col("attempt"))).alias("_row")
    )
    text_columns = {"body", "final_url"}
    return picked.select(
        *keys, F.col("_row").isNotNull().alias("ok"),
        *[F.coalesce(F.col(f"_row.{c}"), F.lit("")).alias(c) if c in text_columns
          else F.col(f"_row.{c}").alias(c) for c in rest],
    )


def landing_domains(
    resolved: DataFrame, keys: tuple[str, ...] = ("job_id",), order: str = "write_order"
) -> DataFrame:
    """One row per (keys, landing domain): the last one written wins."""
    domain = urls.host_of(F.col("final_url"))
    rows = resolved.withColumn("domain", domain).where(F.col("domain") != "")
    return latest_by(rows, [*keys, "domain"], [order, "url"])


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in the given order, as a map-side combined aggregate.

    Rows that tie in ``order`` are told apart by a hash of their values, so a
    recomputed task picks the same row again.  Unless a column is a map, which has no order,
    the row itself is compared, so values are sorted and shuffled once.
    """
    rest = [c for c in df.columns if c not in keys]
    plain = [c for c, kind in df.dtypes if c in rest and "map<" not in kind]
    place = [*order, F.xxhash64(*plain).alias("_tie")]
    if plain == rest:
        last = F.max(F.struct(*place, *[c for c in rest if c not in order]))
    else:
        last = F.max_by(F.struct(*rest), F.struct(*place))
    picked = df.groupBy(*keys).agg(last.alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def usable_label(label: Column) -> Column:
    return ~F.trim(F.coalesce(label, F.lit(""))).isin("", "Unknown")


def final_verdict(vertical: Column, reason: Column, tokens: list[str] | None = None) -> Column:
    """Whether asking again is pointless: a usable label, or a failure that is not transient."""
    said = F.lower(F.coalesce(reason, F.lit("")))
    transient = F.lit(False)
    for token in tokens or fixed.TRANSIENT_TOKENS:
        transient = transient | said.contains(token)
    return usable_label(vertical) | ~transient


def resolve_verdicts(
    attempts: DataFrame, keys: tuple[str, ...] = ("doc_id",), limit: int | None = None,
    tokens: list[str] | None = None,
) -> DataFrame:
    """The verdict at which retrying stops: usable or not transient, else the last."""
    final = final_verdict(F.col("vertical"), F.col("reason"), tokens)
    rest = [c for c in attempts.columns if c not in keys]
    row = F.struct(*rest)
    tried = attempts if limit is None else attempts.where(F.col("n") <= limit)
    picked = tried.groupBy(*keys).agg(F.coalesce(
        F.min_by(row, F.when(final, F.col("n"))),
        F.max_by(row, F.col("n")),
    ).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def failure_class(error: Column) -> Column:
    return (
        F.when(error == "", "ok")
        .when(error.contains("404"), "404")
        .when(error.contains("401") | error.contains("403"), "auth")
        .when(error.contains("429"), "429")
        .when(F.lower(error).contains("timeout"), "timeout")
        .otherwise("other")
    )


def failure_classes(log: DataFrame) -> DataFrame:
    """Probes per model and failure class with their fastest and slowest time."""
    return log.groupBy(
        "model", failure_class(F.coalesce(F.col("error"), F.lit(""))).alias("failure_class")
    ).agg(
        F.count("*").alias("n_probes"),
        F.min("elapsed_ms").alias("min_ms"), F.max("elapsed_ms").alias("max_ms"),
    )


def probe_rollup(log: DataFrame) -> DataFrame:
    """Per model: probes, successes, success rate and median latency."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    return log.groupBy("model").agg(
        F.count("*").alias("n_probes"), F.count_if(ok).alias("n_ok"),
        (F.count_if(ok) / F.count("*")).alias("ok_rate"),
        F.expr("percentile_disc(0.5) within group (order by elapsed_ms)").cast("bigint").alias("median_ms"),
    )


def latency_sketches(log: DataFrame, keys: tuple[str, ...] = ("run",), size: int = 200) -> DataFrame:
    """Mergeable latencies: ``keys, model, sketch, n_probes``, one row per run and model.

    The sketch keeps a bounded sample whose ranks are within about 1.65 % (at
    ``size`` 200, with 99 % confidence), however many probes a model has.  Null latencies are left
    out.
    """
    return log.where("elapsed_ms is not null").groupBy(*keys, "model").agg(
        F.kll_sketch_agg_bigint(F.col("elapsed_ms").cast("bigint"), F.lit(size)).alias("sketch"),
        F.count("*").alias("n_probes"))


def merged_latencies(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``model, n_probes, rank, elapsed_ms``: latency quantiles over all stored runs."""
    merged = sketches.groupBy("model").agg(
        F.kll_merge_agg_bigint("sketch").alias("_sketch"), F.sum("n_probes").alias("n_probes"))
    marks = [F.struct(F.lit(r).alias("rank"), F.kll_sketch_get_quantile_bigint("_sketch", F.lit(r)).alias("elapsed_ms"))
             for r in ranks]
    return merged.select("model", "n_probes", F.inline(F.array(*marks)))
