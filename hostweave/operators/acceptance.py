"""Acceptance of verified sites against their job's stack and niche."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.operators.fetchlog import usable_label


def niche_filter(custom: Column, vertical: Column) -> Column:
    """The niche a row must have; ``''`` for none."""
    custom = F.trim(F.coalesce(custom, F.lit("")))
    vertical = F.trim(F.coalesce(vertical, F.lit("all")))
    return F.when(custom != "", custom).when(vertical != "all", vertical).otherwise("")


def job_rules(jobs: DataFrame) -> DataFrame:
    """The columns of a job that decide acceptance, one narrow row per job."""
    return jobs.select(
        F.col("id").alias("job_id"),
        F.coalesce("tech_stacks", F.array().cast("array<string>")).alias("_stacks"),
        niche_filter(F.col("custom_niche"), F.col("vertical")).alias("_niche"),
        F.coalesce("classify_niche", F.lit(True)).alias("_classify"),
        F.coalesce("skip_tech_filter", F.lit(False)).alias("_skip"),
    )


def job_flags(jobs: DataFrame) -> DataFrame:
    """What a job wants done: ``classify`` (by default), ``extract`` (if asked for) and the
    ``niche`` its sites are asked about (``''``: the categories)."""
    def flag(name: str, default: bool) -> Column:
        value = F.col(name) if name in jobs.columns else F.lit(None).cast("boolean")
        return F.coalesce(value, F.lit(default))

    return jobs.select(F.col("id").alias("job_id"), flag("classify_niche", True).alias("classify"),
                       flag("extract_contacts", False).alias("extract"),
                       F.trim(F.coalesce(F.col("custom_niche"), F.lit(""))).alias("niche"))


def niche_policy(ver: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job: the niche condition, and whether it is dropped for want of labels."""
    labelled = ver.groupBy("job_id").agg(
        F.count("*").alias("n_rows"), F.count_if(usable_label(F.col("vertical"))).alias("n_ok")
    )
    wanted = F.col("_classify") & (F.col("_niche") != "")
    none = F.coalesce("n_ok", F.lit(0)) == 0
    any_rows = F.coalesce("n_rows", F.lit(0)) > 0
    return job_rules(jobs).join(labelled, "job_id", "left").select(
        "job_id", F.col("_niche").alias("niche"),
        (wanted & ~(none & any_rows)).alias("apply_niche"),
        (wanted & none & any_rows).alias("niche_fallback"),
    )


def accept(ver: DataFrame, jobs: DataFrame, policy: str = "run") -> DataFrame:
    """Set ``accepted``; both sides of the decision stay in the result.

    ``policy='run'`` honours ``skip_tech_filter`` and drops the niche condition
    of jobs without any usable label; ``'resume'`` does neither.  Rows of a job that
    ``jobs`` lacks are decided without stacks and niche.
    """
    rules = job_rules(jobs)
    if policy == "run":
        applied = niche_policy(ver, jobs).select("job_id", F.col("apply_niche").alias("_apply"))
        rules = rules.join(applied, "job_id", "left")
        skip = F.col("_skip")
    elif policy == "resume":
        rules = rules.withColumn("_apply", F.col("_classify") & (F.col("_niche") != ""))
        skip = F.lit(False)
    else:
        raise ValueError(f"unknown policy {policy!r}")
    stack_ok = F.coalesce(skip, F.lit(False)) | F.when(
        F.size("_stacks") > 0, F.arrays_overlap("platforms", "_stacks")
    ).otherwise(F.size("platforms") > 0)
    label = F.lower(F.trim(F.coalesce(F.col("vertical"), F.lit(""))))
    niche_ok = ~F.coalesce("_apply", F.lit(False)) | (label == F.lower(F.trim("_niche")))
    keep = [c for c in ver.columns if c != "accepted"]
    return ver.join(rules, "job_id", "left").select(
        *keep, F.coalesce(stack_ok & niche_ok, F.lit(False)).alias("accepted")
    )


def run_summary(urls: DataFrame, ver: DataFrame) -> DataFrame:
    """Per job: collected, analysed, matched, rejected and label outcomes."""
    collected = urls.groupBy("job_id").agg(F.count("*").alias("collected"))
    ok = usable_label(F.col("vertical"))
    analysed = ver.groupBy("job_id").agg(
        F.count("*").alias("analysed"),
        F.count_if(F.col("accepted")).alias("matched"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(ok).alias("labels_ok"), F.count_if(~ok).alias("labels_failed"),
    )
    counts = ["collected", "analysed", "matched", "rejected", "labels_ok", "labels_failed"]
    return collected.join(analysed, "job_id", "full").select(
        "job_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    )
