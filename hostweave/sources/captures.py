"""Captured fetch attempts stored by host, so that a run on few sites reads few files.

A store has two tables.  ``attempts`` holds the fetch log in a folder per bucket of
requested hosts, sorted by host inside each file and with Parquet's Bloom filter on the
host, so row groups without a wanted host are skipped too.  ``landings`` holds, in
folders by landed host, which other hosts redirect there; it is narrow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.functions import urls
from hostweave.session import settle
from hostweave.sources.exports import job_bucket

#: Up to this many hosts are pushed to the scan by name, as Parquet readers test no longer list.
PUSHED = 10


def _asked() -> Column:
    return urls.host_of(urls.canonical_url(F.col("url")))


def _write(rows: DataFrame, path: str, buckets: int, mode: str) -> None:
    placed = rows.withColumn("host_bucket", job_bucket(F.col("host"), buckets)).hint("rebalance", "host_bucket")
    placed.sortWithinPartitions("host_bucket", "host").write.mode(mode).option(
        "parquet.bloom.filter.enabled#host", "true").option(
        "parquet.bloom.filter.adaptive.enabled", "true").partitionBy("host_bucket").parquet(path)


def write_captures(log: DataFrame, path: str, buckets: int = 256, mode: str = "errorifexists") -> None:
    """Store fetch attempts (``url``, ``final_url`` and any other columns) by host.

    Rows without a host are kept, under the empty one.  ``mode="append"`` adds attempts of
    a later crawl.
    """
    named = log.withColumn("host", F.coalesce(_asked(), F.lit("")))
    _write(named, f"{path}/attempts", buckets, mode)
    moved = named.select(
        F.coalesce(urls.host_of(F.col("final_url")), F.lit("")).alias("host"), F.col("host").alias("asked"))
    _write(moved.where("host <> asked and host <> ''").distinct(), f"{path}/landings", buckets, mode)


@dataclass
class Captures:
    """A stored fetch log.  Runs take it in place of a table."""

    spark: SparkSession
    path: str
    buckets: int = 256

    def _read(self, table: str, hosts: DataFrame) -> DataFrame:
        """Rows of ``hosts`` (``host``, distinct); other buckets are not listed."""
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        touched = hosts.select(job_bucket(F.col("host"), self.buckets).alias("b")).distinct().collect()
        rows = rows.where(F.col("host_bucket").isin([r["b"] for r in touched]))
        few = hosts.limit(PUSHED + 1).collect()
        if len(few) <= PUSHED:
            return rows.where(F.col("host").isin([r["host"] for r in few])).drop("host_bucket")
        return rows.drop("host_bucket").join(hosts, "host", "left_semi")

    def of_hosts(self, hosts: DataFrame) -> DataFrame:
        """Attempts on ``hosts`` (``host``)."""
        return self._read("attempts", hosts.select("host").distinct()).drop("host")

    def around(self, wanted: DataFrame) -> DataFrame:
        """Attempts a run on ``wanted`` addresses (``url``) may need: those on the hosts the
        addresses ask for or land on, and on hosts that redirect there."""
        asked = settle(wanted.select(F.coalesce(_asked(), F.lit("")).alias("host")).distinct(), "asked-hosts")
        landed = self.of_hosts(asked).select(urls.host_of(F.col("final_url")).alias("host"))
        near = settle(asked.union(landed).where("host <> ''").distinct(), "near-hosts")
        sources = self._read("landings", near).select(F.col("asked").alias("host"))
        return self.of_hosts(settle(asked.union(near).union(sources).distinct(), "read-hosts"))
