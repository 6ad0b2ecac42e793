"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most ``capacity`` words and packed into bins.
A bin never holds two pieces of one duplicate cluster, nor more than
``per_source`` pieces of one source.  Every bin carries bitmaps of what it holds:
one of clusters, and one of sources that are used up.  Bins stand in order of their
residual.  For a piece, the successor search starts at the smallest residual that
fits and goes on to the next until a compatible bin is found: that is the tightest
one.  If there is none, a bin is opened.

Pieces are dealt to tasks by a hash, never by source or cluster, so copies and hot
sources spread evenly; the number of tasks follows from the number of words.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Batches, bounded_batches, settle

CAPACITY = 2048
PER_SOURCE = 3
TASK_WORDS = 8_000_000

PIECES = "bin_id string, doc_id long, piece int, start long, words long, source string, residual long"


class Bins:
    """Open bins of one task, indexed by residual and by used-up sources."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.clusters: list[int] = []
        self.counts: list[dict[int, int]] = []
        self.left: list[int] = []
        self.full: list[int] = []
        self.levels: dict[int, dict[int, list[int]]] = {}
        self.mask = 0
        self.source_bit: dict = {}
        self.cluster_bit: dict = {}

    def _take(self, residual: int, full: int, at: int) -> int:
        level = self.levels[residual]
        stack = level[full]
        bin_ = stack.pop(at)
        if not stack:
            del level[full]
            if not level:
                del self.levels[residual]
                self.mask &= ~(1 << residual)
        return bin_

    def _tightest(self, size: int, source: int, cluster: int) -> int | None:
        rest = self.mask >> size << size
        while rest:
            residual = (rest & -rest).bit_length() - 1
            for full, stack in self.levels[residual].items():
                if full & source:
                    continue
                for at in range(len(stack) - 1, -1, -1):
                    if not self.clusters[stack[at]] & cluster:
                        return self._take(residual, full, at)
            rest &= rest - 1
        return None

    def add(self, size: int, source, cluster) -> int:
        """The number of the bin that takes the piece."""
        s = 1 << self.source_bit.setdefault(source, len(self.source_bit))
        c = 0 if cluster is None else 1 << self.cluster_bit.setdefault(cluster, len(self.cluster_bit))
        bin_ = self._tightest(size, s, c)
        if bin_ is None:
            bin_ = len(self.left)
            self.left.append(self.capacity)
            self.full.append(0)
            self.clusters.append(0)
            self.counts.append({})
        self.left[bin_] -= size
        self.clusters[bin_] |= c
        held = self.counts[bin_]
        held[s] = held.get(s, 0) + 1
        if held[s] >= self.per_source:
            self.full[bin_] |= s
        residual = self.left[bin_]
        if residual:
            self.levels.setdefault(residual, {}).setdefault(self.full[bin_], []).append(bin_)
            self.mask |= 1 << residual
        return bin_


def _pack(capacity: int, per_source: int):
    def packed(part: int, bins: Bins, rows: list) -> Batches:
        for at in range(0, len(rows), 20_000):
            number, doc, piece, start, words, source = zip(*rows[at:at + 20_000], strict=True)
            yield pa.record_batch({
                "bin_id": pa.array([f"{part}-{b}" for b in number]), "doc_id": pa.array(doc, pa.int64()),
                "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "words": pa.array(words, pa.int64()), "source": pa.array(source, pa.string()),
                "residual": pa.array([bins.left[b] for b in number], pa.int64()),
            })

    def run(batches: Batches) -> Batches:
        bins, rows, now = Bins(capacity, per_source), [], None
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in (
                    "doc_id", "piece", "start", "words", "source", "cluster", "repeats", "part")), strict=True):
                doc, piece, start, words, source, cluster, repeats, part = row
                if part != now:
                    yield from packed(now, bins, rows)
                    bins, rows, now = Bins(capacity, per_source), [], part
                bin_ = bins.add(words, source, cluster if repeats > 1 else None)
                rows.append((bin_, doc, piece, start, words, source))
        yield from packed(now, bins, rows)
    return run


def same_text() -> Column:
    """The default duplicate cluster: texts equal but for case and white space."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), SPACE, " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
         cluster: str | None = None, task_words: int = TASK_WORDS) -> DataFrame:
    """Pieces with their bin: ``bin_id, doc_id, piece, start, words, source, residual``.

    A piece covers ``words`` words from word ``start`` of its document; ``residual``
    is what its bin has left in the end.  Every word of every row lies in one piece.
    Null and blank texts have no piece.  ``cluster`` names a column of duplicate
    clusters; by default rows with equal texts form one.  A null source counts as a
    source.  Rows that repeat a ``doc_id`` are packed like any others.  Rows are dealt to tasks
    by id, piece and text, those without an id by a number drawn once and written down.
    """
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda x: x != "")).cast("long")
    cluster_ = same_text() if cluster is None else F.xxhash64(cluster)
    rows = settle(docs.select("doc_id", "source", size.alias("n"), cluster_.alias("cluster"),
                              F.when(F.col("doc_id").isNull(), F.rand(5)).alias("salt")).where("n > 0"), "sizes")
    repeats = settle(rows.groupBy("cluster").agg(F.count("*").alias("repeats")).where("repeats > 1"), "clusters")
    rows = rows.join(repeats, "cluster", "left").withColumn("repeats", F.coalesce("repeats", F.lit(1)))
    pieces = rows.select(
        "doc_id", "source", "cluster", "repeats", "n", "salt",
        F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).alias("piece", "start"),
    ).withColumn("words", F.least(F.lit(capacity), F.col("n") - F.col("start"))) \
        .withColumn("repeats", F.when(F.col("n") > capacity, 2).otherwise(F.col("repeats")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    tasks = int(max(1, -(-total // task_words)))
    dealt = pieces.withColumn("part", F.pmod(
        F.xxhash64("doc_id", "piece", "cluster", "salt"), F.lit(tasks)).cast("int")).drop("n", "salt")
    ordered = dealt.repartition(tasks, "part").sortWithinPartitions(
        "part", F.desc("words"), "doc_id", "piece", "source", "cluster")
    return bounded_batches(ordered).mapInArrow(_pack(capacity, per_source), PIECES)
