"""Mixing sources to token targets by entropy balancing, in DataFrame functions only.

Every document gets a rate ``min(cap, q * exp(l * size))`` with one multiplier ``l`` per
source and a prior weight ``q`` per document.  Among all rates that meet the token
targets these are the closest to the priors in relative entropy over documents: they
minimise the sum of ``r * log(r / q) - r + q`` where the sum of ``size * r`` is the
target and no rate is above ``cap``.  So a source that gives words up loses those of its
long documents first, and one that gains words repeats its long documents first; the most
documents stay near their prior.  The multipliers maximise the concave dual.  Safeguarded
Newton rounds find them, each one distributed aggregation of gradient and curvature; a
step that leaves the bracket of signs seen so far is replaced by the bracket's middle.

Rates become whole copies by systematic rounding: documents of a source are laid
end to end by size and a copy is taken wherever the running sum of rates passes a
whole number.  Sizes are handled in tiers, largest first, and each tier makes up
for what the earlier ones took too much or too little, so the error ends at the
size of a small document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scope, settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
ROUNDS = 60
TOLERANCE = 1e-9
TIERS = (2048, 512, 128, 32, 8, 0)
CELL_ROWS = 20_000


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__size``, the number of words of the whole text (null: 0)."""
    found = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda x: x != "")
    return docs.withColumn("__size", F.size(found).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources sorted by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all words.  A target above ``cap`` times its source's size stops
    there and the rest is shared again.  Filling by weight ends at one level: with
    sources sorted by the level at which they stop, it follows from running sums.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    stops = total.withColumn("w", weight).withColumn("stop", cap * F.col("source_size") / F.col("w"))
    everything = Window.partitionBy()
    below = Window.orderBy("stop", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    filled = stops.withColumn("all", share * F.sum("source_size").over(everything)) \
        .withColumn("stopped", F.coalesce(F.sum(cap * F.col("source_size")).over(below), F.lit(0.0))) \
        .withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0))) \
        .withColumn("level", (F.col("all") - F.col("stopped")) / F.col("open"))
    level = F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(everything)
    return filled.withColumn("target", F.least(
        cap * F.col("source_size"), F.col("w") * F.coalesce(level, F.lit(float("inf"))))) \
        .select("source", "source_size", "target")


def _rate(cap: float) -> Column:
    # The exponent is bounded where the rate is at its cap or vanishes anyway.
    tilt = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("l") * F.col("size")))
    return F.least(F.lit(cap), F.col("q") * F.exp(tilt))


def histogram(rows: DataFrame) -> DataFrame:
    """``source, q, size, n``: documents of equal rate, counted; null sources are one source."""
    return rows.where("size > 0").groupBy("source", "q", "size").agg(F.count("*").alias("n"))


def multipliers(units: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """``targets`` with the multiplier ``l`` of each source, per word of a document.

    ``units`` has ``source, q, size, n`` (`histogram`).  The first bracket holds every
    solution: at its upper end all rates of a source reach the cap, at its lower end
    the priors scaled by the smallest document already fall short of the target.
    """
    span = units.groupBy("source").agg(
        F.min("size").alias("least"), F.min("q").alias("q_low"), F.max("q").alias("q_high"),
        F.sum(F.col("size").cast("double") * F.col("n")).alias("mass"),
        (F.sum(F.col("size").cast("double") * F.col("size") * F.col("n"))
         / F.sum(F.col("size").cast("double") * F.col("n"))).alias("mean"))
    t = targets.join(span.withColumnRenamed("source", "s"), targets["source"].eqNullSafe(F.col("s")), "left")
    share = F.log(F.nullif(F.col("target"), F.lit(0.0)) / F.col("mass"))
    hi = F.greatest(F.lit(0.0), F.log(F.lit(cap) / F.col("q_low"))) / F.col("least")
    lo = F.least(F.lit(0.0), share - F.log("q_high")) / F.col("least") - 1e-9
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    guess = F.greatest(F.col("lo"), F.least(F.col("hi"), share / F.col("mean")))
    state = t.withColumn("hi", F.coalesce(hi, F.lit(0.0))).withColumn("lo", F.coalesce(lo, F.lit(0.0))) \
        .withColumn("l", F.when(full, F.col("hi")).otherwise(F.coalesce(guess, F.lit(0.0)))) \
        .select("source", "source_size", "target", "l", "lo", "hi")
    state = settle(state, "dual")
    for _ in range(ROUNDS):
        tilts = state.select(F.col("source").alias("s"), "l")
        rated = units.join(tilts, F.col("source").eqNullSafe(F.col("s"))) \
            .select("source", "size", (F.col("size") * F.col("n") * _rate(cap)).alias("words"),
                    (_rate(cap) < cap).alias("open"))
        sums = rated.groupBy("source").agg(
            F.sum("words").alias("got"),
            F.sum(F.when(F.col("open"), F.col("words") * F.col("size")).otherwise(0.0)).alias("slope"))
        s = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        s = s.withColumn("got", F.coalesce("got", F.lit(0.0))).withColumn("gap", F.col("got") - F.col("target")) \
            .withColumn("lo", F.when(F.col("gap") < 0, F.col("l")).otherwise(F.col("lo"))) \
            .withColumn("hi", F.when(F.col("gap") > 0, F.col("l")).otherwise(F.col("hi")))
        # Newton on the logarithm of the sum, which bends less than the sum itself.
        step = F.col("l") + F.log(F.nullif(F.col("target"), F.lit(0.0)) / F.nullif(F.col("got"), F.lit(0.0))) \
            * F.col("got") / F.nullif(F.col("slope"), F.lit(0.0))
        close = F.abs("gap") <= TOLERANCE * F.greatest("target", F.lit(1.0))
        done = close | (F.col("hi") - F.col("lo") <= 1e-15 * F.abs(F.col("l")))
        moved = F.when(done, F.col("l")).when(
            (step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = settle(s.select("source", "source_size", "target", moved.alias("l"), "lo", "hi",
                                (~done).alias("busy")), "dual")
        if not state.where("busy").limit(1).count():
            break
    return state.select("source", "source_size", "target", "l")


def _systematic(rated: DataFrame) -> DataFrame:
    """``copies`` for rows with ``source, size, salt, rate``: whole numbers whose running
    sum per source, in order of size, stays within one of the running sum of rates.

    A cell holds the documents of one source, size and salt.  Running sums go over
    cells and then over the rows of a cell, so no source is ordered in one task.
    """
    cells = rated.groupBy("source", "size", "salt").agg(F.sum("rate").alias("mass"))
    before = Window.partitionBy("source").orderBy(F.desc("size"), "salt") \
        .rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("mass").over(before), F.lit(0.0))).drop("mass")
    cells = settle(cells, "cells")
    inside = Window.partitionBy("source", "size", "salt").orderBy("tie", "doc_id") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rated.alias("r").join(
        cells.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))
        & (F.col("r.size") == F.col("c.size")) & (F.col("r.salt") == F.col("c.salt"))) \
        .select("r.*", "c.start")
    end = F.col("start") + F.sum("rate").over(inside)
    count = F.floor(end + 0.5 + 1e-9) - F.floor(end - F.col("rate") + 0.5 + 1e-9)
    return joined.withColumn("copies", count.cast("long")).drop("start")


def rounded(units: DataFrame, state: DataFrame, cap: float = CAP) -> DataFrame:
    """Documents with ``copies``, tier by tier from the largest sizes down.

    ``units`` has ``doc_id, source, size, q, tie, salt``.
    """
    units = settle(units.join(state.select(F.col("source").alias("s"), "l"), F.col("source").eqNullSafe(F.col("s")))
                   .select(*units.columns, _rate(cap).alias("r")), "rates")
    due = state.select("source", F.col("target").alias("due"))
    tiers, upper = [], None
    for floor in TIERS:
        here = (F.col("size") >= floor) if upper is None else (F.col("size") >= floor) & (F.col("size") < upper)
        rest = units if upper is None else units.where(F.col("size") < upper)
        mass = rest.groupBy("source").agg(F.sum(F.col("size") * F.col("r")).alias("mass"))
        factor = due.join(mass, due["source"].eqNullSafe(mass["source"]), "left").select(
            due["source"].alias("s"),
            F.when(F.coalesce("mass", F.lit(0.0)) > 0, F.greatest("due", F.lit(0.0)) / F.col("mass"))
            .otherwise(1.0).alias("f"))
        factor = settle(factor, "factor")  # a row per source, of known size
        rated = units.where(here).join(factor, F.col("source").eqNullSafe(F.col("s"))).select(
            *units.columns, F.least(F.lit(cap), F.col("r") * F.col("f")).alias("rate"))
        done = settle(_systematic(rated), "tier")
        tiers.append(done)
        took = done.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("took"))
        due = settle(due.join(took, due["source"].eqNullSafe(took["source"]), "left").select(
            due["source"], (F.col("due") - F.coalesce("took", F.lit(0))).alias("due")), "due")
        upper = floor
    out = tiers[0]
    for tier in tiers[1:]:
        out = out.union(tier)
    return out.withColumn("copies", F.least(F.lit(int(cap)), F.greatest(F.lit(0), F.col("copies"))))


def mix_rows(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``mix`` for rows of ``doc_id, source, size, q``."""
    rows = settle(rows.withColumn("tie", F.xxhash64("doc_id")), "sizes")
    targets = settle(source_targets(rows, weights, share, cap), "targets")
    state = multipliers(settle(histogram(rows), "sums"), targets, cap)
    salts = settle(rows.groupBy("source", "size").agg(
        F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("salts"))
        .select(F.col("source").alias("s"), F.col("size").alias("z"), "salts"), "salts")
    units = rows.where("size > 0").join(
        salts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))) \
        .select(*rows.columns, F.pmod("tie", F.col("salts")).cast("int").alias("salt"))
    taken = rounded(units, state, cap).select("doc_id", "source", "size", "rate", "copies")
    empty = rows.where("size = 0").select("doc_id", "source", "size", F.lit(0.0).alias("rate"),
                                          F.lit(0).cast("long").alias("copies"))
    everything = taken.union(empty).alias("d").join(
        targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return everything.select(
        "d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "d.rate", "d.copies",
        (F.col("d.size") * F.col("d.copies")).alias("taken"))


def mix(docs: DataFrame, prior: str | None = None, weights: tuple = WEIGHTS, share: float = SHARE,
        cap: float = CAP) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    ``prior`` names an optional column of positive prior weights (default 1).
    Documents of a source with equal size and prior get the same rate.  A null source is a source of its own.
    Documents without words are never taken.  Ties go by a hash of the id, so reruns
    agree; rows that repeat a ``doc_id`` are rounded on their own.
    """
    weight = F.lit(1.0) if prior is None else F.col(prior).cast("double")
    rows = sized(docs).select("doc_id", "source", F.col("__size").alias("size"), weight.alias("q"))
    return mix_rows(rows, weights, share, cap)


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
                    cap: float = CAP) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as its copies say.

    Rows equal in id, source and text are one document that may be taken as often
    as all of them together.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "source", "text"))
    rows = sized(keyed).select(F.col("__key").alias("doc_id"), "source", F.col("__size").alias("size"),
                               F.lit(1.0).alias("q"))
    with Scope(docs.sparkSession) as scope:
        copies = mix_rows(rows, weights, share, cap).groupBy("doc_id").agg(F.sum("copies").alias("__copies")) \
            .where("__copies > 0").withColumnRenamed("doc_id", "__key")
        copies = scope.keep(copies, "copies")
    one = keyed.dropDuplicates(["__key"]).join(copies.hint("merge"), "__key")
    repeated = one.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))
