"""MinHash near-duplicates with SuperMinHash signatures.

A document's set holds its distinct 5-word shingles.  SuperMinHash gives every
shingle one random permutation of the signature's places; at rank j a shingle
offers ``j + r`` to its j-th place.  A place filled at rank j can only be beaten
by ranks up to j, so a document stops as soon as all places are filled, after
about ``m ln m`` offers instead of ``m`` per shingle.

Sets that are equal become one class before anything is compared.  Classes that
share a band meet in a bucket.  Inside a bucket no pairs are enumerated: members are
checked against one hub, then a second, and components are formed.  Members of
buckets that still hold several components are joined on their rarest shingles.
Links are confirmed on the full sets, so no unconfirmed pair joins a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, lists, settle, signed, splitmix, texts, windows, words
from .graph import components

SHINGLE = 5
BANDS, ROWS = 32, 4
PERCENT = 75

SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"
SETS = "doc_id long, shingles array<long>"


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row of a binary column."""
    hashes, first, _, _ = words(column)
    runs = windows(hashes, k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a:b - k + 1]))
        elif b > a:
            out.append(windows(hashes[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of ``m`` values per set; equal places estimate the similarity.

    All sets advance rank by rank together.  ``order`` holds the permutation of
    each shingle whose document still has an empty place.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    best = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    if not sizes.sum():
        return best
    owner = np.repeat(np.arange(len(sets)), sizes)
    seed = np.concatenate(sets)
    order = None
    for rank in range(m):
        draw = splitmix(seed + np.uint64(rank * 0x9E3779B1 + 1))
        swap = rank + ((draw >> np.uint64(40)) % np.uint64(m - rank)).astype(np.int64)
        if order is None:
            place = swap
        else:
            lines = np.arange(len(seed))
            place = order[lines, swap].astype(np.int64)
            order[lines, swap] = order[:, rank]
        value = (np.uint64(rank) << np.uint64(32)) | (splitmix(draw) >> np.uint64(32))
        np.minimum.at(best.reshape(-1), owner * m + place, value)
        open_rows = (best >> np.uint64(32) > np.uint64(rank)).any(axis=1)
        left = open_rows[owner]
        if not left.any():
            break
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint16), (int(left.sum()), 1))
            lines = np.arange(len(order))
            order[lines, swap[left]] = 0
            order[:, 0] = swap[left]
        else:
            order = order[left]
        owner, seed = owner[left], seed[left]
    return best


def _sketch(bands: int, rows: int):
    def run(batches: Batches) -> Batches:
        salts = splitmix(np.arange(bands, dtype=np.uint64) + np.uint64(7 << 32))
        for batch in batches:
            sets = shingle_sets(batch["text"])
            keys = np.zeros((len(sets), bands), np.uint64)
            at = 0
            while at < len(sets):
                to, total = at + 1, len(sets[at])
                while to < len(sets) and total + len(sets[to]) <= 60_000:
                    total += len(sets[to])
                    to += 1
                signature = superminhash(sets[at:to], bands * rows)
                for r in range(rows):
                    keys[at:to] = splitmix(keys[at:to] ^ signature[:, r::rows])
                at = to
            keys ^= salts
            one = np.array([splitmix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            two = np.array([splitmix(~s).sum(dtype=np.uint64) for s in sets], np.uint64)
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "d1": pa.array(signed(one)), "d2": pa.array(signed(two)),
                "bands": lists(signed(keys.reshape(-1)), np.full(len(sets), bands)),
            })
    return run


def _sets(batches: Batches) -> Batches:
    for batch in batches:
        sets = shingle_sets(batch["text"])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield pa.record_batch({
            "doc_id": batch["doc_id"],
            "shingles": lists(signed(flat), np.array([len(s) for s in sets], np.int64)),
        })


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs`` (u, v), checked on whole sets."""
    left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(left, "u").join(right, "v") \
        .where(100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v").distinct()


def _across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents in different components that can still be linked.

    ``placed`` has ``doc_id, n, component``.  Two sets of the wanted similarity must
    share one of their rarest shingles: of ``n`` shingles, rarest first, the first
    ``n - ceil(n * percent / 100) + 1``.  A passage that many documents share is not
    rare, so it pairs nobody.  The first shingle that a pair shares also bounds the
    whole overlap by what stands after it, so a document with many shingles of its own
    meets few others.  Of the documents behind one shingle, those in its
    most frequent component are only compared with those outside it.
    """
    sized = sets.withColumn("n", F.size("shingles").cast("long"))
    flat = settle(sized.join(placed, ["doc_id", "n"]).select(
        "doc_id", "s", "n", "component", F.explode("shingles").alias("g")), "flat")
    counts = settle(flat.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    ranked = flat.join(counts, "g", "left").withColumn("rank", F.row_number().over(
        Window.partitionBy("doc_id", "s").orderBy(F.coalesce("c", F.lit(1)), "g")))
    prefix = ranked.where(f"c is not null and rank <= n - ceil(n * {percent} / 100) + 1") \
        .select("doc_id", "n", "component", "g", (F.col("n") - F.col("rank") + 1).alias("rest"))
    prefix = settle(prefix, "prefix")
    main = prefix.groupBy("g", "component").agg(F.count("*").alias("c")).groupBy("g").agg(
        F.max(F.struct("c", "component"))["component"].alias("main"), F.count("*").alias("k")) \
        .where("k > 1").select("g", "main")
    main = settle(main, "main")
    outside = prefix.join(main, "g").where("component <> main")
    other = prefix.select("g", F.col("doc_id").alias("d2"), F.col("n").alias("n2"),
                          F.col("component").alias("c2"), F.col("rest").alias("rest2"))
    return outside.join(other, "g").where("component <> c2 and (c2 = main or doc_id < d2)") \
        .where(f"n * 100 >= n2 * {percent} and n2 * 100 >= n * {percent}") \
        .where(f"{100 + percent} * least(rest, rest2) >= {percent} * (n + n2)") \
        .select(F.least("doc_id", "d2").alias("u"), F.greatest("doc_id", "d2").alias("v")).distinct()


def _same_id(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between an id that stands over several texts and the classes of these."""
    rows = sketch.where("n_shingles > 0 and doc_id is not null").select("doc_id", "d1", "d2")
    several = rows.groupBy("doc_id").agg(
        F.min(F.struct("d1", "d2")).alias("lo"), F.max(F.struct("d1", "d2")).alias("hi")).where("lo <> hi")
    rows = rows.join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    return rows.join(classes.select("d1", "d2", "id"), ["d1", "d2"]).where("id <> doc_id").select(
        F.least("id", "doc_id").alias("u"), F.greatest("id", "doc_id").alias("v"))


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS,
                    percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Null and blank texts have an empty set and are linked with nothing.  Rows
    that repeat a ``doc_id`` keep their own line; they are one node, linked with whatever
    any of their texts is.  Rows with a null ``doc_id`` are not compared.  Other columns are ignored.

    A pair at the threshold is missed by the buckets with probability
    ``(1 - 0.75^rows)^bands``, 5e-6 at the defaults; bands and rows raise it at will.
    """
    source = texts(docs, "doc_id")
    sketch = settle(source.mapInArrow(_sketch(bands, rows), SKETCH), "sketch")
    classes = settle(
        sketch.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        ), "classes")
    members = settle(classes.select("id", "n", F.explode("bands").alias("bucket")), "buckets")
    hubs = settle(
        members.groupBy("bucket").agg(F.count("*").alias("c"), F.min("id").alias("hub"),
                                      F.max("id").alias("far"))
        .where("c > 1").select("bucket", "hub", "far"), "hubs")
    members = settle(members.join(hubs, "bucket"), "members")

    sizes = members.select(F.col("id").alias("hub"), F.col("n").alias("hn")).distinct()
    fits = F.col("n") * 100 >= F.col("hn") * percent
    fits &= F.col("hn") * 100 >= F.col("n") * percent

    def ordered(frame: DataFrame) -> DataFrame:
        return frame.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()

    ids = members.select(F.col("id").alias("doc_id")).distinct()
    sets = settle(source.where("doc_id is not null").join(ids, "doc_id", "left_semi")
                  .mapInArrow(_sets, SETS).withColumn("s", F.xxhash64("shingles"))
                  .dropDuplicates(["doc_id", "s"]), "sets")
    stars = members.where("id <> hub").select("id", "n", "hub").distinct().join(sizes, "hub").where(fits)
    tested = settle(ordered(stars), "pairs")
    links = settle(_confirm(tested, sets, percent).union(_same_id(sketch, classes)), "links")
    found = settle(components(links, "parts"), "parts")

    def mixed() -> DataFrame:
        """Members of buckets that still hold more than one component."""
        placed = members.join(found.withColumnRenamed("node", "id"), "id", "left") \
            .withColumn("component", F.coalesce("component", "id"))
        open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
            .where("lo < hi").select("bucket")
        return settle(placed.join(open_, "bucket", "left_semi").drop("hub"), "mixed")

    placed = mixed()
    far = placed.where("id = far").select(
        "bucket", F.col("id").alias("hub"), F.col("n").alias("hn"), F.col("component").alias("hc"))
    again = ordered(placed.join(far, "bucket").where("component <> hc").where(fits))
    tested = tested.union(again)
    again = settle(again.join(settle(tested.groupBy("u", "v").count().where("count = 1"), "pairs"),
                              ["u", "v"], "left_semi"), "pairs")
    links = links.union(settle(_confirm(again, sets, percent), "links"))
    found = settle(components(links, "parts"), "parts")

    placed = mixed().select(F.col("id").alias("doc_id"), "n", "component").distinct()
    rest = settle(_across(settle(placed, "left"), sets, percent), "pairs")
    links = links.union(settle(_confirm(rest, sets, percent), "links"))
    found = settle(components(links, "parts"), "parts")

    grouped = classes.join(found.withColumnRenamed("node", "id"), "id", "left") \
        .select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    grouped = settle(grouped, "classes")
    placed = sketch.select("doc_id", "n_shingles", "d1", "d2").join(
        grouped, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    return placed.select(
        "doc_id", "n_shingles", F.coalesce(component, "doc_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
