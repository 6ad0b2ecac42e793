"""Connected components of a link table, kept distributed throughout."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, settle

LINKS = "u long, v long"


def _forest(batches: Batches) -> Batches:
    """Union-find inside one partition: each node that has links, with its root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    for at in range(0, len(pairs), 50_000):
        u, v = zip(*pairs[at:at + 50_000], strict=True)
        yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _rewire(links: DataFrame) -> DataFrame:
    """Point each node and all nodes next to it at the smallest of them."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.where("m < u").select("u", F.col("m").alias("v"))
    return out.union(kept).where("u <> v").distinct()


def components(links: DataFrame, label: str) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every linked node.

    Union-find inside each partition first shrinks the links to forests; rounds
    that point every node at the smallest neighbour then join the forests.  Each
    round is written to the shared folder, so lineage stays short.  Rounds grow
    with the logarithm of a component's diameter, not with its size.
    """
    current = settle(links.select("u", "v").where("u <> v").mapInArrow(_forest, LINKS), label)
    mark = None
    while True:
        stars = settle(_rewire(current), label)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        current, mark = stars, tuple(now)
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("component"))) \
        .groupBy("node").agg(F.min("component").alias("component"))
