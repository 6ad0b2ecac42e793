"""Rows in a global order, each seen together with the rows beside it.

Rows are range-partitioned and sorted once.  A worker sees the row before and the
row after each row of its partition; only the first and last row of a partition
lack a neighbour, and these few are completed by a join of one edge row per side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_edges(edges: DataFrame) -> DataFrame:
    """``edges`` (with ``part`` and ``first``: is it the first row of its partition)
    with ``place``, the rank of its partition among those that have rows.

    Only partition numbers are ranked, one per partition.
    """
    parts = edges.select("part").distinct().withColumn("place", F.row_number().over(Window.orderBy("part")))
    return edges.join(parts, "part")
