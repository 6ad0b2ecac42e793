"""Evaluate costly expressions exactly once per row, and keep plans small."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns that later filters and projections refer to but never copy.

    The optimizer pushes filters through a plain projection by pasting its
    expressions into them, and merges neighbouring projections.  For a regex
    over a whole page that multiplies both the work and the plan.  ``inline``
    over a one-element array gives one row per row and stops both rewrites, while
    column pruning and generated code still work.
    """
    keep = [c for c in df.columns if c not in columns and c not in drop]
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*keep, F.inline(packed))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def constant(data, schema: str) -> Column:
    """A nested constant; the optimizer folds it to a literal when planning.

    One call instead of one per element keeps plan building fast for long lists.
    """
    return F.from_json(F.lit(json.dumps(data)), F.lit(schema))
