"""Repeated passages by sorted suffixes of ``least`` words.

Suffixes are first sampled at content-selected positions: a position is kept when
the hash of its ``seed`` words is the least of some run of neighbouring positions
(a minimiser).  Equal text selects equal positions, so any two copies of a passage
of ``least`` words keep the same position early enough for ``KEY`` words, its key,
to follow inside the passage.  Only around keys that stand at two places or more
can text repeat: the suffixes whose first ``least`` words cover such a key are
sorted by these words, and equal ones are adjacent.

Every suffix that equals an earlier one in ``least`` words is a repeat, whatever
number of documents hold its key or its words.  The copy in the smallest (document,
position) stays; the others are marked.  A marked word therefore always has an
equal word in an earlier copy, and following the copies down ends at one that stays.

``least`` words are compared by a 64-bit hash.  Joins of a table that grows with the
corpus are planned as merge joins at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (
    Batches, bounded_batches, column_bytes, settle, signed, splitmix, texts, windows, words,
)

LEAST = 50
SEED = 5
KEY = 12
SLICE_ROWS = 200_000

STARTS = "doc_id long, key long, pos int"
SUFFIXES = "words long, doc_id long, pos int, body long"


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` entries."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:len(out) - step], out[step:])
        have += step
    return out


def _block(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` entries, by doubling."""
    parts, at, have, run = [], 0, hashes, 1
    while run <= size:
        if size & run:
            parts.append((have, at))
            at += run
        if run * 2 <= size:
            have = windows(have, 2) if run == 1 else _join(have[:-run], have[run:])
        run *= 2
    n = len(hashes) - size + 1
    out = parts[0][0][:n]
    for have, at in parts[1:]:
        out = _join(out, have[at:at + n])
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return splitmix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def retained(hashes: np.ndarray, first: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser positions with ``KEY`` words to their right, and the hash of these.

    ``hashes`` are the words of all rows of a batch and ``first`` the first word of
    each row.  A run of positions that spans two rows only adds positions.
    """
    width = least - KEY - seed + 1
    if len(hashes) < max(KEY, width + seed - 1):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = windows(hashes, seed)
    low = _sliding(seeds, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(padded, width, np.maximum)[:len(seeds)] == seeds)
    row_end = first[np.searchsorted(first, chosen, "right")]
    chosen = chosen[chosen + KEY <= row_end]
    return chosen, _block(hashes, KEY)[chosen]


def _starts(least: int, seed: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            hashes, first, _, _ = words(batch["text"])
            chosen, keys = retained(hashes, first, least, seed)
            row = np.searchsorted(first, chosen, "right") - 1
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)[row]
            yield pa.record_batch({
                "doc_id": pa.array(ids, pa.int64()), "key": pa.array(signed(keys)),
                "pos": pa.array((chosen - first[row]).astype(np.int32)),
            })
    return run


def _suffixes(least: int):
    """Every suffix whose first ``least`` words cover a place, with their hash."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            hashes, first, _, _ = words(batch["text"])
            if len(hashes) < least:
                continue
            places = batch["places"]
            row = np.repeat(np.arange(len(batch)), np.diff(places.offsets.to_numpy()))
            at = first[row] + places.flatten().to_numpy()
            low = np.maximum(at - (least - KEY), first[row])
            high = np.minimum(at, first[row + 1] - least)
            fits = high >= low  # not so at a place of another text with the same id
            steps = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(steps, low[fits], 1)
            np.add.at(steps, high[fits] + 1, -1)
            chosen = np.flatnonzero(np.cumsum(steps) > 0)
            row = np.searchsorted(first, chosen, "right") - 1
            found = pa.record_batch({
                "words": pa.array(signed(_block(hashes, least)[chosen])),
                "doc_id": batch["doc_id"].take(pa.array(row)),
                "pos": pa.array((chosen - first[row]).astype(np.int32)),
                "body": batch["body"].take(pa.array(row)),
            })
            for start in range(0, len(found), SLICE_ROWS):
                yield found.slice(start, SLICE_ROWS)
    return run


SCANNED = "doc_id long, pos int, body long, other long, words long, lead boolean"


def _table(words_, doc_id, pos, body, other=None, lead: bool = False) -> pa.RecordBatch:
    n = len(doc_id)
    return pa.record_batch({
        "doc_id": pa.array(doc_id, pa.int64()), "pos": pa.array(pos, pa.int32()), "body": pa.array(body, pa.int64()),
        "other": pa.nulls(n, pa.int64()) if other is None else pa.array(other, pa.int64()),
        "words": pa.nulls(n, pa.int64()) if words_ is None else pa.array(words_, pa.int64()),
        "lead": pa.array([lead] * n, pa.bool_()),
    })


def _scan(batches: Batches) -> Batches:
    """Compare each sorted suffix of a partition with the first that has its words.

    The words that a partition begins with may have started in an earlier one: their
    rows carry ``words`` and are decided against the leads, the first row of the first
    and of the last words of each partition (``lead``).
    """
    first_of, outer = None, None
    for batch in batches:
        if not len(batch):
            continue
        rows = [batch[c].to_numpy(zero_copy_only=False) for c in ("words", "doc_id", "pos", "body")]
        if first_of is None:
            first_of = outer = tuple(c[0] for c in rows)
            yield _table(*([x] for x in outer), lead=True)
        rows = [np.append(x, c) for x, c in zip(first_of, rows, strict=True)]
        name = rows[0]
        new = np.append(True, name[1:] != name[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
        later = np.zeros(len(name), bool)
        for c in rows[1:]:
            later |= c != c[first]
        edge = name == outer[0]
        later[0] = edge[0] = False  # carried over, not a row of this batch
        yield _table(*(c[edge] for c in rows))
        inside = later & ~edge
        yield _table(None, *(c[inside] for c in rows[1:]), other=rows[1][first[inside]])
        first_of = tuple(c[first[-1]] for c in rows)
    if first_of is not None:
        yield _table(*([x] for x in first_of), lead=True)


def repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """Marked spans of ``least`` words: ``doc_id, body, first, last, other`` in words,
    ``last`` exclusive.

    ``other`` is the document with the earliest copy.  A repeat inside one document
    counts too.  Spans of one document may overlap; ``marked`` unites them.  Null
    and short texts have none.  A null ``doc_id`` is skipped.  Rows that repeat an id
    are told apart by ``body``, the hash of the text; rows equal in both are one.
    """
    if least < KEY + 2 * seed:
        raise ValueError(f"least must be at least {KEY + 2 * seed}")
    source = texts(docs.where("doc_id is not null"), "doc_id")
    starts = source.mapInArrow(_starts(least, seed), STARTS)
    shared = settle(starts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    places = starts.join(shared.hint("merge"), "key", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    places = settle(places, "places")
    bodies = source.withColumn("body", F.xxhash64("text"))
    suffixes = bodies.join(places.hint("merge"), "doc_id").mapInArrow(_suffixes(least), SUFFIXES)
    order = ["words", "doc_id", "pos", "body"]
    ordered = bounded_batches(suffixes).repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = settle(ordered.mapInArrow(_scan, SCANNED), "scanned")
    row = F.struct("doc_id", "pos", "body")
    leads = scanned.where("lead").groupBy("words").agg(F.min(row).alias("lead_row"))  # two a partition at most
    found = scanned.where("not lead").drop("lead").join(F.broadcast(leads), "words", "left") \
        .where(F.col("lead_row").isNull() | (F.col("lead_row") != row))
    return found.select("doc_id", "body", F.col("pos").alias("first"), (F.col("pos") + least).alias("last"),
                        F.coalesce("lead_row.doc_id", "other").alias("other"))


def marked(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """One row per text with marked words: ``doc_id``, ``body``, its disjoint ``spans``
    (``first``, ``last`` exclusive, in words) and ``others``, the documents that
    hold the earliest copies."""
    found = repeats(docs, least, seed).groupBy("doc_id", "body").agg(
        F.sort_array(F.collect_set("first")).alias("s"), F.sort_array(F.collect_set("other")).alias("others"))
    begins = F.filter("s", lambda x, i: F.coalesce(x - F.get("s", i - 1) > least, F.lit(True)))
    ends = F.filter("s", lambda x, i: F.coalesce(F.get("s", i + 1) - x > least, F.lit(True)))
    spans = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), (b + least).alias("last")))
    return found.select("doc_id", "body", spans.alias("spans"), "others")


def _cut(batches: Batches) -> Batches:
    for batch in batches:
        hashes, first, begin, end = words(batch["text"])
        raw = batch["text"].to_pylist()
        _, rows = column_bytes(batch["text"])
        n, gone, kept = [], [], []
        for i, spans in enumerate(batch["spans"].to_pylist()):
            a, b = int(first[i]), int(first[i + 1])
            n.append(b - a)
            gone.append(sum(s["last"] - s["first"] for s in spans or ()))
            if not spans:
                kept.append(raw[i])
                continue
            base = int(rows[i])
            out, at = [], 0
            for s in spans:
                out.append(raw[i][at:int(begin[a + s["first"]]) - base])
                at = int(begin[a + s["last"]]) - base if a + s["last"] < b else int(end[b - 1]) - base
            out.append(raw[i][at:])
            kept.append(b"".join(out).strip())
        table = pa.Table.from_batches([batch]).drop_columns(["text"])
        table = table.append_column("text", pa.array(kept, pa.binary()).cast(pa.string()))
        table = table.append_column("n_words", pa.array(n, pa.int64()))
        table = table.append_column("removed_words", pa.array(gone, pa.int64()))
        yield from table.combine_chunks().to_batches()


def remove_marked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the words that ``found`` (of ``marked``) marks.

    Adds ``n_words``, ``removed_words``, ``spans`` and ``others``; a column of
    ``docs`` with such a name gives way.  A text without marks stays as it is (null:
    null); one that repeats earlier copies throughout becomes empty.
    """
    added = ("n_words", "removed_words", "spans", "others", "text")
    names = [c for c in docs.columns if c.lower() not in added]
    marks = found.select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), "spans", "others")
    joined = docs.select(*names, F.col("text").cast("binary").alias("text")).join(
        marks.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__body")), "left").select(
        *(F.col(f"`{c}`") for c in names),
        F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,last:int>>)")).alias("spans"),
        F.coalesce("others", F.expr("cast(array() as array<bigint>)")).alias("others"), "text")
    schema = T.StructType([f for f in joined.schema.fields if f.name != "text"])
    schema = schema.add("text", "string").add("n_words", "long").add("removed_words", "long")
    return bounded_batches(joined).mapInArrow(_cut, schema)


def remove_repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """``docs`` without their repeats; see ``marked`` and ``remove_marked``."""
    return remove_marked(docs, settle(marked(docs, least, seed), "marked"))
