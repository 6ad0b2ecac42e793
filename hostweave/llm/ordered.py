"""Document fingerprints by Order MinHash.

A text's k-mers (runs of ``K`` code points) are numbered by occurrence, so the
second copy of a k-mer differs from the first.  Every numbered k-mer gets a hash;
its low bits assign it to one of ``SKETCHES`` sketches.  In each sketch the
``TUPLE`` k-mers of least hash are selected, put back into the order of the text,
and hashed together.  Two texts agree in a sketch only if they share these k-mers
in the same order, so equal sketches grow rare with their edit distance.

One pass over a text fills all sketches; nothing but the current text is held.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, multipliers, settle, splitmix
from .neighbours import next_edges

K = 8
SKETCHES = 64
TUPLE = 2


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmers(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` code points; the whole text if it is shorter."""
    k = min(k, len(points))
    n = len(points) - k + 1 if len(points) else 0
    wide = splitmix(points) if len(points) < 256 else _point_codes(points)
    total = np.zeros(n, np.uint64)
    for j, factor in enumerate(multipliers(k)):
        total += wide[j:j + n] * factor
    return splitmix(total)


def _point_codes(points: np.ndarray) -> np.ndarray:
    top = int(points.max()) + 1
    return splitmix(np.arange(top, dtype=np.uint64))[points] if top <= 1 << 16 else splitmix(points)


def sketch(points: np.ndarray, k: int = K, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """The signature of a text: one 16-bit hash per sketch, 0 where a sketch is empty.

    A sketch with fewer than ``size`` k-mers hashes those it has.
    """
    out = np.zeros(sketches, np.uint16)
    hashes = kmers(points, k)
    n = len(hashes)
    if not n:
        return out
    place = np.argsort(hashes, kind="stable")
    name = hashes[place]
    new = np.append(True, name[1:] != name[:-1])
    if new.all():
        ranked = splitmix(name)
    else:
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        ranked = splitmix(name + (np.arange(n) - first).astype(np.uint64))
    group = (ranked & np.uint64(sketches - 1)).astype(np.int64)
    # Only the smallest ranks can be selected: look below a bound that nearly always
    # leaves enough in every sketch, and at everything where it does not.
    want = sketches * size
    if n > 16 * want:
        near = np.flatnonzero(ranked < np.uint64(int(2.0 ** 64 * min(1.0, 8 * want / n))))
        if np.bincount(group[near], minlength=sketches).min() < size:
            near = np.arange(n)
    else:
        near = np.arange(n)
    ranked, group, place, name = ranked[near], group[near], place[near], name[near]
    order = np.lexsort((ranked, group))
    group = group[order]
    start = np.searchsorted(group, np.arange(sketches))
    chosen = order[np.arange(len(order)) - start[group] < size]
    sketch_of = np.repeat(np.arange(sketches), np.minimum(size, np.bincount(group, minlength=sketches)))
    by_text = np.lexsort((place[chosen], sketch_of))
    picked, sketch_of = ranked[chosen][by_text], sketch_of[by_text]
    step = np.arange(len(picked)) - np.searchsorted(sketch_of, sketch_of)
    sums = np.zeros(sketches, np.uint64)
    np.add.at(sums, sketch_of, picked * multipliers(size)[step])
    filled = np.bincount(sketch_of, minlength=sketches) > 0
    codes = (splitmix(sums) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return np.where(filled, codes, out)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two texts from 0 to 1, from the share of equal sketches.

    Only sketches that either text fills count; 1 if none does.  A sketch is equal if
    all its k-mers are, so the root brings the share back to the scale of one k-mer.
    """
    used = (a > 0) | (b > 0)
    return float((a[used] == b[used]).mean() ** (1 / TUPLE)) if used.any() else 1.0


def as_bytes(signature: np.ndarray) -> bytes:
    return signature.astype(">u2").tobytes()


def as_text(signature: np.ndarray) -> str:
    return as_bytes(signature).hex()


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` with ``fingerprint``; equal texts have equal ones, null counts as empty."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            made = [as_text(sketch(code_points(t or ""), k)) for t in batch["text"].to_pylist()]
            table = pa.Table.from_batches([batch])
            yield from table.append_column("fingerprint", pa.array(made, pa.string())).combine_chunks().to_batches()

    names = [c for c in docs.columns if c.lower() != "fingerprint"]
    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    schema = rows.schema.add("fingerprint", "string")
    return bounded_batches(rows).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, "
          "edited_fingerprint binary, near_edited double, near_next double")
EDGED = RESULT + ", part int, first boolean, last boolean, text string"


class _Row:
    __slots__ = ("doc_id", "signature", "text")

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.signature = sketch(code_points(text))

    def against(self, following: str, signature: np.ndarray) -> tuple:
        changed = edited(self.text, following)
        other = sketch(code_points(changed))
        return (self.doc_id, len(self.text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                as_bytes(self.signature), as_bytes(other), likeness(self.signature, other),
                likeness(self.signature, signature))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(),
          pa.int32(), pa.bool_(), pa.bool_(), pa.string()]


def _rows(lines: list[tuple], schema: str) -> pa.RecordBatch:
    names = _names(schema)
    columns = list(zip(*lines, strict=True)) if lines else [[]] * len(names)
    return pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, columns, _KINDS, strict=False)})


def _beside(batches: Batches) -> Batches:
    before, part, started = None, None, False
    for batch in batches:
        done = []
        for doc_id, text, part in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(),
                                      batch["part"].to_pylist(), strict=True):
            row = _Row(doc_id, text)
            if not started:
                started = True
                done.append((doc_id, len(text), None, as_bytes(row.signature), None, None, None, part, True, False, text))
            if before is not None:
                done.append((*before.against(text, row.signature), part, False, False, None))
            before = row
        yield _rows(done, EDGED)
    if before is not None:
        yield _rows([(before.doc_id, len(before.text), None, as_bytes(before.signature), None, None, None,
                      part, False, True, before.text)], EDGED)


def _last_rows(batches: Batches) -> Batches:
    for batch in batches:
        done = []
        for doc_id, text, following, signature in zip(*(
                batch[c].to_pylist() for c in ("doc_id", "text", "following", "signature")), strict=True):
            done.append(_Row(doc_id, text).against(following, np.frombuffer(signature, ">u2")))
        yield _rows(done, RESULT)


def compared(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint against that of its edited text and of the next text.

    Rows are ordered by descending ``doc_id`` (nulls last; ties by text); after the
    last comes the first.  A single row is its own next.
    """
    rows = bounded_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.desc_nulls_last("doc_id"), F.col("text")]
    ordered = rows.repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(*keys)
    beside = settle(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_beside, EDGED), "order")
    inside = beside.where("not first and not last").select(*_names(RESULT))
    edges = next_edges(beside.where("first or last").select("part", "first", "doc_id", "text", "fingerprint"))
    edges = settle(edges, "edges")
    count = edges.agg(F.max("place")).first()[0] or 0
    firsts = edges.where("first").select(
        F.when(F.col("place") == 1, count).otherwise(F.col("place") - 1).alias("place"),
        F.col("text").alias("following"), F.col("fingerprint").alias("signature"))
    lasts = edges.where("not first").select("place", "doc_id", "text").join(firsts, "place")
    out = inside.union(lasts.mapInArrow(_last_rows, RESULT))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
