"""Helpers that several training-data operators share.

Words are maximal runs of bytes outside ASCII white space, compared with A-Z
lower-cased.  ``words`` finds and hashes all words of an Arrow column at once
with array operations, so no Python object is made per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BATCH_BYTES = "16m"
BATCH_ROWS = "2000"
SLICE = 1 << 20


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share, or where
    that is unset in the session's warehouse, which is shared as well."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Scope:
    """Tables settled inside it are removed at its end, but for those it ``keep``s."""

    open: list[Scope] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        Scope.open.append(self)
        return self

    def __exit__(self, *error) -> None:
        Scope.open.remove(self)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Settle what is read after the scope; it must not be read back from a scope's table."""
        return _written(df, shared_dir(self.spark, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table that later steps read more than once, and read it back."""
    path = shared_dir(df.sparkSession, label)
    if Scope.open:
        Scope.open[-1].paths.append(path)
    return _written(df, path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches sent to Python by bytes, whatever the row length."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the text as bytes (null: empty)."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    return bounded_batches(docs).select(*keep, text)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    codes = splitmix(np.arange(256, dtype=np.uint64))
    codes[65:91] = codes[97:123]
    codes[[32, 9, 10, 11, 12, 13]] = 0
    return codes


BYTE = _byte_codes()
IS_WORD = BYTE != 0


def multipliers(n: int) -> np.ndarray:
    """Odd position multipliers of the multilinear hashes."""
    return splitmix(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each row starts (and the last ends)."""
    if column.null_count:
        column = pc.fill_null(column, b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash every word of a binary column.

    Returns the word hashes, the first word of each row (one entry more than
    rows), and the byte positions at which each word starts and ends, counted
    from the start of the column.
    """
    data, rows = column_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64), none, none
    inside = IS_WORD[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[rows[:-1][rows[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[rows[1:][rows[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, "right")))
        base, stop = starts[at], ends[to - 1]
        local = starts[at:to] - base
        spans = np.diff(np.append(local, stop - base))
        place = np.arange(stop - base) - np.repeat(local, spans)
        terms = BYTE[data[base:stop]] * multipliers(int(spans.max()))[place]
        hashes[at:to] = np.add.reduceat(terms, local)
        at = to
    return splitmix(hashes), np.searchsorted(starts, rows), starts, ends


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, np.uint64)
    for j, factor in enumerate(multipliers(k)):
        total += hashes[j:j + n] * factor
    return splitmix(total + np.uint64(k))


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


Batches = Iterator[pa.RecordBatch]
