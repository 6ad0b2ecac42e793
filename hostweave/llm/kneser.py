"""Interpolated modified Kneser-Ney word model, order two.

Counting is spread over a square grid: a pair (previous word, word) belongs to the
cell of its two word hashes.  A map task counts the pairs of a stretch of text and
sends each cell one packed block; the cell adds the blocks up.  A frequent word
lies on a whole row and column of cells, so no cell grows with it.  Cells then pass
on what each word needs (its contexts, its continuations), summed per word part.

Counts are stored as arrays sorted by hash in the shared folder.  Scoring workers
map these files into memory and search them; nothing is broadcast, and the pages
that several workers read are held once per machine.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, settle, shared_dir, splitmix, texts, words

START, END = (int(x) for x in splitmix(np.array([1 << 50, (1 << 50) + 1], np.uint64)))
STRETCH = 4_000_000
CELL_BYTES = 24_000_000

BLOCKS = "cell int, block binary"
CELLS = "part int, block binary, keys string, counts string, n1 long, n2 long, n3 long, n4 long"
PARTS = ("part int, words string, table string, v long, tokens long, types long, "
         "n1 long, n2 long, n3 long, n4 long")


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that all scores need."""

    grid: int
    keys: tuple
    counts: tuple
    words: tuple
    tables: tuple
    tokens: int
    vocabulary: int
    types: int
    pair_discounts: tuple
    word_discounts: tuple
    spread: float


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary, each in the narrowest unsigned type that holds it."""
    out = []
    for array in arrays:
        top = int(array.max()) if len(array) else 0
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(k[2]))
        out.append(np.array([int(kind[2]), len(array)], "<u8").tobytes() + array.astype(kind).tobytes())
    return b"".join(out)


def _unpack(block: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(block):
        size, n = (int(x) for x in np.frombuffer(block, "<u8", 2, at))
        out.append(np.frombuffer(block, f"<u{size}", n, at + 16))
        at += 16 + size * n
    return out


def pair_key(previous: np.ndarray, word: np.ndarray) -> np.ndarray:
    return splitmix(previous * np.uint64(0xD6E8FEB86659FD93) + word)


def cell_of(previous: np.ndarray, word: np.ndarray, grid: int) -> np.ndarray:
    g, shift = np.uint64(grid), np.uint64(40)
    return ((previous >> shift) % g * g + (word >> shift) % g).astype(np.int64)


def part_of(word: np.ndarray, grid: int) -> np.ndarray:
    return ((word >> np.uint64(20)) % np.uint64(grid)).astype(np.int64)


def token_stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows with an end after each row, the word before each, and the
    first token of each row."""
    hashes, first, _, _ = words(column)
    rows = len(first) - 1
    starts = first[:-1] + np.arange(rows)
    tokens = np.full(len(hashes) + rows, END, np.uint64)
    place = np.arange(len(hashes)) + np.searchsorted(first[1:], np.arange(len(hashes)), "right")
    tokens[place] = hashes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = START
    return tokens, before, starts


def _count(grid: int):
    def flush(tokens: list[np.ndarray], before: list[np.ndarray]) -> Batches:
        word, prior = np.concatenate(tokens), np.concatenate(before)
        vocabulary, code = np.unique(np.concatenate([word, prior]), return_inverse=True)
        code = code.astype(np.int64)
        pairs, count = np.unique(code[:len(word)] << 32 | code[len(word):], return_counts=True)
        b, a = pairs >> 32, pairs & 0xFFFFFFFF
        cell = cell_of(vocabulary[a], vocabulary[b], grid)
        order = np.argsort(cell, kind="stable")
        cuts = np.searchsorted(cell[order], np.arange(grid * grid + 1))
        ids, blocks = [], []
        for i in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[i]:cuts[i + 1]]
            ub, ib = np.unique(b[rows], return_inverse=True)
            ua, ia = np.unique(a[rows], return_inverse=True)
            ids.append(int(i))
            blocks.append(_pack(vocabulary[ub], ib, vocabulary[ua], ia, count[rows]))
        for at in range(0, len(ids), 16):
            yield pa.record_batch({"cell": pa.array(ids[at:at + 16], pa.int32()),
                                   "block": pa.array(blocks[at:at + 16], pa.binary())})

    def run(batches: Batches) -> Batches:
        tokens, before, held = [], [], 0
        for batch in batches:
            t, b, _ = token_stream(batch["text"])
            tokens.append(t)
            before.append(b)
            held += len(t)
            if held >= STRETCH:
                yield from flush(tokens, before)
                tokens, before, held = [], [], 0
        if held:
            yield from flush(tokens, before)
    return run


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def write_array(folder: str, array: np.ndarray) -> str:
    """Store an array under a fresh name in the shared folder and return its path.

    A retried task writes another file; only the path that its finished attempt
    returned is ever read.
    """
    path = f"{folder}/{uuid.uuid4().hex}.npy"
    local = _local(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        np.save(local, array)
        return path
    from pyarrow import fs
    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    with system.open_output_stream(name) as out:
        np.save(out, array)
    return path


def map_array(path: str) -> np.ndarray:
    """Map a stored array into memory; one on a remote store is fetched first."""
    local = _local(path)
    if local is None:
        from pyarrow import fs
        system, name = fs.FileSystem.from_uri(path)
        local = os.path.join(tempfile.gettempdir(), os.path.basename(name))
        if not os.path.exists(local):
            part = f"{local}.{uuid.uuid4().hex}"
            fs.copy_files(name, part, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
            os.replace(part, local)
    return np.load(local, mmap_mode="r")


def _narrow(array: np.ndarray) -> np.ndarray:
    return array.astype(np.uint32) if not array.size or int(array.max()) < 1 << 32 else array.astype(np.uint64)


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _merge_cell(folder: str, grid: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b, n = [], [], []
        for block in table["block"].to_pylist():
            ub, ib, ua, ia, count = _unpack(block)
            a.append(ua[ia])
            b.append(ub[ib])
            n.append(count.astype(np.int64))
        a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n)
        keys = pair_key(a, b)
        order = np.argsort(keys)
        keys = keys[order]
        lead = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.add.reduceat(n[order], lead)
        a, b, keys = a[order][lead], b[order][lead], keys[lead]
        out = {c: [] for c in ("part", "block")}
        ua, ia = np.unique(a, return_inverse=True)
        contexts = [np.bincount(ia, w, len(ua)).astype(np.int64)
                    for w in (counts, counts == 1, counts == 2, counts > 2)]
        ub, ib = np.unique(b, return_inverse=True)
        seen = [np.bincount(ib, w, len(ub)).astype(np.int64) for w in (np.ones(len(b)), counts)]
        pa_, pb = part_of(ua, grid), part_of(ub, grid)
        for p in range(grid):
            x, y = pa_ == p, pb == p
            if x.any() or y.any():
                out["part"].append(p)
                out["block"].append(_pack(ua[x], *(c[x] for c in contexts), ub[y], *(s[y] for s in seen)))
        rows = len(out["part"])
        rest = [None] * (rows - 1)
        paths = write_array(folder, keys), write_array(folder, _narrow(counts))
        n1, n2, n3, n4 = _tally(counts)
        return pa.table({
            "part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.binary()),
            "keys": pa.array([f"{key[0].as_py()}|{paths[0]}", *rest], pa.string()),
            "counts": pa.array([paths[1], *rest], pa.string()),
            **{c: pa.array([v, *[0] * (rows - 1)], pa.int64())
               for c, v in zip(("n1", "n2", "n3", "n4"), (n1, n2, n3, n4), strict=True)},
        })
    return run


def _merge_part(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        word, rows = [], []
        for block in table["block"].to_pylist():
            ua, total, m1, m2, m3, ub, continued, raw = _unpack(block)
            for names, columns in ((ua, (2, 3, 4, 5)), (ub, (0, 1))):
                values = np.zeros((len(names), 6), np.int64)
                for c, v in zip(columns, (total, m1, m2, m3) if len(columns) == 4 else (continued, raw), strict=True):
                    values[:, c] = v
                word.append(names)
                rows.append(values)
        word, rows = np.concatenate(word), np.concatenate(rows)
        order = np.argsort(word)
        word = word[order]
        lead = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        rows = np.add.reduceat(rows[order], lead, axis=0)
        n1, n2, n3, n4 = _tally(rows[:, 0])
        return pa.table({
            "part": pa.array([key[0].as_py()], pa.int32()),
            "words": pa.array([write_array(folder, word[lead])]),
            "table": pa.array([write_array(folder, _narrow(rows))]),
            "v": pa.array([int((rows[:, 1] > 0).sum())], pa.int64()),
            "tokens": pa.array([int(rows[:, 1].sum())], pa.int64()),
            "types": pa.array([int(rows[:, 0].sum())], pa.int64()),
            **{c: pa.array([v], pa.int64()) for c, v in zip(("n1", "n2", "n3", "n4"), (n1, n2, n3, n4), strict=True)},
        })
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more.

    Where a count of counts is zero the plain values 0.5, 1 and 1.5 stand in.
    """
    plain = (0.5, 1.0, 1.5)
    if not (n1 and n2):
        return plain
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def fit(docs: DataFrame) -> Model:
    """Count all of ``docs`` (column ``text``; null counts as empty)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grid = max(1, int(np.ceil(np.sqrt(size / CELL_BYTES))))
    folder = shared_dir(spark, "ngrams")
    blocks = texts(docs).mapInArrow(_count(grid), BLOCKS)
    cells = settle(blocks.groupBy("cell").applyInArrow(_merge_cell(folder, grid), CELLS), "cells")
    at = cells.where("keys is not null").select("keys", "counts", "n1", "n2", "n3", "n4").collect()
    parts = cells.select("part", "block").groupBy("part").applyInArrow(_merge_part(folder), PARTS).collect()
    keys, counts = {}, {}
    for row in at:
        cell, path = row["keys"].split("|", 1)
        keys[int(cell)], counts[int(cell)] = path, row["counts"]
    by_part = {row["part"]: row for row in parts}
    totals = {c: sum(row[c] for row in parts) for c in ("v", "tokens", "types", "n1", "n2", "n3", "n4")}
    word_discounts = discounts(*(totals[f"n{k}"] for k in range(1, 5)))
    kinds = totals["n1"], totals["n2"], totals["v"] - totals["n1"] - totals["n2"]
    mass = sum(d * n for d, n in zip(word_discounts, kinds, strict=True))
    return Model(
        grid=grid,
        keys=tuple(keys.get(i) for i in range(grid * grid)), counts=tuple(counts.get(i) for i in range(grid * grid)),
        words=tuple(by_part[p]["words"] if p in by_part else None for p in range(grid)),
        tables=tuple(by_part[p]["table"] if p in by_part else None for p in range(grid)),
        tokens=totals["tokens"], vocabulary=totals["v"], types=totals["types"],
        pair_discounts=discounts(*(sum(row[f"n{k}"] for row in at) for k in range(1, 5))),
        word_discounts=word_discounts,
        spread=mass / totals["types"] if totals["types"] else 1.0,
    )


class Lookup:
    """The stored arrays of a model, mapped into this worker's memory."""

    def __init__(self, model: Model):
        self.model = model
        self.open: dict[str, np.ndarray] = {}

    def _array(self, path: str) -> np.ndarray:
        if path not in self.open:
            self.open[path] = map_array(path)
        return self.open[path]

    def _find(self, wanted, group, names, values, width) -> np.ndarray:
        out = np.zeros((len(wanted), width), np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(names) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            if names[i] is None:
                continue
            rows = order[cuts[i]:cuts[i + 1]]
            stored = self._array(names[i])
            at = np.minimum(np.searchsorted(stored, wanted[rows]), len(stored) - 1)
            hit = stored[at] == wanted[rows]
            out[rows[hit]] = np.asarray(self._array(values[i])[at[hit]]).reshape(-1, width)
        return out

    def words(self, wanted: np.ndarray) -> np.ndarray:
        """Per word: continuations, count, and as context total, once, twice, more."""
        m = self.model
        return self._find(wanted, part_of(wanted, m.grid), m.words, m.tables, 6)

    def pairs(self, previous: np.ndarray, word: np.ndarray) -> np.ndarray:
        m, key = self.model, pair_key(previous, word)
        cell = cell_of(previous, word, m.grid)
        return self._find(key, cell, m.keys, m.counts, 1)[:, 0]

    def log10(self, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each token after the one before it, and its count."""
        m = self.model
        distinct, code = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        table = self.words(distinct)
        word, prior = code[:len(tokens)], code[len(tokens):]
        pairs, back = np.unique(word << 32 | prior, return_inverse=True)
        w, p = table[pairs >> 32], table[pairs & 0xFFFFFFFF]
        count = self.pairs(distinct[pairs & 0xFFFFFFFF], distinct[pairs >> 32])
        lower = _discounted(w[:, 0], m.word_discounts) / max(m.types, 1) + m.spread / (m.vocabulary + 1)
        total = np.maximum(p[:, 2], 1)
        left = p[:, 3:6] @ np.array(m.pair_discounts) / total
        upper = _discounted(count, m.pair_discounts) / total
        seen = p[:, 2] > 0
        chance = np.where(seen, upper + left * lower, lower)
        return np.log10(chance)[back], table[word, 1]


def _discounted(counts: np.ndarray, cut: tuple) -> np.ndarray:
    steps = np.array([0.0, *cut])
    return counts - steps[np.minimum(counts, 3)]


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double, perplexity double")


def _score(model: Model):
    def run(batches: Batches) -> Batches:
        lookup = Lookup(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, before, starts = token_stream(batch["text"])
            logs, count = lookup.log10(tokens, before)
            n = np.diff(np.append(starts, len(tokens)))
            base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
            score = np.add.reduceat(logs, starts)
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(n), model.tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(base, starts)), "score": pa.array(score),
                "perplexity": pa.array(10 ** (-score / n)),
            })
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every row of ``docs`` (``doc_id``, ``text``, ``held_out``)."""
    return texts(docs, "doc_id", "held_out").mapInArrow(_score(model), SCORES)


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose ``crc32(doc_id) mod 10`` is not 0; score all rows.

    Null and empty texts hold the end token alone.  Without any training row every
    token has the chance of an unknown one.  A null ``doc_id`` counts as held out.
    """
    split = docs.select("doc_id", "text", (F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(0)) == 0).alias("held_out"))
    return score(split, fit(split.where("not held_out")))
