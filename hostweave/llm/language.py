"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text knows every substring of it.
A text is parsed greedily into the longest phrases that the automaton knows; a
text in the same language needs few of them.  The language with the fewest phrases,
normalised by the size of its training text, wins.

Automata are transition tables, each over all characters of its own training text.  Blocks of many texts are
parsed side by side: one array operation advances every block by one character, so
no Python step is made per character.  A text longer than a block is parsed block
by block in full, which adds at most one phrase per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, bounded_batches

TRAIN_CHARS = 24_000
TRAIN_DOCS = 60
DOC_CHARS = 600
DENSE = 64
BLOCK = 512
UNKNOWN = "und"

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def prepared(text: Column) -> Column:
    """Lower case, with each run of anything but letters as one space."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]+", " "))


class Automaton:
    """Suffix automaton of one string over small integers, as a transition table.

    ``table[state * width + symbol]`` is the next state; the top bit says that the
    phrase ended before the symbol and a new one starts with it.  The last state is
    that of a symbol the string does not hold, which is a phrase of its own.
    """

    def __init__(self, symbols: list[int], width: int):
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for s in symbols:
            new = len(step)
            step.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at != -1 and s not in step[at]:
                step[at][s] = new
                at = link[at]
            if at != -1:
                to = step[at][s]
                if length[at] + 1 == length[to]:
                    link[new] = to
                else:
                    copy = len(step)
                    step.append(dict(step[to]))
                    link.append(link[to])
                    length.append(length[at] + 1)
                    while at != -1 and step[at].get(s) == to:
                        step[at][s] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
        self.width, begin = width, np.full(width, len(step), np.uint32)
        for s, to in step[0].items():
            begin[s] = to
        self.begin, self.table = begin, None
        if width <= DENSE:
            table = np.tile(begin | np.uint32(1 << 31), (len(step) + 1, 1))
            for state, out in enumerate(step):
                for s, to in out.items():
                    table[state, s] = to
            table[0] = begin
            self.table = table.reshape(-1)
        else:
            edges = sorted((state * width + s, to) for state, out in enumerate(step) for s, to in out.items())
            self.edges, self.to = (np.array(x, t) for x, t in zip(zip(*edges, strict=True), (np.int64, np.uint32), strict=True))
        self.size = len(symbols)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states.  A wide table is mostly empty, so only its entries are kept."""
        key = state * self.width + symbol
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        begin = self.begin[symbol]
        return np.where(self.edges[at] == key, self.to[at], np.where(state == 0, begin, begin | np.uint32(1 << 31)))


class Classifier:
    """Automata of all languages, each over the characters of its own sample.

    Texts are coded once over the characters of all samples; ``own`` turns these
    codes into the symbols of a language, the last of which means an unknown one.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.points = np.array(sorted({ord(c) for text in samples.values() for c in text}), np.uint32)
        self.own, self.automata = [], []
        for name in self.languages:
            coded = self.symbols(samples[name])
            letters = np.unique(coded)
            own = np.full(len(self.points) + 1, len(letters), np.int32)
            own[letters] = np.arange(len(letters))
            self.own.append(own)
            self.automata.append(Automaton(own[coded].tolist(), len(letters) + 1))

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(self.points):
            return np.zeros(len(points), np.int32)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at, len(self.points)).astype(np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Normalised phrases per text (rows) and language (columns)."""
        coded = self.symbols("".join(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + nth * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        live = np.searchsorted(-length, -np.arange(BLOCK), "left")
        total = np.zeros((len(texts), len(self.languages)))
        states = [np.zeros(len(begin), np.int64) for _ in self.automata]
        ends = [np.zeros(len(begin), np.int64) for _ in self.automata]
        for step in range(int(length.max()) if len(length) else 0):
            n = live[step]
            symbol = coded[begin[:n] + step]
            for state, ended, own, automaton in zip(states, ends, self.own, self.automata, strict=True):
                to = automaton.follow(state[:n], own[symbol])
                ended[:n] += to >> np.uint32(31)
                state[:n] = to & np.uint32(0x7FFFFFFF)
        for k, (ended, automaton) in enumerate(zip(ends, self.automata, strict=True)):
            np.add.at(total[:, k], owner, (ended + 1) * np.log2(automaton.size + 2))
        return total


def _predict(classifier: Classifier):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [t or "" for t in batch["prepared"].to_pylist()]
            n = len(texts)
            names, scores = [UNKNOWN] * n, [0.0] * n
            at = 0
            while at < n and classifier.languages:
                to, size = at + 1, len(texts[at])
                while to < n and size + len(texts[to]) <= 4_000_000:
                    size += len(texts[to])
                    to += 1
                cost = classifier.phrases(texts[at:to])
                for i, row in enumerate(cost, at):
                    if texts[i].strip():
                        best = int(row.argmin())
                        names[i] = classifier.languages[best]
                        others = np.delete(row, best)
                        scores[i] = float(1 - row[best] / others.min()) if len(others) and others.min() > 0 else 1.0
                at = to
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                   "lang_pred": pa.array(names), "score": pa.array(scores, pa.float64())})
    return run


def train(labelled: DataFrame, chars: int = TRAIN_CHARS, docs: int = TRAIN_DOCS,
          doc_chars: int = DOC_CHARS) -> Classifier:
    """Fit on a bounded sample: per language at most ``docs`` documents, chosen by a
    hash of the text, ``doc_chars`` characters of each and ``chars`` in all.

    ``labelled`` has ``text`` and ``lang``; null languages and texts without letters
    are left out.  Equal texts of a language count once.
    """
    rows = labelled.where("lang is not null and text is not null").select(
        "lang", F.substring(prepared(F.col("text")), 1, doc_chars).alias("t"), F.xxhash64("text").alias("h"))
    first = Window.partitionBy("lang").orderBy("h", "t")
    sample = rows.where("trim(t) <> ''").withColumn("k", F.row_number().over(first)).where(F.col("k") <= docs)
    texts: dict[str, dict[int, str]] = {}
    for row in sample.collect():
        texts.setdefault(row["lang"], {})[row["h"]] = row["t"]
    return Classifier({lang: " ".join(t for _, t in sorted(found.items()))[:chars]
                       for lang, found in texts.items()})


def identify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Texts that are null or hold no letter get ``und`` and 0, as does everything if
    no language was learned.  ``score`` is the share of phrases that the winner saves
    against the next language; equal counts go to the first name and score 0.  The
    classifier travels with the tasks; its size is bounded by ``train``.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = bounded_batches(docs).select(
        "doc_id", "held_out", F.when(letters, prepared(F.col("text"))).otherwise("").alias("prepared"))
    return rows.mapInArrow(_predict(classifier), RESULT)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from rows whose ``crc32(doc_id) mod 4`` is not 2; predict all rows.

    A null ``doc_id`` is neither learned from nor held out.
    """
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held = docs.select("doc_id", "text", "lang", F.coalesce(rest == 2, F.lit(False)).alias("held_out"))
    learned = held.where("doc_id is not null and not held_out")
    return identify(held, train(learned))
