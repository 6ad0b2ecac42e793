"""Spelling variants by composition of finite-state machines.

The vocabulary's minimal acceptor is composed with a transducer for one edit and
with the acceptor again; accepted pairs are words one edit apart.

No machine for the whole vocabulary is built.  One edit leaves one half of a word
as it is, so pairs are looked for among words that share a half: each such group is
the composed machine started in the state that the shared half leads to, and
groups are dealt to tasks.  A group of more than ``GROUP`` words is split in the
same way, by halves of what its words don't share, until it is small or only one
place is left to differ, where the alphabet bounds its size.  The edit is taken as
far right as it can lie, so each pair of words is accepted in one group only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bounded_batches, settle

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, SELDOM, FACTOR, THINNED = 6, 5, 5, 199
GROUP = 2_000

LINKS = "word string, n long, near string, near_n long"


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of the words of all texts (null: none).

    A run of letters in a document whose crc32 of ``doc_id:run`` is divisible by
    ``THINNED`` loses one letter first (never where ``doc_id`` is null).  Only words
    of ``SHORTEST`` letters that occur ``SELDOM`` times count; repeated rows count.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= SHORTEST)
    word = F.translate("run", UPPER, LOWER)
    code = F.crc32(F.concat("id", F.lit(":"), "word"))
    at = (F.col("code") % F.length("word")).cast("int")
    thinned = F.when(F.col("code") % THINNED == 0,
                     F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word"))))
    words = runs.select("id", word.alias("word")).select("word", code.alias("code"))
    words = words.select(F.coalesce(thinned, F.col("word")).alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= SELDOM)


def _whole(words: DataFrame) -> DataFrame:
    """Each word as one of its own length, and as the longer one of a pair.

    ``base`` is the shorter word's number of open letters and ``rest`` this word's.
    """
    size = F.length("word")
    return words.select("word", "n", F.explode(F.array(size, size - 1)).alias("base")).select(
        "word", "n", F.col("base").cast("string").alias("key"), "base", F.lit(False).alias("inner"), F.col("word").alias("rest"))


def _halves(parts: DataFrame) -> DataFrame:
    """Each part twice: its first half shared, then its second half shared.

    ``inner`` says that the longer word's extra letter must lie before the end of
    ``rest``: at its end, it also lies in a later half, where the pair is accepted.
    """
    half = F.expr("base div 2").cast("int")
    tail, size = F.col("base") - half, F.length("rest")

    def side(name: str, shared, rest, base, inner):
        key = F.concat("key", F.lit(name), base.cast("string"), F.lit("/"), shared)
        return F.struct(key.alias("key"), base.alias("base"), inner.alias("inner"), rest.alias("rest"))

    first = side("<", F.substring("rest", F.lit(1), half), F.substring("rest", half + 1, size), tail, F.col("inner"))
    last = side(">", F.substring("rest", size - tail + 1, tail), F.substring("rest", F.lit(1), size - tail),
                half, F.lit(True))
    return parts.select("word", "n", F.explode(F.array(first, last)).alias("s")).select("word", "n", "s.*")


class Acceptor:
    """The minimal acceptor of sorted distinct words; ``arcs[state]`` maps letters to
    states, equal continuations are one state."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]
        before = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1][before[len(path) - 1]] = state(final, arcs)

        def state(final: bool, arcs: dict) -> int:
            name = (final, tuple(arcs.items()))
            if name not in known:
                known[name] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return known[name]

        for word in words:
            same = 0
            while same < min(len(word), len(before)) and word[same] == before[same]:
                same += 1
            close(same)
            path.extend([False, {}] for _ in word[same:])
            path[-1][0] = True
            before = word
        close(0)
        self.start = state(*path[0])


def replaced(words: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs of words of the acceptor that differ in one letter, each once: the
    acceptor composed with a replacement and the acceptor.

    Until the edit both sides stand in the same state.
    """
    arcs, final = words.arcs, words.final
    stack = [(words.start, words.start, False, "", "")]
    while stack:
        p, q, edited, u, v = stack.pop()
        if edited:
            if final[p] and final[q]:
                yield u, v
            other = arcs[q]
            stack.extend((s, other[a], True, u + a, v + a) for a, s in arcs[p].items() if a in other)
            continue
        out = list(arcs[p].items())
        for k, (a, s) in enumerate(out):
            stack.append((s, s, False, u + a, v + a))
            stack.extend((s, t, True, u + a, v + b) for b, t in out[k + 1:])


def inserted(short: Acceptor, long: Acceptor, inner: bool) -> Iterator[tuple[str, str]]:
    """Pairs of a word and the word that has one letter more, each once: ``short``
    composed with an insertion and ``long``.

    The letter after the inserted one differs from it (the insertion lies as far
    right as it can).  ``inner`` pairs have a letter after it.
    """
    stack = [(short.start, long.start, "", "", "")]
    while stack:
        p, q, letter, u, v = stack.pop()
        if letter and short.final[p] and long.final[q] and not (inner and len(letter) == 1):
            yield u, v
        other = long.arcs[q]
        for a, s in short.arcs[p].items():
            if a in other and a != letter:
                stack.append((s, other[a], letter and letter + letter, u + a, v + a))
        if not letter:
            stack.extend((p, t, b, u, v + b) for b, t in other.items())


def _near(base: int, inner: bool, rests: list[str], words: list[str], counts: list[int]) -> Iterator[tuple]:
    known = dict(zip(rests, zip(words, counts, strict=True), strict=True))
    short = sorted(r for r in known if len(r) == base)
    long = sorted(r for r in known if len(r) == base + 1)
    if not short:
        return
    left = Acceptor(short)
    for u, v in replaced(left):
        yield known[u] + known[v]
        yield known[v] + known[u]
    if long:
        for u, v in inserted(left, Acceptor(long), inner):
            yield known[u] + known[v]
            yield known[v] + known[u]


def _compose(batches: Batches) -> Batches:
    """Accepted pairs, group by group; rows of a group are adjacent."""
    names = ["key", "base", "inner", "rest", "word", "n"]
    held = None

    def pairs(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        done: list[tuple] = []
        starts = np.append(0, ends[:-1])
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            group = table.slice(a, b - a)
            done += _near(group["base"][0].as_py(), group["inner"][0].as_py(),
                          *(group[c].to_pylist() for c in ("rest", "word", "n")))
        word, n, near, near_n = zip(*done, strict=True) if done else ([],) * 4
        return pa.record_batch({"word": pa.array(word, pa.string()), "n": pa.array(n, pa.int64()),
                                "near": pa.array(near, pa.string()), "near_n": pa.array(near_n, pa.int64())})

    for batch in batches:
        table = pa.Table.from_batches([batch]).select(names)
        table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
        if not len(table):
            continue
        key = table["key"]
        ends = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy()) + 1
        if len(ends):
            yield pairs(table.slice(0, int(ends[-1])), ends)
        held = table.slice(int(ends[-1]) if len(ends) else 0)
    if held is not None and len(held):
        yield pairs(held, np.array([len(held)]))


def links(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word, n, near, near_n`` of all ordered pairs of ``words`` (distinct ``word``,
    its count ``n``) that differ by one inserted, deleted or replaced letter."""
    parts, found = settle(_halves(_whole(words)), "parts"), None
    while True:
        crowded = parts.where("base > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group)
        crowded = settle(crowded.select("key"), "crowded")
        more = not crowded.isEmpty()
        small = parts.join(crowded, "key", "left_anti") if more else parts
        small = bounded_batches(small).repartition("key").sortWithinPartitions("key")
        pairs = small.mapInArrow(_compose, LINKS)
        found = pairs if found is None else found.union(pairs)
        if not more:
            return found
        parts = settle(_halves(parts.join(crowded, "key", "left_semi")), "parts")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms of each word lead, by doubling steps."""
    steps = settle(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        then = steps.select(F.col("word").alias("root"), F.col("root").alias("then"))
        steps = settle(steps.select("word", "root").join(then, "root", "left").select(
            "word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "steps")
        if steps.where("moved").isEmpty():
            return steps.select("word", "root")


def variant_forms(words: DataFrame, factor: int = FACTOR, group: int = GROUP) -> DataFrame:
    """Per word: ``form, root, n, n_near, form_n``.

    ``form`` is the near word of largest ``n`` (ties: smallest in code-point order) if
    it occurs ``factor`` times as often; ``root`` follows forms to the last.  An empty
    vocabulary gives no rows.
    """
    words = settle(words.select("word", "n"), "words")
    best = F.min(F.struct(-F.col("near_n"), F.col("near").alias("near"))).alias("best")
    near = links(words, group).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    often = -F.col("best.col1") >= factor * F.col("n")
    near = settle(near.select("word", "n_near", F.when(often, F.col("best.near")).alias("form"),
                              F.when(often, -F.col("best.col1")).alias("form_n")), "near")
    roots = _roots(near.where("form is not null"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (see ``vocabulary``) with their forms."""
    return variant_forms(vocabulary(docs))
