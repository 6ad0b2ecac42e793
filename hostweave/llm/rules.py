"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document.  Nobody labels
anything: expectation-maximisation estimates, from how the votes agree over all
documents, how often each rule is right on good and on bad documents when it does
not abstain.  The posterior probability of being good then replaces a list of tests that all must
pass: one doubtful sign is outvoted, several are not.

Votes are counted per pattern first (at most 3 to the number of rules), so a round
reads a few hundred counts whatever the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import once
from .common import SPACE, settle

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ROUNDS = 20
SMOOTHING = 0.5

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_ended", "n_lettered", "n_plain", "n_digits"]


def with_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``quality`` of counts over the whole text.

    A null text counts as empty.  Columns of ``docs`` keep their names; a column
    already called ``quality`` is replaced.
    """
    names = [c for c in docs.columns if c.lower() != "quality"]
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"),
                       F.coalesce(docs["text"], F.lit("")).alias("t"))
    split = once(kept, {
        "w": F.filter(F.split("t", SPACE), lambda x: x != ""),
        "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    runs = once(split, {"codes": F.when(
        F.size("w") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice("w", i, WINDOW))))})
    pairs = once(runs, {"pairs": F.when(
        F.size(F.array_distinct("codes")) < F.size("codes"),
        F.sort_array(F.transform("codes", lambda c, i: F.struct(c.alias("c"), i.alias("i")))))}, ("codes",))
    again = once(pairs, {"at": F.sort_array(F.transform(
        F.filter("pairs", lambda x, i: (x["c"] == F.get("pairs", i - 1)["c"])
                 | (x["c"] == F.get("pairs", i + 1)["c"])),
        lambda x: x["i"]))}, ("pairs",))
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x)
    bare = F.translate("t", "\t\n\x0b\x0c\r ", "")
    counts = {
        "n_words": F.size("w"),
        "word_chars": F.length(bare),
        "n_symbols": F.length("t") - F.length(F.translate("t", SYMBOLS, "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("lines"),
        "n_ended": F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;\"'…。)]\s*$"))),
        "n_lettered": F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))),
        "n_plain": F.size(F.filter("w", lambda x: x.rlike(r"^[\"'(]*\p{L}[\p{L}\p{M}'’-]*[.,;:!?)\"']*$"))),
        "n_digits": F.length("t") - F.length(F.translate("t", "0123456789", "")),
    }
    quality = F.struct(*(c.cast("long").alias(n) for n, c in counts.items())).alias("quality")
    return again.select(*(F.col("row")[c].alias(c) for c in names), quality)


def base_failed(m: str = "quality") -> Column:
    n = F.col(f"{m}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def votes(m: str = "quality") -> dict[str, Column]:
    """The rules: each a vote of 1, 0 or -1 from the counts of one document."""
    def col(name: str) -> Column:
        return F.col(f"{m}.{name}")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(col("n_words") == 0, -1).when(bad, -1).when(good, 1).otherwise(0)

    n, lines, chars = col("n_words"), col("n_lines"), col("word_chars")
    return {
        "word_length": vote(chars.between(3 * n, 9 * n), ~chars.between(2 * n, 14 * n)),
        "symbols": vote(50 * col("n_symbols") <= n, 10 * col("n_symbols") > n),
        "same_lines": vote(col("n_dup_lines") == 0, 10 * col("n_dup_lines") > 3 * lines),
        "same_words": vote(20 * col("n_repeat_words") <= n, 5 * col("n_repeat_words") > n),
        "length": vote(n >= 40, n < MIN_WORDS),
        "sentences": vote(2 * col("n_ended") >= lines, 10 * col("n_ended") < lines),
        "letters": vote(10 * col("n_lettered") >= 9 * n, 10 * col("n_lettered") < 7 * n),
        "plain_words": vote(10 * col("n_plain") >= 9 * n, 10 * col("n_plain") < 7 * n),
        "digits": vote(20 * col("n_digits") <= chars, 5 * col("n_digits") > chars),
    }


def _log_odds(model: dict, rules: list[str]) -> Column:
    """Log odds of good against bad, from columns named like the rules."""
    total = F.lit(model["prior"])
    for rule in rules:
        weight = model["weights"][rule]
        total += F.when(F.col(rule) == 1, weight[1]).when(F.col(rule) == -1, weight[-1]).otherwise(0.0)
    return total


def fit(metrics: DataFrame, rounds: int = ROUNDS) -> dict:
    """Estimate the model from all rows of ``metrics`` (with ``quality``).

    Starts from the sign of the vote sum, with bad votes counted threefold, as good
    documents earn few of them.  Returns the prior log odds and, per rule, the log
    likelihood ratio of each vote.
    """
    rules = votes()
    names = list(rules)
    table = settle(metrics.select(*(c.alias(n) for n, c in rules.items()))
                   .groupBy(*names).agg(F.count("*").alias("n")), "votes")
    total = sum((F.when(F.col(n) == -1, -3).otherwise(F.col(n)) for n in names), F.lit(0))
    good = F.when(total >= len(names) // 2, 0.95).when(total > 0, 0.6).otherwise(0.05)
    model: dict = {}
    for _ in range(rounds):
        held = table.select("*", (F.col("n") * good).alias("g"), (F.col("n") * (1 - good)).alias("b"))
        sums = [F.sum(F.when(F.col(r) == v, F.col(y))).alias(f"{r}:{v}:{y}")
                for r in names for v in (-1, 1) for y in ("g", "b")]
        row = held.agg(F.sum("g").alias("g"), F.sum("b").alias("b"), *sums).first().asDict()

        def share(r: str, v: int, y: str, row: dict = row) -> float:
            cast = (row[f"{r}:-1:{y}"] or 0.0) + (row[f"{r}:1:{y}"] or 0.0)
            return ((row[f"{r}:{v}:{y}"] or 0.0) + SMOOTHING) / (cast + 2 * SMOOTHING)

        new = {
            "prior": math.log(((row["g"] or 0.0) + 1) / ((row["b"] or 0.0) + 1)),
            "weights": {r: {v: math.log(share(r, v, "g") / share(r, v, "b")) for v in (-1, 1)}
                        for r in names},
        }
        moved = 1.0 if not model else max(
            abs(new["prior"] - model["prior"]),
            *(abs(new["weights"][r][v] - model["weights"][r][v]) for r in names for v in (-1, 1)))
        model = new
        if moved < 1e-4:
            break
        good = 1 / (1 + F.exp(-_log_odds(model, names)))
    return model


def judge(metrics: DataFrame, model: dict) -> DataFrame:
    """``metrics`` with ``base_failed``, ``posterior`` (of being good) and ``kept``."""
    rules = votes()
    voted = metrics.select("*", *(c.alias(f"__{n}") for n, c in rules.items()))
    renamed = {"prior": model["prior"], "weights": {f"__{r}": w for r, w in model["weights"].items()}}
    odds = _log_odds(renamed, [f"__{r}" for r in rules])
    return voted.withColumns({"base_failed": base_failed(), "posterior": 1 / (1 + F.exp(-odds))}) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)) \
        .drop(*(f"__{r}" for r in rules))


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts, verdict and posterior.

    Blank and null texts fail the base rules.  Equal texts get equal verdicts.
    """
    metrics = settle(with_metrics(docs.select("doc_id", "text")).select("doc_id", "quality"), "metrics")
    out = judge(metrics, fit(metrics))
    return out.select("doc_id", *(f"quality.{c}" for c in METRICS), "base_failed", "kept", "posterior",
                      *(f"quality.{c}" for c in EXTRA))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), docs["text"])
    counted = settle(with_metrics(rows).select("doc", "quality"), "metrics")  # counted once for fit and verdict
    return judge(counted, fit(counted.select("quality"))).where("kept").select("doc.*")
