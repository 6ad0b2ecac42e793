"""Niche labels: classifier inputs, asking a service, response parsing, a default scorer.

A *service* is what answers the questions of `label_requests`: a function without
arguments that is called once per task and returns the task's own answering
function (a client, a loaded model).  That function gets a batch with ``request`` and
``n`` (1 for the first attempt) and returns ``content`` for each row, and if it has
them ``reasoning`` and ``error``.  If it has a ``close`` method, the task calls it at
its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostweave.functions import fixed
from hostweave.functions.stages import once
from hostweave.operators.fetchlog import final_verdict, resolve_verdicts, usable_label
from hostweave.operators.text import url_hint
from hostweave.session import settle

Scorer = Callable[[pd.DataFrame], pd.DataFrame]
Service = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
VERDICT_SCHEMA = "vertical string, confidence double, reason string"


def label_requests(
    profiles: DataFrame, niche: str = "custom_niche",
    verticals: Sequence[str] = tuple(fixed.VERTICALS),
) -> DataFrame:
    """The question a labelling service is asked about each page."""
    wanted = F.trim(F.coalesce(F.col(niche), F.lit("")))
    task = F.when(
        wanted != "",
        F.concat(F.lit('Does this site offer the niche "'), wanted,
                 F.lit('"? Answer with that niche or Other.')),
    ).otherwise(F.lit(f"Choose the best category: {', '.join(verticals)} or Other."))
    body = F.when(F.col("text") != "", F.col("text")).otherwise(F.lit("[no page text]"))
    request = F.concat(
        task, F.lit("\nURL: "), F.col("url"), F.lit("\nTITLE: "), F.col("title"),
        F.lit("\nURL HINT: "), url_hint(F.col("url")),
        F.lit("\nTEXT ("), F.length("text").cast("string"), F.lit(" chars): "), body,
    )
    keep = [c for c in profiles.columns if c not in ("title", "text", niche)]
    return profiles.select(*keep, request.alias("request"))


def parse_responses(
    responses: DataFrame, content: str = "content", reasoning: str | None = None
) -> DataFrame:
    """Add ``vertical``, ``confidence`` and ``reason`` read from a raw response.

    The last object that names a vertical wins, else the last object.  A
    response without a readable object is Other; an empty one is Unknown.
    """
    raw = F.trim(F.coalesce(F.col(content), F.lit("")))
    trace = F.coalesce(F.col(reasoning), F.lit("")) if reasoning else F.lit("")
    staged = once(responses, {
        "_raw": raw,
        "_clean": F.btrim(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""),
                          F.lit(" \t\n\r")),
    })
    named = F.regexp_extract_all("_clean", F.lit(r'(?s)\{[^{}]*"vertical"[^{}]*\}'), F.lit(0))
    plain = F.regexp_extract_all("_clean", F.lit(r"(?s)\{.*?\}"), F.lit(0))
    objects = F.when(F.size(named) > 0, named).otherwise(plain)
    staged = once(staged, {"_json": F.try_element_at(objects, F.lit(-1))})
    schema = "vertical string, confidence string, reason string, broken string"
    staged = once(staged, {"_data": F.from_json(
        "_json", schema,
        {"columnNameOfCorruptRecord": "broken", "allowSingleQuotes": "false"},
    )})
    data = F.col("_data")
    number = F.coalesce(data["confidence"], F.lit("0")).try_cast("double")
    readable = F.col("_json").isNotNull() & data["broken"].isNull() & number.isNotNull()
    empty = (F.col("_raw") == "") & (trace == "")
    said = F.coalesce(data["reason"], F.lit(""))
    return staged.withColumns({
        "vertical": F.when(empty, "Unknown")
        .when(readable, F.coalesce(data["vertical"], F.lit("Other"))).otherwise("Other"),
        "confidence": F.when(readable & ~empty, number).otherwise(F.lit(0.0)),
        "reason": F.when(empty, fixed.EMPTY_RESPONSE)
        .when(readable, F.when(said != "", said).otherwise(trace))
        .otherwise(F.concat(F.lit(fixed.UNREADABLE_RESPONSE), F.col("_clean"))),
    }).drop("_raw", "_clean", "_json", "_data")


def lexicon_counts(text: Column, lexicon: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Whole-word hits per label, counted in place: no token rows, no shuffle."""
    return {
        label: F.size(F.regexp_extract_all(
            text, F.lit(rf"\b(?:{'|'.join(words)})\b"), F.lit(0)
        )) for label, words in lexicon.items()
    }


def label_pages(
    profiles: DataFrame, scorer: Scorer | None = None,
    lexicon: Mapping[str, Sequence[str]] = fixed.LEXICON,
) -> DataFrame:
    """Add a verdict to pages with ``url``, ``title`` and ``text``.

    Without a scorer the label with most lexicon words wins, earlier labels
    first on a tie.  A scorer is a user's function from a batch to its verdict
    columns; it runs per Arrow batch, after every filter placed before it.
    """
    if scorer is not None:
        return _score_batches(profiles, scorer)
    seen = F.lower(F.concat_ws(" ", "title", url_hint(F.col("url")), "text"))
    staged = once(profiles, {"_seen": seen})
    counts = lexicon_counts(F.col("_seen"), lexicon)
    staged = once(staged, {f"_n{i}": n for i, n in enumerate(counts.values())}, drop=("_seen",))
    hits = [F.col(f"_n{i}") for i in range(len(counts))]
    total = sum(hits[1:], hits[0])
    best = F.greatest(*hits)
    label = F.lit("Other")
    for name, n in reversed(list(zip(counts, hits))):
        label = F.when(n == best, name).otherwise(label)
    return staged.withColumns({
        "vertical": F.when(total > 0, label).otherwise("Other"),
        "confidence": F.when(total > 0, best / total).otherwise(F.lit(0.0)),
        "reason": F.concat(F.lit("lexicon hits: "), best.cast("string"), F.lit(" of "),
                           total.cast("string")),
    }).drop(*[f"_n{i}" for i in range(len(counts))])


def _score_batches(profiles: DataFrame, scorer: Scorer) -> DataFrame:
    schema = T.StructType(profiles.schema.fields + T._parse_datatype_string(VERDICT_SCHEMA).fields)
    names = ["vertical", "confidence", "reason"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{c: scorer(pdf)[c].to_numpy() for c in names})

    return profiles.mapInPandas(run, schema)


def ask(
    questions: DataFrame, service: Service, keys: tuple[str, ...] = ("url", "niche"),
    attempts: int = 3, tokens: list[str] | None = None,
) -> DataFrame:
    """Verdicts of a service on ``questions`` (``keys`` and ``request``).

    A round asks every open question once and is written before the next; only
    questions whose answer failed for a transient reason are asked again, so the
    table shrinks and nothing answered is asked twice if an executor is lost
    later.  After ``attempts`` rounds the last answer counts.  A batch on which the
    service raises an error gets that error as its reason.
    """
    key_fields = [f for f in questions.schema.fields if f.name in keys]
    answer_schema = T.StructType(key_fields + T._parse_datatype_string(
        "request string, n int, content string, reasoning string, error string").fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = service()
        try:
            for pdf in batches:
                try:
                    said = answer(pdf[["request", "n"]]).reset_index(drop=True)
                except Exception as e:  # whatever a user's client raises is an answer
                    said = pd.DataFrame({"error": [f"API error: {e}"] * len(pdf)})
                out = pdf.reset_index(drop=True)
                for c in ("content", "reasoning", "error"):
                    out[c] = said[c] if c in said else None
                yield out
        finally:
            getattr(answer, "close", lambda: None)()

    rounds, todo = [], questions.select(*keys, "request")
    failed = F.coalesce("error", F.lit("")) != ""
    for n in range(1, attempts + 1):
        raw = todo.withColumn("n", F.lit(n)).mapInPandas(run, answer_schema)
        parsed = parse_responses(raw, reasoning="reasoning").withColumns({
            "vertical": F.when(failed, "Unknown").otherwise(F.col("vertical")),
            "confidence": F.when(failed, F.lit(0.0)).otherwise(F.col("confidence")),
            "reason": F.when(failed, F.col("error")).otherwise(F.col("reason")),
        })
        final = final_verdict(F.col("vertical"), F.col("reason"), tokens)
        answered = settle(parsed.select(
            *keys, "n", "vertical", "confidence", "reason", F.when(~final, F.col("request")).alias("request"),
        ), f"answers-{n}")
        rounds.append(answered.drop("request"))
        todo = answered.where(F.col("request").isNotNull()).select(*keys, "request")
        if n == attempts or todo.isEmpty():
            break
    tried = rounds[0]
    for later in rounds[1:]:
        tried = tried.unionByName(later)
    return resolve_verdicts(tried, keys, tokens=tokens).select(*keys, "vertical", "confidence", "reason")


def sweep_unknown(
    ver: DataFrame, verdicts: DataFrame, keys: tuple[str, ...] = ("job_id", "domain"),
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Second verdicts replace the label of rows that have none.

    Of several verdicts on one row the last in ``order`` counts.
    """
    fields = ["vertical", "confidence", "reason"]
    last = F.max_by(F.struct(*fields), F.struct(*order, F.xxhash64(*fields)))
    second = verdicts.groupBy(*keys).agg(last.alias("_second"))
    replace = ~usable_label(F.col("vertical")) & F.col("_second").isNotNull()
    joined = ver.join(second, list(keys), "left").withColumn("_replace", replace)
    return joined.withColumns({
        f: F.when(F.col("_replace"), F.col(f"_second.{f}")).otherwise(F.col(f)) for f in fields
    }).select(*ver.columns)
