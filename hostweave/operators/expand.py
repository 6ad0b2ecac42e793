"""Search query expansion.

A campaign's queries are a handful of templates over its own keywords, so they
are built as arrays inside the campaign row: no join and no shuffle.
``array_distinct`` keeps the first occurrence, which is the order queries run in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.functions import fixed, urls
from hostweave.functions.stages import once

PLACES = ("area", "city", "state", "country")


def _list(text: Column, pattern: str) -> Column:
    items = F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda x: F.trim(x))
    return F.filter(items, lambda x: x != "")


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def campaign_terms(campaigns: DataFrame) -> DataFrame:
    """Add ``bases``, ``stacks``, ``hints``, ``places``, ``primary`` and ``broad``."""
    verticals = _literals(fixed.VERTICALS)
    words = _list(F.col("keywords"), "[,\n]")
    vertical = F.trim(F.coalesce(F.col("vertical"), F.lit("all")))
    hint_map = F.create_map(*[
        x for stack, hints in fixed.STACK_HINTS.items() for x in (F.lit(stack), _literals(hints))
    ])
    places = F.filter(
        F.array(*[F.trim(F.coalesce(F.col(p), F.lit(""))) for p in PLACES]), lambda x: x != ""
    )
    staged = once(campaigns, {
        "bases": F.when(F.size(words) > 0, words)
        .when(F.array_contains(verticals, vertical), F.array(vertical)).otherwise(verticals),
        "stacks": _list(F.col("tech_stacks"), ","),
        "places": places,
    })
    hints = F.flatten(F.transform(
        "stacks",
        lambda s: F.coalesce(F.try_element_at(hint_map, s), F.array().cast("array<string>")),
    ))
    return once(staged, {
        "hints": F.when(F.size(hints) > 0, hints).otherwise(F.array(F.lit(""))),
        "primary": F.when(F.size("places") > 0, F.element_at("places", 1)).otherwise(""),
        "broad": F.array_join("places", " "),
    })


def _numbered(df: DataFrame, queries: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    squeezed = F.transform(queries, lambda q: F.trim(F.regexp_replace(q, r"\s+", " ")))
    final = F.array_distinct(F.filter(squeezed, lambda q: q != ""))
    return df.select("campaign_id", *keep, F.posexplode(final).alias("query_idx", "query"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def expand_stack_queries(campaigns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keyword × platform hint × place queries for campaigns that filter by stack.

    ``keep`` names columns of the campaign that its queries take along.
    """
    df = campaign_terms(campaigns.where(~F.col("skip_tech_filter")))
    place, broad = F.col("primary"), F.col("broad")
    anywhere = place == ""

    def core(word: Column) -> Column:
        return F.flatten(F.transform("hints", lambda h: F.when(
            anywhere, F.array(_text(word, " ", h))
        ).otherwise(F.array(
            _text(word, ' "', place, '" ', h), _text(word, " ", broad, " ", h)
        ))))

    def local(hint: Column) -> Column:
        plain = [_text(f'"{p} ', place, '" ', hint) for p in fixed.PLACE_PHRASES]
        worded = F.transform(
            "bases", lambda w: _text('"', w, f'" "{fixed.PLACE_PHRASES[0]} ', place, '" ', hint)
        )
        return F.concat(F.array(*plain), worded)

    none = F.array().cast("array<string>")
    stack, seed = fixed.SEED_STACK
    seeds = F.when(
        F.array_contains("stacks", stack) & ~anywhere,
        F.array(_text(f'{seed} "', place, '"'), _text(f'{seed} "', broad, '"')),
    ).otherwise(none)
    return _numbered(df, F.concat(
        F.flatten(F.transform("bases", core)),
        F.when(anywhere, none).otherwise(F.flatten(F.transform("hints", local))),
        seeds,
    ), keep)


def expand_or_queries(campaigns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One OR block over all keywords for campaigns that ignore the stack."""
    df = campaign_terms(campaigns.where("skip_tech_filter"))
    quoted = F.transform("bases", lambda w: _text('"', w, '"'))
    block = F.when(
        F.size("bases") > 1, _text("(", F.array_join(quoted, " OR "), ")")
    ).otherwise(F.array_join(quoted, " "))
    places = F.array_join(F.transform("places", lambda p: _text('"', p, '"')), " ")
    exclude = " ".join(f"-site:{h}" for h in fixed.OR_QUERY_EXCLUSIONS)
    anchored = [_text(block, " ", places, f" {n} {exclude}") for n in fixed.OR_QUERY_NUDGES]
    phrased = [_text(block, f' "{p} ', F.col("primary"), f'" {exclude}')
               for p in fixed.PLACE_PHRASES[:2]]
    queries = F.concat(
        F.array(_text(block, " ", places, f" {exclude}")),
        F.when(F.size("places") > 0, F.array(*anchored, *phrased))
        .otherwise(F.array().cast("array<string>")),
    )
    return _numbered(df, queries, keep)


def expand_queries(campaigns: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Both kinds of campaigns."""
    return expand_stack_queries(campaigns, keep).unionByName(expand_or_queries(campaigns, keep))


def search_pages(campaigns: DataFrame, pages: str = "pages_per_query", limit: int | None = None) -> DataFrame:
    """All result pages that campaigns ask for: `expand_queries`, then `fan_out_pages`.

    A campaign becomes hundreds of rows, so campaigns are dealt to tasks first, however few
    files hold them, and their number of pages travels with them; nothing is moved
    or joined afterwards.  Rows that share an id have their queries on each
    other's pages, rows without one ask for nothing.
    """
    asked = campaigns.select("campaign_id", F.col(pages).alias("_pages"))
    dealt = campaigns.drop(pages).repartition("campaign_id").join(asked, "campaign_id")
    return fan_out_pages(expand_queries(dealt, ("_pages",)), "_pages", limit)


def fan_out_pages(
    queries: DataFrame, pages: str = "pages_per_query", limit: int | None = None
) -> DataFrame:
    """One row per query and result page asked for, with the address of that page.

    ``limit`` bounds the pages of a query, as some engines do.
    """
    asked = F.coalesce(F.col(pages), F.lit(1))
    asked = asked if limit is None else F.least(F.lit(limit), asked)
    last = F.greatest(F.lit(1), asked) - 1
    keep = [c for c in queries.columns if c != pages]
    search = F.concat(F.lit("https://www.google.com/search?q="), urls.quote_plus(F.col("query")), F.lit("&num=10&start="))
    staged = once(queries.select(*keep, pages), {"_search": search})
    rows = staged.select(*keep, "_search", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("page_no"))
    start = (F.col("page_no") * 10).cast("string")
    return rows.select(*keep, "page_no", F.concat("_search", start, F.lit("&hl=en")).alias("search_url"))
