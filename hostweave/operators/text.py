"""Page text, URL words and footers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.functions import blocks, fixed, markup, urls
from hostweave.functions.stages import once


def page_text(
    pages: DataFrame, html: str = "html", cap: int | None = None, floor: int = 100
) -> DataFrame:
    """Add ``title``, the whole visible ``text`` and ``short``: under ``floor`` characters.

    ``cap`` cuts the text where a caller needs it bounded.
    """
    staged = once(pages, {
        "title": markup.title_of(F.col(html)), "text": markup.visible_text(F.col(html)),
    })
    flagged = staged.withColumn("short", F.length("text") < floor)
    return flagged if cap is None else flagged.withColumn("text", F.substring("text", 1, cap))


def host_words(url: Column) -> Column:
    known = "|".join(fixed.HINT_TLDS)
    stem = F.regexp_replace(urls.host_of(url), rf"\.({known})(\.[a-z]{{2}})?$", "")
    return F.regexp_extract_all(stem, F.lit("[a-z]+"), F.lit(0))


def path_words(url: Column, limit: int | None = None) -> Column:
    words = F.regexp_extract_all(F.lower(urls.raw_path_of(url)), F.lit("[a-z]+"), F.lit(0))
    return words if limit is None else F.slice(words, 1, limit)


def url_hint(url: Column) -> Column:
    return F.concat(
        F.lit("domain words: "), F.array_join(host_words(url), " "),
        F.lit(" | path words: "), F.array_join(path_words(url), " "),
    )


def url_tokens(pages: DataFrame, url: str = "url") -> DataFrame:
    """One row per word of a URL's host and path."""
    def part(name: str, words: Column) -> DataFrame:
        return pages.select(
            url, F.lit(name).alias("part"), F.posexplode(words).alias("pos", "token")
        )

    return part("host", host_words(F.col(url))).unionByName(
        part("path", path_words(F.col(url)))
    )


def token_frequency(tokens: DataFrame, url: str = "url") -> DataFrame:
    """URLs and occurrences per (part, token), counted in two combining steps."""
    per_url = tokens.groupBy("part", "token", url).agg(F.count("*").alias("n"))
    return per_url.groupBy("part", "token").agg(
        F.count("*").alias("n_urls"), F.sum("n").alias("n_uses")
    )


def _marked_blocks() -> Callable[[Column], Column]:
    """A vectorised search for footer-like blocks; null stays null."""
    find, hints = blocks.marked_block, tuple(fixed.FOOTER_HINTS)

    @F.pandas_udf("string")
    def marked(html: pd.Series) -> pd.Series:
        return html.map(lambda page: None if page is None else find(page, hints))

    return marked


def with_footer(
    pages: DataFrame, html: str = "html", name: str = "footer", heuristic: bool = True
) -> DataFrame:
    """Add a page's footer: its ``<footer>``, else a block marked as one, else ``''``.

    A real ``<footer>`` is cut out natively.  Only pages without one that do carry a
    footer-like class, id or role send their markup to Python, because finding the
    matching close tag needs a tag counter.  Pages are scanned once.
    """
    staged = once(pages, {"_strict": markup.strict_footer(F.col(html))})
    if not heuristic:
        return staged.withColumnRenamed("_strict", name)
    words = "|".join(fixed.FOOTER_HINTS)
    marked = rf"(?is)<(?:div|section|aside)\b[^>]*(?:{words})"
    needs = (F.col("_strict") == "") & F.col(html).rlike(marked)
    found = _marked_blocks()(F.when(needs, F.col(html)))
    return staged.withColumn(
        name, F.coalesce(F.nullif("_strict", F.lit("")), found, F.lit(""))).drop("_strict")


def page_footers(pages: DataFrame, html: str = "html", heuristic: bool = True) -> DataFrame:
    """Replace a page's markup by its ``footer``."""
    keep = [c for c in pages.columns if c != html]
    return with_footer(pages, html, heuristic=heuristic).select(*keep, "footer")
