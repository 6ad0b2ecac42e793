"""Link cleaning and collection: from raw hrefs to one URL per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.functions import fixed, urls
from hostweave.functions.stages import once


def clean_urls(
    links: DataFrame, href: str = "href", match: str = "substring", unwrap: bool = True
) -> DataFrame:
    """Add ``url``, ``host`` and ``reject_reason`` (null for a usable link).

    A projection: no shuffle, so it can run on the scan of the raw link table.
    """
    raw = F.coalesce(F.col(href), F.lit(""))
    target = urls.tidy(urls.unwrap_redirect(raw) if unwrap else raw)
    names = links.columns
    staged = once(links, {"_target": target})
    target = F.col("_target")
    staged = once(staged, {
        "url": urls.canonical_url(target), "host": urls.host_of(target),
        "_path": F.lower(urls.path_of(target)),
    })
    reason = reject_reason(target, F.col("host"), F.col("_path"), match)
    staged = once(staged, {"reject_reason": reason}, drop=("_target", "_path"))
    return staged.select(*[c for c in names if c not in ("url", "host")],
                         "url", "host", "reject_reason")


def reject_reason(target: Column, host: Column, path: Column, match: str) -> Column:
    """The first rule a link breaks."""
    extensions = "|".join(fixed.FILE_EXTENSIONS)
    local = "|".join(p.replace(".", r"\.") for p in fixed.LOCAL_PREFIXES)
    return (
        F.when(~target.rlike("^https?://"), "not_http")
        .when(host == "", "no_host")
        .when(path.rlike(rf"\.({extensions})$"), "file_extension")
        .when(F.concat(path, F.lit("?")).rlike(urls.any_of(fixed.PATH_FRAGMENTS)),
              "path_fragment")
        .when(urls.noise_host(host, match), "noise_host")
        .when(urls.excluded_tld(host), "excluded_tld")
        .when(host.rlike(f"^({local})"), "local_address")
    )


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order, as an aggregate.

    ``min_by`` of a struct combines on the map side: each task ships at most one
    row per key, so a key that holds a third of the table costs its reducer
    one row per map task.  Map columns are carried along but do not order rows.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    plain = [c for c, kind in df.dtypes if c in rest and "map<" not in kind]
    row, place = F.struct(*order, *rest), F.struct(*order, *plain)
    return (
        df.groupBy(*keys).agg((F.min(row) if plain == rest else F.min_by(row, place)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in order + rest])
    )


def first_per_host(
    cleaned: DataFrame, keys: tuple[str, ...] = ("job_id",),
    order: tuple[str, ...] = ("query_idx", "page_no", "rank"),
) -> DataFrame:
    """One URL per (keys, host): the first usable one in collection order.

    Rejected links are dropped first, so they never occupy a host's place.
    """
    kept = cleaned.where(F.col("reject_reason").isNull() & (F.col("host") != ""))
    columns = [*keys, "host", *order, "url"]
    return first_by(kept.select(*columns), [*keys, "host"], [*order, "url"])


def reject_census(cleaned: DataFrame) -> DataFrame:
    """Rows per reject reason; usable links count as ``kept``."""
    return cleaned.groupBy(
        F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason")
    ).agg(F.count("*").alias("n_links"))


def top_n_links(cleaned: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` hosts of each (job, query, engine) search."""
    search = ("job_id", "query_idx", "engine")
    firsts = first_per_host(cleaned, keys=search, order=("page_no", "rank"))
    w = Window.partitionBy(*search).orderBy("page_no", "rank", "url")
    return firsts.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def engine_fallback(cleaned: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """Per (job, query) the links of the first engine that returned any."""
    engines = engines or fixed.ENGINE_ORDER
    place = F.array_position(F.lit(engines), F.col("engine"))
    ranked = (
        cleaned.where(F.col("reject_reason").isNull())
        .withColumn("engine_rank", place).where(F.col("engine_rank") > 0)
    )
    winner = ranked.groupBy("job_id", "query_idx").agg(
        F.min("engine_rank").alias("engine_rank")
    )
    return ranked.join(winner, ["job_id", "query_idx", "engine_rank"], "left_semi").drop(
        "engine_rank"
    )


def pages_before_stop(serp: DataFrame) -> DataFrame:
    """Result pages before the first blocked, empty or no-result page of a query.

    The first stop page is an aggregate, not a running window, so a query with
    very many pages is not replayed in one task.
    """
    stop = F.col("captcha") | F.col("no_results") | (F.col("n_links") == 0)
    first_stop = serp.where(stop).groupBy("query_id").agg(F.min("page_no").alias("_stop"))
    return (
        serp.join(first_stop, "query_id", "left")
        .where(F.col("_stop").isNull() | (F.col("page_no") < F.col("_stop"))).drop("_stop")
    )


def flag_pages(pages: DataFrame, url: str = "href", text: str = "body") -> DataFrame:
    """Mark blocked and no-result pages."""
    seen = F.concat_ws(" ", F.col(url), F.col(text))
    return pages.withColumns({
        "captcha": seen.rlike(f"(?i){fixed.INTERSTITIAL_PATTERN}"),
        "no_results": F.coalesce(F.col(text), F.lit("")).rlike(
            f"(?i){fixed.NO_RESULTS_PATTERN}"
        ),
    })


def flag_rates(flagged: DataFrame) -> DataFrame:
    """Per query: pages seen, blocked and without results."""
    return flagged.groupBy("query_id").agg(
        F.count("*").alias("n_pages"),
        F.count_if("captcha").alias("n_captcha"),
        F.count_if("no_results").alias("n_no_results"),
    )
