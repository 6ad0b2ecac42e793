"""Reading captured tables, result pages, address lists and stored history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.functions import markup, urls
from hostweave.functions.stages import once
from hostweave.operators.tech import header_text

PARAMS = (
    "keywords string, custom_niche string, vertical string, country string, state string, "
    "city string, area string, tech_stacks array<string>, pages_per_query int, "
    "classify_niche boolean, extract_contacts boolean, skip_tech_filter boolean"
)


def captured_pages(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Captured pages, whole unless the caller names a ``cap`` in characters.

    A ``headers`` map of the capture becomes ``headers_text``.
    """
    pages = spark.read.parquet(path)
    if "headers" in pages.columns:
        pages = pages.withColumn("headers_text", header_text(F.col("headers"))).drop("headers")
    return pages if cap is None else pages.withColumn("html", F.substring("html", 1, cap))


def serp_links(pages: DataFrame, rendered: bool = False) -> DataFrame:
    """Links of captured result pages in page order, by each engine's layout.

    ``rendered`` pages are already resolved by a browser: every http link counts.
    Input: key columns, ``engine``, ``html``.  Output adds ``rank`` and ``href``.
    """
    html, engine = F.col("html"), F.col("engine")
    keep = [c for c in pages.columns if c != "html"]

    def hrefs(tags: Column) -> Column:
        return F.transform(tags, markup.href_of)

    every = hrefs(markup.anchor_tags(html))
    if rendered:
        links = F.filter(every, lambda h: h.startswith("http"))
    else:
        google = F.filter(
            F.transform(every, lambda h: F.when(
                h.startswith("/url?"), urls.unwrap_redirect(h)
            ).when(~urls.host_of(h).contains("google."), h)),
            lambda h: h.startswith("http"),
        )
        items = F.regexp_extract_all(
            html, F.lit(r'(?is)<li\b[^>]*class="[^"]*\bb_algo\b[^"]*".*?(?:</li\s*>|\z)'), F.lit(0)
        )
        heads = F.flatten(F.transform(
            items, lambda i: F.regexp_extract_all(i, F.lit(r"(?is)<h2\b.*?(?:</h2\s*>|\z)"), F.lit(0))
        ))
        bing = F.filter(
            hrefs(F.flatten(F.transform(heads, markup.anchor_tags))),
            lambda h: h.startswith("http"),
        )
        marked = F.filter(
            markup.anchor_tags(html),
            lambda t: t.rlike(r'(?i)class="[^"]*\bresult__(?:a|url)\b[^"]*"'),
        )
        ddg = F.filter(
            F.transform(hrefs(marked), lambda h: urls.unwrap_redirect(F.when(
                h.startswith("//duckduckgo.com/l/"), F.concat(F.lit("https:"), h)
            ).otherwise(h))),
            lambda h: h.startswith("http"),
        )
        links = F.when(engine == "google", google).when(engine == "bing", bing).when(
            engine == "ddg", ddg
        )
    found = once(pages, {"_links": links}, drop=("html",))
    return found.select(*keep, F.posexplode("_links").alias("rank", "href"))


def bulk_urls(lists: DataFrame, raw: str = "raw") -> DataFrame:
    """Addresses of free-text lists, with the excluded ones marked ``skipped``."""
    keep = [c for c in lists.columns if c != raw]
    items = F.filter(F.split(F.col(raw), r"[\s,]+"), lambda x: x != "")
    rows = lists.select(*keep, F.posexplode(items).alias("pos", "entry"))
    address = urls.absolute(F.col("entry"))
    found = once(rows, {"url": urls.canonical_url(address), "host": urls.host_of(address)})
    return found.select(*keep, "pos", "url", "host", urls.excluded_tld(F.col("host")).alias("skipped"))


def _comma_list(column: Column) -> Column:
    return F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: x != "")


def decode_verifications(raw: DataFrame) -> DataFrame:
    """Comma lists become arrays, the socials text a map; unreadable text is empty."""
    social_type = "map<string,array<string>>"
    empty = F.create_map().cast(social_type)
    parsed = F.from_json(F.col("socials"), social_type)
    values = {
        **{c: _comma_list(F.col(c)) for c in ("platforms", "emails", "phones")},
        # Most rows have no handles; they skip the JSON parser.
        "socials": F.when(
            F.coalesce("socials", F.lit("")).isin("", "{}"), empty
        ).otherwise(F.coalesce(parsed, empty)),
        "accepted": F.coalesce(F.col("accepted").cast("boolean"), F.lit(False)),
    }
    return raw.withColumns({c: v for c, v in values.items() if c in raw.columns})


def decode_jobs(raw: DataFrame, params: str = "params_json") -> DataFrame:
    """Spread a job's stored parameters over columns; unreadable ones are null."""
    keep = [c for c in raw.columns if c != params]
    return raw.select(*keep, F.from_json(params, PARAMS).alias("_p")).select(*keep, "_p.*")


def job_detail(urls_: DataFrame, ver: DataFrame, ids: DataFrame) -> DataFrame:
    """Collected and verified rows of some jobs in insertion order."""
    wanted = ids.select(F.col("id").alias("job_id")).distinct()
    collected = urls_.join(wanted, "job_id", "left_semi").select(
        "job_id", F.lit("url").alias("kind"), F.col("host").alias("name"),
        F.col("seq").alias("seq"), "tiebreak",
    )
    verified = ver.join(wanted, "job_id", "left_semi").select(
        "job_id", F.lit("verification").alias("kind"), F.col("domain").alias("name"),
        F.col("version").alias("seq"), "tiebreak",
    )
    return collected.unionByName(verified).orderBy("job_id", "kind", "seq", "tiebreak", "name")
