"""Technology fingerprints of captured pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.functions import fixed, urls
from hostweave.functions.stages import constant, once
from hostweave.session import settle

HITS_TYPE = "array<struct<platform:string,evidence:array<string>>>"


def page_blob(html: str = "html", headers: str | None = "headers_text", cap: int | None = None) -> Column:
    """Lower-cased markup, followed by the response headers; ``cap`` cuts the markup."""
    body = F.coalesce(F.col(html), F.lit(""))
    body = F.lower(body if cap is None else F.substring(body, 1, cap))
    if headers is None:
        return body
    return F.concat(body, F.lit(" "), F.lower(F.coalesce(F.col(headers), F.lit(""))))


def header_text(headers: Column) -> Column:
    """``k:v`` pairs of a header map, joined by spaces."""
    pairs = F.transform(
        F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(":"), e["value"])
    )
    return F.array_join(pairs, " ")


def scan_markers(
    blob: Column, markers: Mapping[str, Sequence[str]], evidence: int | None = None
) -> Column:
    """Platforms with a marker in ``blob`` and their markers (the first ``evidence``, if given).

    The dictionary is a literal inside one projection.  There is no join, so the
    markup is read where it was scanned and never duplicated or shuffled.
    """
    platforms_ = constant(
        [{"platform": p, "markers": [w.lower() for w in words]} for p, words in markers.items()],
        "array<struct<platform:string,markers:array<string>>>",
    )

    def hit(entry: Column) -> Column:
        found = F.filter(entry["markers"], lambda m: F.contains(blob, m))
        shown = found if evidence is None else F.slice(found, 1, evidence)
        return F.struct(entry["platform"].alias("platform"), shown.alias("evidence"))

    return F.filter(F.transform(platforms_, hit), lambda h: F.size(h["evidence"]) > 0)


def add_implied(hits: Column, implies: Mapping[str, str] = fixed.IMPLIES) -> Column:
    """Append a parent platform, without evidence, where only its child was found."""
    for child, parent in implies.items():
        implied = F.array(F.struct(
            F.lit(parent).alias("platform"),
            F.lit(None).cast("array<string>").alias("evidence"),
        )).cast(HITS_TYPE)
        names = F.transform(hits, lambda h: h["platform"])
        missing = F.array_contains(names, child) & ~F.array_contains(names, parent)
        hits = F.when(missing, F.concat(hits, implied)).otherwise(hits)
    return hits


def platforms(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["platform"])


def fingerprint(
    pages: DataFrame, html: str = "html", headers: str | None = "headers_text",
    cap: int | None = None, markers: Mapping[str, Sequence[str]] = fixed.FINGERPRINTS,
    implied: bool = True,
) -> DataFrame:
    """Replace a page's markup by ``hits``, its platforms with evidence."""
    keep = [c for c in pages.columns if c not in (html, headers)]
    staged = once(pages.select(*keep, *[c for c in (html, headers) if c]),
                  {"_blob": page_blob(html, headers, cap)})
    return with_hits(staged.select(*keep, "_blob"), markers, implied)


def with_hits(
    df: DataFrame, markers: Mapping[str, Sequence[str]] = fixed.FINGERPRINTS,
    implied: bool = True, blob: str = "_blob",
) -> DataFrame:
    """Replace the scanned text by ``hits``."""
    staged = once(df, {"hits": scan_markers(F.col(blob), markers)}, drop=(blob,))
    return once(staged, {"hits": add_implied(F.col("hits"))}) if implied else staged


def explode_hits(fp: DataFrame) -> DataFrame:
    """One row per page and platform."""
    keep = [c for c in fp.columns if c != "hits"]
    return fp.select(*keep, F.explode("hits").alias("_h")).select(
        *keep, F.col("_h.platform").alias("platform"), F.col("_h.evidence").alias("evidence")
    )


def markers_from_table(table: DataFrame) -> dict[str, list[str]]:
    """Read a user's (platform, marker) table as a dictionary.

    Like the built-in one the dictionary becomes a literal of the plan, so it is a
    table written by people; `fingerprint_by_table` takes one of any length.
    """
    out: dict[str, list[str]] = {}
    for platform, marker in sorted(table.select("platform", "marker").distinct().toLocalIterator()):
        out.setdefault(platform, []).append(marker)
    return out


GRAM, RUN, PIECE, SLOTS = 4, 32, 4096, 1 << 20


def _places(pages: DataFrame, keys: list[str], blob: str, size: int, lengths: list[int]) -> DataFrame:
    """``keys, _piece, _at, gram``: the grams at all places of a text and the piece they stand in.

    Texts are cut into pieces that overlap by ``size`` characters, so a marker stands
    whole in the piece it starts in, and pieces into short runs, where counting up to a
    place is cheap.
    """
    pieces = F.regexp_extract_all(F.col(blob), F.lit(rf"(?s)(?=(.{{1,{PIECE + size}}})).{{1,{PIECE}}}"), F.lit(1))
    rows = pages.select(*keys, F.explode(pieces).alias("_piece"))
    runs = F.regexp_extract_all("_piece", F.lit(rf"(?s)(?=(.{{1,{RUN + GRAM - 1}}})).{{1,{RUN}}}"), F.lit(1))
    rows = once(rows, {"_runs": runs}).select(*keys, "_piece", F.posexplode("_runs").alias("_no", "_run"))
    starts = F.sequence(F.lit(0), F.least(F.length("_run"), F.lit(RUN)) - 1)
    rows = rows.select(*keys, "_piece", "_no", "_run", F.explode(starts).alias("_in"))
    grams = F.array(*[F.substring("_run", F.col("_in") + 1, F.lit(n)) for n in lengths])
    return rows.select(*keys, "_piece", (F.col("_no") * RUN + F.col("_in")).alias("_at"), F.explode(grams).alias("gram"))


def marker_index(places: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """``platform, marker, gram, offset``: each marker of ``known`` under the one of its grams that is
    rarest in the pages, and where in the marker that gram stands.

    A marker with a gram that no page has cannot be found and is left out.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length("marker") - GRAM, F.lit(0)))
    filed = known.select("platform", "marker", F.explode(starts).alias("offset"))
    gram = F.substring("marker", F.col("offset") + 1, F.lit(GRAM))
    seen = places.groupBy("gram").agg(F.count("*").alias("n"))
    # One number says how frequent a gram is and where it stands, so that the smallest is found by hashing.
    rank = F.coalesce("n", F.lit(0)) * F.lit(size) + F.col("offset")
    rarest = filed.withColumn("gram", gram).join(seen, "gram", "left").groupBy("platform", "marker").agg(F.min(rank).alias("_rank"))
    placed = rarest.where(F.col("_rank") >= size).withColumn("offset", (F.col("_rank") % size).cast("int"))
    return placed.select("platform", "marker", gram.alias("gram"), "offset")


def possible_markers(places: DataFrame, index: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``keys, marker``: strings of a text that stand where a marker of the index would.

    A place yields a string for each position and length that markers filed under its
    gram have, however many markers that are.  Places are first thinned out by a table of
    hashed grams, which never has more than ``SLOTS`` rows.
    """
    slot = F.pmod(F.xxhash64("gram"), F.lit(SLOTS)).cast("int").alias("_slot")
    used = F.broadcast(index.select(slot).distinct())
    start = F.greatest(F.col("_at") - size, F.lit(0))
    near = places.select("*", slot).join(used, "_slot", "left_semi").select(
        *keys, "gram", (F.col("_at") - start).alias("_at"),
        F.substring("_piece", start + 1, F.lit(2 * size)).alias("_around"))
    shapes = index.select("gram", "offset", F.length("marker").alias("_length")).distinct()
    from_ = F.col("_at") - F.col("offset")
    return near.join(shapes, "gram").where(from_ >= 0).select(
        *keys, F.substring("_around", from_ + 1, F.col("_length")).alias("marker")).distinct()


def fingerprint_by_table(
    pages: DataFrame, markers: DataFrame, key: str = "page_id", html: str = "html", headers: str | None = "headers_text",
) -> DataFrame:
    """``key, platform, evidence`` by a (platform, marker) table of any length.

    An inverted index: each marker is filed under the one of its grams that is rarest
    in the pages.  Where a page has that gram, the string of a marker's length around it
    is cut out, and these strings are joined to the markers on equality.  The markup is
    neither shuffled nor compared with every marker of a gram.  Null and empty markers match
    nothing; evidence is in marker order.  Only the longest marker's size and the gram
    lengths (at most four) come to the driver.
    """
    known = markers.select("platform", F.lower("marker").alias("marker")).where("marker <> ''").distinct()
    short = F.least(F.length("marker"), F.lit(GRAM))
    sizes = known.agg(F.max(F.length("marker")).alias("size"), F.sort_array(F.collect_set(short)).alias("lengths")).first()
    if sizes["size"] is None:
        return pages.select(key, F.lit("").alias("platform"), F.array(F.lit("")).alias("evidence")).limit(0)
    texts = once(pages, {"_blob": page_blob(html, headers)}).select(key, "_blob")
    places = _places(texts, [key], "_blob", sizes["size"], sizes["lengths"])
    index = settle(marker_index(places, known, sizes["size"]), "marker-index")
    found = possible_markers(places, index, [key], sizes["size"]).join(index.select("platform", "marker"), "marker")
    return found.groupBy(key, "platform").agg(F.sort_array(F.collect_list("marker")).alias("evidence"))


def rerender_candidates(
    fp: DataFrame, frameworks: Sequence[str] = tuple(fixed.FRAMEWORKS), ok: str | None = None
) -> DataFrame:
    """Pages worth rendering: nothing found, only frameworks found, or fetch failed."""
    in_set = F.forall("hits", lambda h: h["platform"].isin(*frameworks))
    wanted = (F.size("hits") == 0) | in_set
    if ok:
        wanted = wanted | ~F.col(ok)
    return fp.where(wanted)


def merge_passes(static: DataFrame, rendered: DataFrame, key: str = "page_id") -> DataFrame:
    """Add platforms that only the rendered page shows; earlier evidence wins.

    Both sides carry just the key and the hit lists, so the join never moves
    markup.  Of several rendered rows with one key the one with most hits counts (ties
    by their text).
    """
    most = F.max_by("hits", F.struct(F.size("hits"), F.to_json("hits")))
    extra = rendered.groupBy(key).agg(most.alias("_rendered"))

    def merged() -> Column:
        known = platforms(F.col("hits"))
        new = F.filter("_rendered", lambda h: ~F.array_contains(known, h["platform"]))
        return F.when(F.col("_rendered").isNull(), F.col("hits")).otherwise(
            F.concat(F.col("hits"), new)
        )

    return static.join(extra, key, "left").withColumn("hits", merged()).drop("_rendered")


def looks_like_spa(html: Column, markers: Sequence[str] = tuple(fixed.SPA_MARKERS)) -> Column:
    return F.exists(constant(list(markers), "array<string>"), lambda m: F.contains(html, m))


def spa_pages(pages: DataFrame) -> DataFrame:
    """Client-rendered shells per host."""
    return (
        pages.select(urls.host_of(F.col("url")).alias("host"),
                     looks_like_spa(F.col("html")).alias("spa"))
        .groupBy("host")
        .agg(F.count("*").alias("n_pages"), F.count_if("spa").alias("n_spa"))
    )


def stack_counts(fp: DataFrame, approximate: bool = False) -> DataFrame:
    """Sites and pages per platform.

    Page hits are first reduced to one row per (platform, host) with map-side
    combining, so a platform found everywhere does not gather its hosts in one
    task.
    """
    rows = explode_hits(fp).select("platform", urls.host_of(F.col("url")).alias("host"))
    if approximate:
        return rows.groupBy("platform").agg(
            F.approx_count_distinct("host").alias("n_sites"), F.count("*").alias("n_pages")
        )
    per_site = rows.groupBy("platform", "host").agg(F.count("*").alias("n"))
    return per_site.groupBy("platform").agg(
        F.count("*").alias("n_sites"), F.sum("n").alias("n_pages")
    )


def site_sketches(fp: DataFrame, keys: tuple[str, ...] = ("run",), size: int = 12) -> DataFrame:
    """Mergeable site counts: ``keys, platform, sketch, n_pages``, one row per run and platform.

    The sketch is a HyperLogLog of ``2^size`` registers (relative standard error
    1.04 / 2^(size / 2), 1.6 % at 12), so stored runs are counted together without
    their pages.
    """
    rows = explode_hits(fp).select(*keys, "platform", urls.host_of(F.col("url")).alias("host"))
    return rows.groupBy(*keys, "platform").agg(
        F.hll_sketch_agg("host", F.lit(size)).alias("sketch"), F.count("*").alias("n_pages"))


def merged_site_counts(sketches: DataFrame) -> DataFrame:
    """Sites and pages per platform over all stored runs; sites are estimated."""
    return sketches.groupBy("platform").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_sites"), F.sum("n_pages").alias("n_pages"))
