"""Business contact details on captured pages.

Extraction is a projection over each page (`page_contacts`), so markup never
crosses the network; every later step moves only small value rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostweave.functions import fixed, markup, urls
from hostweave.functions.stages import once
from hostweave.operators import tech, text
from hostweave.session import settle

VALUE_TYPE = "array<struct<kind:string,network:string,value:string>>"
KINDS = ("email", "phone", "social")

# Stages of the staged search, in the order they are tried.
PAYLOAD, FOOTER, HOME, RENDERED_FOOTER, RENDERED_HOME = 0, 1, 2, 3, 4
FIRST_EXTRA = 5
FIRST_LINK = FIRST_EXTRA + len(fixed.CONTACT_PATHS)

_LOCAL = r"A-Za-z0-9._%+\-"
# A match may only start where a run of address characters starts (or where the
# last match ended).  Later starts in a run fail like the first, so skipping
# them changes no result and keeps long runs (path data, hex) linear.
_PLAIN = (
    rf"(?:(?<![{_LOCAL}])[.%+\-]*+\b|\G\b)"
    rf"([{_LOCAL}]++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b)"
)
_MAILTO = r"""(?i)mailto:([^"'\s>?]+)"""
_SPELLED = (
    rf"(?i)(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\s*+[\[(]\s*at\s*[\])]\s*"
    r"[A-Za-z0-9.\-]+\s*[\[(]\s*dot\s*[\])]\s*[A-Za-z]{2,}"
)
_SPELLED_PARTS = (
    r"(?i)^(.+?)\s*[\[(]\s*at\s*[\])]\s*(.+?)\s*[\[(]\s*dot\s*[\])]\s*([A-Za-z]+)$"
)
_TEL = r"""(?i)tel:([^"'\s>?]+)"""
_CONTEXT = "|".join(fixed.PHONE_CONTEXT)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# --- e-mail addresses ---------------------------------------------------------

def usable_email(address: Column) -> Column:
    """Not a placeholder, an asset name or overlong."""
    low = F.lower(address)
    suffixes = "|".join(fixed.EMAIL_ASSET_SUFFIXES)
    return (
        (F.length(address) <= 80)
        & ~low.rlike(urls.any_of(fixed.EMAIL_JUNK))
        & ~low.rlike(rf"\.({suffixes})$")
    )


def decode_protected(code: Column) -> Column:
    """Undo the XOR-hex form: the first byte is the key of all others."""
    def byte(at: Column) -> Column:
        return F.conv(F.substring(code, at, F.lit(2)), 16, 10).cast("int")

    key = byte(F.lit(1))
    chars = F.transform(
        F.sequence(F.lit(3), F.length(code), F.lit(2)),
        lambda i: F.char(byte(i).bitwiseXOR(key)),
    )
    return F.when(F.length(code) >= 3, F.array_join(chars, "")).otherwise("")


def emails_in(html: Column) -> Column:
    """Addresses in plain, ``mailto:``, spelled-out and XOR-hex form.

    Each form is searched only on pages that carry its telltale mark.
    """
    def where(mark: Column, found: Column) -> Column:
        return F.when(mark, found).otherwise(F.array().cast("array<string>"))

    plain = F.transform(
        F.filter(_all(html, _PLAIN, 1), usable_email),
        lambda e: F.btrim(e, F.lit(".,;:()[]{}")),
    )
    mailto = F.filter(_all(html, _MAILTO, 1), usable_email)
    spelled = F.filter(
        F.transform(
            _all(html, _SPELLED, 0),
            lambda s: F.regexp_replace(s, _SPELLED_PARTS, "$1@$2.$3"),
        ),
        usable_email,
    )
    hidden = F.filter(
        F.transform(_all(html, 'data-cfemail="([0-9a-fA-F]+)"', 1), decode_protected),
        usable_email,
    )
    found = F.array_distinct(F.concat(
        where(html.contains("@"), plain), mailto,
        where(html.rlike(r"(?i)[\[(]\s*at\s*[\])]"), spelled),
        where(html.contains("data-cfemail"), hidden),
    ))
    return F.filter(found, lambda e: e != "")


# --- phone numbers ------------------------------------------------------------

def normal_phone(raw: Column) -> Column:
    """Digits and ``+``; ``''`` unless 8 to 16 characters remain."""
    kept = F.regexp_replace(raw, r"[^0-9+]", "")
    return F.when(F.length(kept).between(8, 16), kept).otherwise("")


def phone_chunks(text: Column) -> Column:
    """Stretches of text that end up to 120 characters after a context word.

    A chunk never crosses a full stop, so the text is split there first and
    stretches without a context word are dropped.  Cutting a stretch 120
    characters after its *last* context word removes the tail on which the lazy
    scan would restart at every character; no chunk reaches beyond that cut.
    """
    stretches = F.filter(F.split(text, r"\."), lambda s: s.rlike(f"(?i){_CONTEXT}"))
    trimmed = F.transform(
        stretches, lambda s: F.regexp_extract(s, rf"(?is)^.*(?:{_CONTEXT}).{{0,120}}", 0)
    )
    return F.flatten(F.transform(
        trimmed, lambda s: _all(s, rf"(?is).*?(?:{_CONTEXT}).{{0,120}}", 0)
    ))


def phones_in(html: Column) -> Column:
    text = markup.visible_text(html, markup.PHONE_SKIPS)
    links = F.transform(_all(html, _TEL, 1), normal_phone)
    spoken = F.flatten(F.transform(
        phone_chunks(text), lambda c: _all(c, fixed.PHONE_PATTERN, 0)
    ))
    spoken = F.filter(F.transform(spoken, normal_phone), lambda p: F.length(p) >= 9)
    found = F.array_distinct(F.concat(links, spoken))
    return F.filter(found, lambda p: p != "")


# --- social handles -----------------------------------------------------------

def socials_in(html: Column) -> Column:
    """Handles as structs of network and value."""
    def network(name: str, pattern: str) -> Column:
        return F.transform(_all(html, f"(?i){pattern}", 1), lambda h: _value("social", name, h))

    def tidy(entry: Column) -> Column:
        handle = F.btrim(entry["value"], F.lit(urls.BLANKS))
        return entry.withField("value", F.when(
            F.lower(handle).isin(*fixed.SOCIAL_STOPWORDS), ""
        ).when(entry["network"] == "whatsapp", normal_phone(handle)).otherwise(handle))

    every = F.concat(*[network(n, p) for n, p in fixed.SOCIAL_PATTERNS.items()])
    return F.filter(F.array_distinct(F.transform(every, tidy)), lambda e: e["value"] != "")


def _value(kind: str, network: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(network).alias("network"),
                    value.alias("value"))


def contacts_in(html: Column) -> Column:
    """Every contact of a piece of markup as (kind, network, value) structs."""
    return F.concat(
        F.transform(emails_in(html), lambda v: _value("email", "", v)),
        F.transform(phones_in(html), lambda v: _value("phone", "", v)),
        socials_in(html),
    ).cast(VALUE_TYPE)


# --- structured payloads ------------------------------------------------------

def payloads(html: Column) -> Column:
    """Data blocks a page carries for machines, one array element per block."""
    next_data = F.regexp_extract(
        html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(\{.*?\})</script>', 1
    )
    nuxt = F.regexp_extract(html, r"(?s)window\.__NUXT__\s*=\s*(\{.*?\});", 1)
    linked = _all(html, r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    same_as = F.flatten(F.transform(
        F.flatten(F.transform(linked, lambda b: _all(b, r'"sameAs"\s*:\s*\[([^\]]+)\]', 1))),
        lambda urls_: _all(urls_, '"(https?://[^"]+)"', 1),
    ))
    blocks = F.concat(F.array(next_data), linked, same_as, F.array(nuxt))
    return F.filter(blocks, lambda b: b != "")


def payload_blobs(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per payload block; pages without one vanish."""
    keep = [c for c in pages.columns if c != html]
    found = once(pages, {"_blocks": payloads(F.col(html))}, drop=(html,))
    return found.select(*keep, F.posexplode("_blocks").alias("block_no", "block"))


def payload_contacts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    blobs = payload_blobs(pages.select(key, "html"))
    found = once(blobs, {"_v": contacts_in(F.col("block"))}).select(key, "_v")
    return _rows(found, "_v").distinct()


def _rows(df: DataFrame, column: str) -> DataFrame:
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.explode(column).alias("_v")).select(*keep, "_v.*")


def emails(pages: DataFrame, key: str = "page_id") -> DataFrame:
    found = once(pages.select(key, "html"), {"_v": emails_in(F.col("html"))})
    return found.select(key, F.explode("_v").alias("email"))


def phones(pages: DataFrame, key: str = "page_id") -> DataFrame:
    found = once(pages.select(key, "html"), {"_v": phones_in(F.col("html"))})
    return found.select(key, F.explode("_v").alias("phone"))


def socials(pages: DataFrame, key: str = "page_id") -> DataFrame:
    found = once(pages.select(key, "html"), {"_v": socials_in(F.col("html")).cast(VALUE_TYPE)})
    return _rows(found.select(key, "_v"), "_v").select(
        key, "network", F.col("value").alias("handle")
    )


# --- candidate pages ----------------------------------------------------------

def site_base(url: Column) -> Column:
    return F.rtrim(urls.canonical_url(url), F.lit("/"))


def _base_of(url: Column, path: str) -> Column:
    return F.substring(url, F.lit(1), F.length(url) - len(path))


def page_roles(pages: DataFrame, landed: str = "url") -> DataFrame:
    """Which site a page may belong to, and at which stage.

    A page is the home page of the address it landed on, and a contact page of
    its requested address minus a contact path.  Reading the role off the page's
    own URL replaces a product of all sites with all contact paths by one
    equi-join.
    """
    url = F.col("_url")
    options = [F.struct(site_base(F.col(landed)).alias("site"), F.lit(HOME).alias("stage"))]
    for i, path in enumerate(fixed.CONTACT_PATHS):
        base = _base_of(url, path)
        options.append(F.when(
            url.endswith(path), F.struct(base.alias("site"), F.lit(FIRST_EXTRA + i).alias("stage"))
        ))
    roles = F.array_compact(F.array(*options))
    keep = pages.columns
    staged = once(pages, {"_url": site_base(F.col("url"))})
    return staged.select(*keep, F.explode(roles).alias("_r")).select(
        *keep, F.col("_r.site").alias("site"), F.col("_r.stage").alias("stage")
    )


def contact_candidates(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Captured contact pages of each site; ``sites`` has one ``site`` base per row."""
    roles = page_roles(pages.select("url")).where(F.col("stage") >= FIRST_EXTRA)
    return roles.join(sites.select("site"), "site", "left_semi").select(
        "site", "stage", urls.canonical_url(F.col("url")).alias("url")
    )


def link_targets(home: Column, html: Column, footer: Column) -> Column:
    """Contact-like same-host links in the footer, or in the page if it has none."""
    region = F.when(footer != "", footer).otherwise(html)
    origin = F.regexp_extract(home, "^(https?://[^/?#]+)", 1)
    words = "|".join(fixed.CONTACT_LINK_WORDS)

    def target(anchor: Column) -> Column:
        href = F.btrim(markup.href_of(anchor), F.lit(urls.BLANKS))
        label = F.lower(_label(anchor))
        wanted = F.concat_ws(" ", F.lower(href), label).rlike(words)
        full = F.when(href.startswith("http"), href).when(
            href.startswith("/"), F.concat(origin, href)
        )
        same = urls.host_of(full) == urls.host_of(home)
        return F.when(wanted & same, urls.canonical_url(full))

    return F.array_distinct(F.array_compact(F.transform(markup.anchors(region), target)))


def _label(anchor: Column) -> Column:
    return F.regexp_replace(anchor, r"<[^>]*>", " ")


def footer_links(sites: DataFrame, pages: DataFrame, limit: int | None = None) -> DataFrame:
    """The captured pages a site's home page links as contact pages, in page order."""
    homes = page_roles(pages.select("url", "html")).where(F.col("stage") == HOME)
    homes = homes.join(sites.select("site"), "site", "left_semi")
    homes = text.with_footer(homes, name="_footer")
    homes = once(homes, {"links": link_targets(F.col("url"), F.col("html"), F.col("_footer"))})
    links = homes.select("site", F.posexplode("links").alias("pos", "url"))
    return first_links(links, pages.select(urls.canonical_url(F.col("url")).alias("url")), limit)


def first_links(links: DataFrame, captured: DataFrame, limit: int | None = None) -> DataFrame:
    """Drop links the contact paths already cover; number the captured rest.

    ``limit`` keeps the first links of a site only.
    """
    covered = F.array(*[F.concat(F.col("site"), F.lit(p)) for p in ("", *fixed.CONTACT_PATHS)])
    once = links.groupBy("site", "url").agg(F.min("pos").alias("pos"))
    fresh = once.where(~F.array_contains(covered, F.rtrim(F.col("url"), F.lit("/"))))
    known = fresh.join(captured, "url", "left_semi")
    w = Window.partitionBy("site").orderBy("pos", "url")
    ranked = known.withColumn("nth", F.row_number().over(w))
    return (
        (ranked if limit is None else ranked.where(F.col("nth") <= limit))
        .select("site", (F.col("nth") + (FIRST_LINK - 1)).alias("stage"), "url")
    )


# --- staged search ------------------------------------------------------------

def page_contacts(pages: DataFrame, html: str = "html", landed: str = "url") -> DataFrame:
    """Replace a page's markup by its contacts.

    Adds ``payload``, ``footer`` and ``whole`` (contacts by place), ``links``
    (contact-like pages it links) and ``spa``.  The three places are scanned by
    one expression over an array, which keeps the plan a third of the size.
    """
    keep = [c for c in pages.columns if c != html]
    marked = text.with_footer(pages, html, "_footer")
    staged = once(marked, _page_columns(html, landed), drop=(html, "_footer"))
    return staged.select(
        *keep, F.col("_found")[0].alias("payload"), F.col("_found")[1].alias("footer"),
        F.col("_found")[2].alias("whole"), "links", "spa",
    )


@lru_cache(maxsize=8)
def _page_columns(html: str, landed: str) -> dict[str, Column]:
    page = F.col(html)
    places = F.array(
        F.array_join(payloads(page), "\n\x01.\x01\n"), F.col("_footer"), page
    )
    return {
        "_found": F.transform(places, contacts_in),
        "links": link_targets(F.col(landed), page, F.col("_footer")), "spa": tech.looks_like_spa(page),
    }


def staged_contacts(
    sites: DataFrame, found: DataFrame, rendered: DataFrame | None = None, landed: str = "url"
) -> DataFrame:
    """All contacts of each site with the stage that shows them.

    ``sites``: ``site`` (base address).  ``found`` and ``rendered`` come from
    `page_contacts`, so the joins move value arrays keyed by address, not pages.
    ``found`` is read more than once: write it first (`session.settle`).
    """
    base = once(found, {"_url": site_base(F.col("url")), "_home": site_base(F.col(landed))})
    by_place = [
        F.struct(F.col("_home").alias("site"), F.lit(stage).alias("stage"), F.col(v).alias("v"))
        for stage, v in ((PAYLOAD, "payload"), (FOOTER, "footer"), (HOME, "whole"))
    ]
    by_path = [
        F.when(F.col("_url").endswith(path), F.struct(
            _base_of(F.col("_url"), path).alias("site"),
            F.lit(FIRST_EXTRA + i).alias("stage"), F.col("whole").alias("v"),
        )) for i, path in enumerate(fixed.CONTACT_PATHS)
    ]
    placed = once(base, {"_p": F.filter(
        F.array(*by_place, *by_path), lambda p: F.size(p["v"]) > 0
    )}).select(F.inline("_p"))
    parts = [placed.join(sites.select("site"), "site", "left_semi")]

    captured = found.select(urls.canonical_url(F.col("url")).alias("url"), "whole")
    linked = base.where(F.size("links") > 0).select(
        F.col("_home").alias("site"), F.posexplode("links").alias("pos", "url")
    ).join(sites.select("site"), "site", "left_semi")
    parts.append(
        first_links(linked, captured.select("url").distinct())
        .join(captured.where(F.size("whole") > 0), "url")
        .select("site", "stage", F.col("whole").alias("v"))
    )
    if rendered is not None:
        shells = base.where("spa").select(F.col("_home").alias("site")).join(
            sites.select("site"), "site", "left_semi"
        ).distinct()
        late = rendered.select(site_base(F.col("url")).alias("site"), F.array(
            F.struct(F.lit(RENDERED_FOOTER).alias("stage"), F.col("footer").alias("v")),
            F.struct(F.lit(RENDERED_HOME).alias("stage"), F.col("whole").alias("v")),
        ).alias("_p"))
        parts.append(late.join(shells, "site", "left_semi").select("site", F.inline("_p")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _rows(out, "v")


def _open_sites(sites: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """``sites`` for which the rows found so far are not enough to stop."""
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    has = {k: F.max(F.col("kind") == k).alias(k) for k in KINDS}
    done = found.groupBy("site").agg(*has.values()).where(
        F.col("email") | (F.col("phone") & F.col("social")))
    return settle(sites.join(done.select("site"), "site", "left_anti"), "open-sites")


def search_contacts(
    sites: DataFrame, pages: DataFrame, rendered: DataFrame | None = None,
    html: str = "html", landed: str = "url",
) -> DataFrame:
    """Contacts by stage as `staged_contacts`, but a site that has enough is not
    searched further.

    Three rounds: home pages; rendered pages of open client-side sites; contact and
    linked pages of sites that are still open.  Only pages of open sites have their
    markup scanned in a round.  `contact_cascade` keeps the same rows of either.
    """
    sites = settle(sites.select("site").distinct(), "sites")
    pages = once(pages, {"_url": site_base(F.col("url")), "_home": site_base(F.col(landed))})
    homes = pages.join(sites.select(F.col("site").alias("_home")), "_home", "left_semi")
    found = settle(page_contacts(homes, html, landed), "home-contacts")

    def at(*stages: tuple[int, str]):
        return F.inline(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(v).alias("v")) for n, v in stages]))

    first = found.select(F.col("_home").alias("site"), at((PAYLOAD, "payload"), (FOOTER, "footer"), (HOME, "whole")))
    parts = [settle(_rows(first, "v"), "round")]
    left = _open_sites(sites, parts)
    if rendered is not None:
        shells = found.where("spa").select(F.col("_home").alias("site")).join(left, "site", "left_semi").distinct()
        late = rendered.select(site_base(F.col("url")).alias("site"), "url", "html").join(shells, "site", "left_semi")
        late = page_contacts(late).select("site", at((RENDERED_FOOTER, "footer"), (RENDERED_HOME, "whole")))
        parts.append(settle(_rows(late, "v"), "round"))
        left = _open_sites(left, parts)
    address = urls.canonical_url(F.col("url")).alias("url")
    captured = pages.select(address).distinct()
    paths = [F.when(F.col("_url").endswith(path), F.struct(
        _base_of(F.col("_url"), path).alias("site"), F.lit(FIRST_EXTRA + i).alias("stage"),
    )) for i, path in enumerate(fixed.CONTACT_PATHS)]
    by_path = pages.select(address, F.inline(F.array_compact(F.array(*paths)))).join(left, "site", "left_semi")
    linked = found.select(F.col("_home").alias("site"), F.posexplode("links").alias("pos", "url"))
    linked = first_links(linked.join(left, "site", "left_semi"), captured)
    targets = settle(by_path.select("site", "stage", "url").union(linked).distinct(), "targets")
    looked = pages.select(address, F.col(html).alias("_page")).join(
        targets.select("url").distinct(), "url", "left_semi")
    looked = once(looked, {"v": contacts_in(F.col("_page"))}, drop=("_page",))
    parts.append(_rows(targets.join(looked, "url").select("site", "stage", "v"), "v"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def contact_cascade(contacts: DataFrame) -> DataFrame:
    """Keep what a stage-by-stage search with early stop would have found.

    The search stops once a site has an e-mail, or a phone and a social handle;
    the first two stages are always searched.  Values are reduced to their
    first stage and then to one count row per (site, stage), a few rows more than a
    site has contact links, before anything is ordered.
    """
    firsts = contacts.groupBy("site", "kind", "network", "value").agg(
        F.min("stage").alias("first_stage")
    )
    per_stage = firsts.groupBy("site", "first_stage").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    )
    w = Window.partitionBy("site").orderBy("first_stage").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = per_stage.select(
        "site", "first_stage", *[F.sum(k).over(w).alias(k) for k in KINDS]
    )
    enough = (F.col("email") >= 1) | ((F.col("phone") >= 1) & (F.col("social") >= 1))
    stops = running.where(enough).groupBy("site").agg(F.min("first_stage").alias("_stop"))
    searched = F.col("_stop").isNull() | (
        F.col("first_stage") <= F.greatest(F.col("_stop"), F.lit(FOOTER))
    )
    return firsts.join(stops, "site", "left").where(searched).drop("_stop")


def assemble_contacts(kept: DataFrame, caps: Mapping[str, int] | None = None) -> DataFrame:
    """One row per site: sorted lists of all its contacts.

    ``caps`` (a number per kind) shortens the lists of a report; it is applied by
    rank before any list is built.
    """
    ranked = kept.select("site", "kind", "network", "value").distinct()
    if caps is not None:
        w = Window.partitionBy("site", "kind", "network").orderBy("value")
        most = F.create_map(*[x for k, n in caps.items() for x in (F.lit(k), F.lit(n))])
        ranked = ranked.withColumn("_n", F.row_number().over(w)) \
            .where(F.col("_n") <= F.coalesce(most[F.col("kind")], F.col("_n")))

    def listed(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("value"))))

    grouped = ranked.groupBy("site").agg(
        listed(F.col("kind") == "email").alias("emails"),
        listed(F.col("kind") == "phone").alias("phones"),
        *[listed((F.col("kind") == "social") & (F.col("network") == n)).alias(n)
          for n in fixed.SOCIAL_PATTERNS],
    )
    networks = list(fixed.SOCIAL_PATTERNS)
    by_network = F.map_from_arrays(
        F.array(*[F.lit(n) for n in networks]), F.array(*[F.col(n) for n in networks])
    )
    return grouped.select(
        "site", "emails", "phones",
        F.map_filter(by_network, lambda _, v: F.size(v) > 0).alias("socials"),
    )
