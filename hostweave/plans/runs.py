"""End-to-end runs over captured data.

Page work (fingerprint, text, contacts) is done once per address next to the
page; only its small results are joined to the jobs that collected the address.
Tables that several later steps read (collected addresses, page facts,
verification rows) are written once to the shared folder, so nothing before
them is planned or computed twice and a lost executor costs a file read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.functions import urls
from hostweave.functions.stages import once
from hostweave.operators import acceptance, contacts, history, labels, tech, text
from hostweave.operators.collect import clean_urls, first_by, first_per_host
from hostweave.operators.expand import expand_queries
from hostweave.operators.fetchlog import latest_by, resolve_fetch
from hostweave.session import settle
from hostweave.sources.captures import Captures
from hostweave.sources.tables import bulk_urls

SOCIALS = "map<string,array<string>>"


@dataclass
class Run:
    """The tables a run leaves behind; each may be written or queried further."""

    urls: DataFrame
    verifications: DataFrame
    summary: DataFrame
    queries: DataFrame | None = None


@dataclass
class PageWork:
    """Facts of captured pages, stacks of rendered ones, contacts of searched sites."""

    facts: DataFrame
    late: DataFrame | None
    found: DataFrame | None


def jobs_of(jobs: DataFrame, *tables: DataFrame) -> DataFrame:
    """The jobs that rows of ``tables`` (``job_id``) belong to, with the columns a run reads.

    A run joins jobs to its rows several times; the whole job table is read here only.
    """
    names = ("id", "tech_stacks", "custom_niche", "vertical", "classify_niche", "extract_contacts", "skip_tech_filter")
    ids = reduce(DataFrame.union, [t.select(F.col("job_id").alias("id")) for t in tables]).distinct()
    return settle(jobs.select(*[c for c in names if c in jobs.columns]).join(ids, "id", "left_semi"), "jobs")


def log_places(fetch_log: DataFrame) -> DataFrame:
    """``url, asked, landed, usable`` of each attempt: canonical address, its host, the host of
    the landing page, and whether that counts as landed.  Written once, without bodies."""
    named = once(fetch_log.select("url", "status", "final_url"), {"url": urls.canonical_url(F.col("url"))})
    return settle(named.select(
        "url", urls.host_of(F.col("url")).alias("asked"), urls.host_of(F.col("final_url")).alias("landed"),
        F.expr("status < 400 and final_url <> ''").alias("usable"),
    ), "log-places")


def site_hosts(fetch_log: DataFrame, wanted: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Hosts (``_host``) that ``wanted`` addresses ask for or land on.

    ``places`` are the `log_places` of the log, if these are known.
    """
    places = log_places(fetch_log) if places is None else places
    landed = places.where("usable").join(wanted.select("url"), "url", "left_semi")
    asked = wanted.select(urls.host_of(F.col("url")).alias("_host"))
    return settle(asked.union(landed.select("landed")).distinct(), "hosts")


def needs(collected: DataFrame, jobs: DataFrame) -> DataFrame:
    """What the jobs that collected an address ask for: ``url, label, search``.

    An address without a job is labelled and not searched for contacts.
    """
    asked = collected.select("job_id", "url").join(acceptance.job_flags(jobs), "job_id", "left")
    return settle(asked.groupBy("url").agg(
        F.max(F.coalesce("classify", F.lit(True))).alias("label"),
        F.max(F.coalesce("extract", F.lit(False))).alias("search"),
    ), "needs")


def resolved_pages(
    fetch_log: DataFrame, wanted: DataFrame, hosts: DataFrame | None = None, places: DataFrame | None = None,
) -> DataFrame:
    """One usable page per address: ``url, final_url, html, headers_text, search``.

    Resolved are ``wanted`` addresses and those that lie or land on ``hosts``, where
    contacts are searched (``search``); a site's contact and linked pages are among
    them.  Addresses are picked from `log_places` before the aggregate, so bodies of
    other sites are not compared.  Without ``hosts`` no site is searched.
    """
    log = fetch_log.select(
        urls.canonical_url(F.col("url")).alias("url"), "attempt", "status", "final_url",
        "headers_text", "body",
    )
    picked = wanted.select("url", F.lit(False).alias("search"))
    if hosts is not None:
        places = log_places(fetch_log) if places is None else places
        near = places.select("url", F.explode(F.array("asked", "landed")).alias("_host"))
        picked = picked.union(near.join(hosts, "_host", "left_semi").select("url", F.lit(True)))
    picked = picked.groupBy("url").agg(F.max("search").alias("search"))
    landed = F.when(F.col("final_url") != "", F.col("final_url")).otherwise(F.col("url"))
    return resolve_fetch(log.join(picked, "url")).where("ok").select(
        "url", landed.alias("final_url"), F.col("body").alias("html"), "headers_text", "search"
    )


def page_facts(pages: DataFrame, wanted: DataFrame, with_contacts: bool = True) -> DataFrame:
    """Everything later steps need from a page; the markup ends here.

    Stack (and, if a job asks for a label, text) is worked out for ``wanted``
    addresses, contacts for pages on the hosts that are searched, since contact
    pages are not collected themselves.  The result is written once because profiles
    and contacts both read it.
    """
    flagged = pages.join(wanted.select("url", F.col("label").alias("_label"), F.lit(True).alias("wanted")), "url", "left")
    is_wanted = F.coalesce("wanted", F.lit(False))
    staged = text.page_text(once(flagged, {
        "wanted": is_wanted,
        "_blob": F.when(is_wanted, tech.page_blob("html", "headers_text")).otherwise(""),
        "_readable": F.when(F.coalesce("_label", F.lit(False)), F.col("html")).otherwise(""),
        "_searched": F.when(F.col("search"), F.col("html")).otherwise(""),
    }), html="_readable")
    staged = tech.with_hits(staged.select(
        "url", "final_url", "wanted", "search", "title", "text", "_blob", "_searched",
    ))
    if not with_contacts:
        return settle(staged.drop("_searched"), "page-facts")
    return settle(contacts.page_contacts(staged, html="_searched", landed="final_url"), "page-facts")


def _longest(pages: DataFrame) -> DataFrame:
    """Of several captures of one address the longest."""
    return latest_by(pages.withColumn("_size", F.length("html")), ["url"], ["_size", "html"]).drop("_size")


def rendered_hits(rendered: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stacks of ``wanted`` addresses as captured after client-side rendering.

    Of several captures of one address the longest counts.
    """
    pages = rendered.select(urls.canonical_url(F.col("url")).alias("url"), "html")
    single = _longest(pages.join(wanted.select("url"), "url", "left_semi"))
    staged = tech.with_hits(once(single, {"_blob": tech.page_blob("html", None)}, drop=("html",)))
    return settle(staged, "rendered-hits")


def rendered_contacts(rendered: DataFrame, hosts: DataFrame) -> DataFrame:
    """Contacts of rendered pages on ``hosts``, where contacts are searched."""
    pages = rendered.select(urls.canonical_url(F.col("url")).alias("url"), "html")
    near = pages.join(hosts, urls.host_of(F.col("url")) == F.col("_host"), "left_semi")
    return settle(contacts.page_contacts(_longest(near)), "rendered-contacts")


def profiles(wanted: DataFrame, facts: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Stack, title and text of each wanted address.

    An address without a usable page keeps ``ok = false`` and no stack, title or
    text.
    """
    known = facts.where("wanted").select("url", "final_url", "title", "text", "hits")
    pages = wanted.select("url").join(known, "url", "left").select(
        "url", F.col("final_url").isNotNull().alias("ok"),
        F.coalesce("final_url", "url").alias("final_url"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("hits", F.array().cast(tech.HITS_TYPE)).alias("hits"),
    )
    if rendered is not None:
        candidates = tech.rerender_candidates(pages, ok="ok").select("url")
        late = rendered.select("url", "hits").join(candidates, "url", "left_semi")
        pages = tech.merge_passes(pages, late, key="url")
    return once(pages, {"platforms": tech.platforms(F.col("hits"))})


def judged(
    rows: DataFrame, work: PageWork, scorer: labels.Scorer | None = None,
    service: labels.Service | None = None,
) -> DataFrame:
    """Add stack and verdict to ``rows`` (``url``, ``niche`` and ``classify``).

    A ``service`` is asked once for each address and niche that is to be classified,
    about the niche if there is one, else about the categories.  Without one the
    scorer (or the lexicon) labels each address, whatever the niche.  An address without
    a page is judged by the words of its URL.
    """
    pages = profiles(rows.select("url").distinct(), work.facts, work.late)
    shown = pages.withColumnsRenamed({"url": "requested", "final_url": "url"})
    if service is None:
        told = labels.label_pages(shown, scorer).withColumnsRenamed({"url": "final_url", "requested": "url"})
        return rows.join(told.drop("title", "text"), "url")
    questions = rows.where("classify").select(F.col("url").alias("requested"), "niche").distinct()
    asked = questions.join(shown.select("requested", "url", "title", "text"), "requested")
    asked = labels.label_requests(asked.withColumn("about", F.col("niche")), niche="about")
    answers = labels.ask(asked, service, keys=("requested", "niche")).withColumnRenamed("requested", "url")
    return rows.join(pages.drop("title", "text"), "url").join(answers, ["url", "niche"], "left")


def site_contacts(facts: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Assembled contacts per site base address of searched pages."""
    sites = facts.where("wanted and search").select(
        contacts.site_base(F.col("final_url")).alias("site")
    ).distinct()
    found = contacts.staged_contacts(sites, facts, rendered, landed="final_url")
    return contacts.assemble_contacts(contacts.contact_cascade(found))


def page_work(wanted: DataFrame, fetch_log: DataFrame | Captures, rendered: DataFrame | None) -> PageWork:
    """Work on the pages of ``wanted`` addresses (`needs`), and on the pages of the hosts
    that addresses with ``search`` ask for or land on.

    If no address is searched for contacts, nothing is extracted and no other page
    of a host is read.  Of a stored log only files that may hold such pages are read.
    """
    if isinstance(fetch_log, Captures):
        fetch_log = fetch_log.around(wanted)
    searched = wanted.where("search")
    search = not searched.isEmpty()
    places = log_places(fetch_log) if search else None
    hosts = site_hosts(fetch_log, searched, places) if search else None
    facts = page_facts(resolved_pages(fetch_log, wanted, hosts, places), wanted, search)
    late = None if rendered is None else rendered_hits(rendered, wanted)
    shown = None if rendered is None or not search else rendered_contacts(rendered, hosts)
    return PageWork(facts, late, site_contacts(facts, shown) if search else None)


def verify(
    collected: DataFrame, jobs: DataFrame, work: PageWork,
    scorer: labels.Scorer | None = None, service: labels.Service | None = None,
) -> DataFrame:
    """Verification rows of collected (job_id, host, url, write_order) rows.

    A page that several jobs collected is profiled once, and asked about once per
    niche.  Rows that land on the same domain within a job collapse to the last one
    collected.  A job that does not classify keeps the label Unknown; one that does
    not ask for contacts has none.
    """
    flags = acceptance.job_flags(jobs)
    rows = collected.withColumnRenamed("host", "requested_host").join(flags, "job_id", "left").withColumns({
        "niche": F.coalesce("niche", F.lit("")), "classify": F.coalesce("classify", F.lit(True)),
        "extract": F.coalesce("extract", F.lit(False)),
    })
    classify, extract = F.col("classify"), F.col("extract")
    joined = judged(rows, work, scorer, service).drop("hits")
    if work.found is not None:
        joined = joined.withColumn("site", contacts.site_base(F.col("final_url"))).join(work.found, "site", "left")
    else:
        joined = joined.withColumns({
            "emails": F.array().cast("array<string>"), "phones": F.array().cast("array<string>"),
            "socials": F.create_map().cast(SOCIALS)})
    empty = F.array().cast("array<string>")
    rows = joined.select(
        "job_id", "requested_host", "write_order",
        F.col("final_url").alias("url"), urls.host_of(F.col("final_url")).alias("domain"),
        "platforms", F.when(classify, F.col("vertical")).otherwise("Unknown").alias("vertical"),
        F.when(classify, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(classify, F.col("reason")).otherwise("").alias("reason"),
        F.coalesce(F.when(extract, F.col("emails")), empty).alias("emails"),
        F.coalesce(F.when(extract, F.col("phones")), empty).alias("phones"),
        F.coalesce(F.when(extract, F.col("socials")), F.create_map().cast(SOCIALS)).alias("socials"),
    )
    last = latest_by(rows, ["job_id", "domain"], ["write_order", "requested_host"])
    return settle(last, "verifications")


def run_campaign(
    jobs: DataFrame, links: DataFrame, fetch_log: DataFrame | Captures,
    campaigns: DataFrame | None = None, rendered: DataFrame | None = None,
    scorer: labels.Scorer | None = None, service: labels.Service | None = None,
) -> Run:
    """Links and fetch attempts of campaigns to accepted and rejected sites."""
    collected = settle(first_per_host(clean_urls(links)).withColumn(
        "write_order", F.struct("query_idx", "page_no", "rank")
    ), "urls")
    jobs = jobs_of(jobs, collected)
    work = page_work(needs(collected, jobs), fetch_log, rendered)
    ver = acceptance.accept(verify(collected, jobs, work, scorer, service), jobs)
    return Run(
        urls=collected, verifications=ver, summary=acceptance.run_summary(collected, ver),
        queries=None if campaigns is None else expand_queries(campaigns),
    )


def run_bulk(
    lists: DataFrame, jobs: DataFrame, fetch_log: DataFrame | Captures,
    rendered: DataFrame | None = None, scorer: labels.Scorer | None = None,
    service: labels.Service | None = None,
) -> Run:
    """Verify given addresses: canonical form and excluded domains only."""
    usable = bulk_urls(lists).where(~F.col("skipped") & (F.col("host") != ""))
    first = first_by(
        usable.select("job_id", "host", "list_id", "pos", "url"), ["job_id", "host"],
        ["list_id", "pos", "url"],
    )
    collected = settle(first.withColumn("write_order", F.struct("list_id", "pos")), "urls")
    jobs = jobs_of(jobs, collected)
    work = page_work(needs(collected, jobs), fetch_log, rendered)
    ver = acceptance.accept(verify(collected, jobs, work, scorer, service), jobs, policy="resume")
    return Run(urls=collected, verifications=ver,
               summary=acceptance.run_summary(collected, ver))


def run_resume(
    jobs: DataFrame, collected: DataFrame, ver: DataFrame, fetch_log: DataFrame | Captures,
    rendered: DataFrame | None = None, scorer: labels.Scorer | None = None,
    service: labels.Service | None = None,
) -> Run:
    """Finish interrupted jobs.

    Unverified hosts are verified; unknown labels are asked again for jobs that
    classify, missing contacts are looked up again for jobs that want them, and
    every row is decided anew.  Pages are worked on once for both.  ``ver`` has
    ``requested_host``, so a redirected host is not taken for an open one.
    """
    todo = settle(history.remaining_urls(collected, ver, host="requested_host"), "todo")
    jobs = jobs_of(jobs, todo, ver)
    flagged = ver.join(acceptance.job_flags(jobs), "job_id", "left")
    unknown = ~labels.usable_label(F.col("vertical")) & F.coalesce("classify", F.lit(True))
    bare = history.without_contacts() & F.coalesce("extract", F.lit(False))
    again = settle(flagged.where(unknown | bare).select(
        "job_id", "domain", urls.canonical_url(F.col("url")).alias("url"), F.coalesce("niche", F.lit("")).alias("niche"),
        unknown.alias("unknown"), bare.alias("bare"),
    ), "again")
    both = needs(todo, jobs).union(again.select("url", F.col("unknown"), F.col("bare")))
    wanted = settle(both.groupBy("url").agg(F.max("label").alias("label"), F.max("search").alias("search")), "wanted")
    work = page_work(wanted, fetch_log, rendered)
    fresh = verify(todo, jobs, work, scorer, service)
    second = judged(again.where("unknown").withColumn("classify", F.lit(True)), work, scorer, service)
    kept = labels.sweep_unknown(ver, second.select("job_id", "domain", "vertical", "confidence", "reason"))
    if work.found is not None:
        kept = fill_contacts(kept, work.found, jobs)
    both = kept.withColumn("_round", F.lit(0)).unionByName(
        fresh.withColumn("_round", F.lit(1)), allowMissingColumns=True
    )
    current = latest_by(both, ["job_id", "domain"], ["_round", "requested_host"])
    current = settle(current.drop("_round"), "verifications")
    done = acceptance.accept(current, jobs, policy="resume")
    return Run(urls=collected, verifications=done,
               summary=acceptance.run_summary(collected, done))


def fill_contacts(ver: DataFrame, found: DataFrame, jobs: DataFrame) -> DataFrame:
    """Give rows without any contact those found for their address, if the job asks."""
    fields = ["emails", "phones", "socials"]
    rows = ver.join(acceptance.job_flags(jobs), "job_id", "left").withColumns({
        "site": contacts.site_base(F.col("url")),
        "_bare": history.without_contacts() & F.coalesce("extract", F.lit(False)),
    })
    joined = rows.join(
        found.select("site", F.struct(*fields).alias("_found")), "site", "left"
    ).withColumn("_use", F.col("_bare") & F.col("_found").isNotNull())
    return joined.withColumns({
        f: F.when(F.col("_use"), F.col(f"_found.{f}")).otherwise(F.col(f)) for f in fields
    }).select(*ver.columns)


def verify_domains(
    addresses: DataFrame, fetch_log: DataFrame | Captures, rendered: DataFrame | None = None,
    scorer: labels.Scorer | None = None, service: labels.Service | None = None,
) -> DataFrame:
    """Stack and label of given addresses, without a job."""
    wanted = addresses.select(urls.canonical_url(F.col("url")).alias("url")).distinct()
    wanted = wanted.withColumns({"label": F.lit(True), "search": F.lit(False)})
    work = page_work(wanted, fetch_log, rendered)
    asked = wanted.select("url", F.lit("").alias("niche"), F.lit(True).alias("classify"))
    rows = judged(asked, work, scorer, service)
    return rows.select(
        F.col("final_url").alias("url"), urls.host_of(F.col("final_url")).alias("domain"),
        "platforms", "hits",
        F.when(F.col("ok"), F.col("vertical")).otherwise("Unknown").alias("vertical"),
        F.when(F.col("ok"), F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("ok"), F.col("reason")).otherwise("fetch failed").alias("reason"),
    )
