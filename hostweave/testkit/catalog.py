"""Every operator as a named query over a folder of sample tables.

Queries flatten their result for comparison: whole numbers become bigint, lists
become text.  Nothing else happens here; the work is in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostweave.operators import (
    acceptance, collect, contacts, expand, fetchlog, history, labels, tech, text,
)
from hostweave.plans import runs
from hostweave.session import settle, work_dir
from hostweave.sources import captures, exports, store, tables
from hostweave.streaming import live
from hostweave.testkit import services
from hostweave.testkit.overlays import spark_overlay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def flat(df: DataFrame) -> DataFrame:
    """Bigint for whole numbers, ``|``-joined text for lists, text for times."""
    def convert(field: T.StructField):
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.MapType):
            entries = F.array_sort(F.transform(
                F.map_entries(column),
                lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")),
            ))
            column = F.array_join(entries, "|")
        return column.alias(field.name)

    return df.select(*[convert(f) for f in df.schema.fields])


class Tables:
    """The overlays of one folder, shaped as the operators want them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        self._views: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._views:
            self._views[name] = spark_overlay(self._spark, self._dir, name)
        return self._views[name]

    @property
    def jobs(self) -> DataFrame:
        stacks = F.filter(F.split("stacks", ","), lambda s: s != "")
        return self.fx_jobs.withColumns({
            "tech_stacks": stacks, "ended_at": F.lit(None).cast("timestamp_ntz"),
        }).drop("stacks")

    @property
    def history(self) -> DataFrame:
        return tables.decode_verifications(self.fx_history)

    def verified(self, *columns: str) -> DataFrame:
        """Current verification rows; only the needed columns are reduced and decoded."""
        wanted = ["job_id", "domain", "version", "tiebreak", *columns]
        raw = self.fx_history.select(*wanted)
        return tables.decode_verifications(
            fetchlog.latest_by(raw, ["job_id", "domain"], ["version", "tiebreak"])
        )

    @property
    def verifications(self) -> DataFrame:
        return self.verified("url", "platforms", "vertical", "confidence", "reason", "accepted",
                             "emails", "phones", "socials")

    @property
    def urls(self) -> DataFrame:
        return collect.first_by(self.fx_urls, ["job_id", "host"], ["seq", "tiebreak"])

    @property
    def cleaned(self) -> DataFrame:
        return collect.clean_urls(self.fx_links)

    @property
    def sites(self) -> DataFrame:
        homes = F.regexp_extract("url", "^https?://[^/?#]+", 0)
        return self.fx_crawl.select(contacts.site_base(homes).alias("site")).distinct()

    @property
    def crawl(self) -> DataFrame:
        return self.fx_crawl.select("url", "html")

    @property
    def staged(self) -> DataFrame:
        return contacts.staged_contacts(
            settle(self.sites, "sites"),
            settle(contacts.page_contacts(self.crawl), "page-contacts"),
            settle(contacts.page_contacts(self.fx_rendered.select("url", "html")), "rendered"),
        )

    @property
    def searched(self) -> DataFrame:
        return contacts.search_contacts(self.sites, self.crawl, self.fx_rendered.select("url", "html"))


def on(fn: Callable[[Tables], DataFrame]) -> Query:
    """Register a query that only needs the overlays."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(fn(Tables(spark, sf_dir)))

    run.__name__ = fn.__name__
    return query(run)


# --- sources and sinks --------------------------------------------------------

@on
def serp_links(t):
    return tables.serp_links(t.fx_serp_html)


@on
def serp_links_rendered(t):
    return tables.serp_links(t.fx_serp_html, rendered=True)


@on
def bulk_ingest(t):
    return tables.bulk_urls(t.fx_url_lists)


@on
def history_decode(t):
    return t.history.select("job_id", "domain", "version", "tiebreak", "platforms", "emails",
                            "phones", "socials", "accepted")


@on
def jobs_decode(t):
    return tables.decode_jobs(t.fx_jobs_raw).select(
        "id", "status", "keywords", "custom_niche", "vertical", "city", "area", "tech_stacks",
        "pages_per_query", "classify_niche", "skip_tech_filter",
    )


@on
def results_export(t):
    return exports.results_table(t.verifications, keys=("job_id",))


@on
def results_export_accepted(t):
    return exports.results_table(t.verifications, accepted_only=True, keys=("job_id",))


@on
def outreach_export(t):
    return exports.outreach_table(t.verifications, keys=("job_id",))


def _running(t) -> DataFrame:
    return t.jobs.where("status = 'running'").select("id")


@query
def job_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows of all running jobs; only their buckets are read."""
    t, path = Tables(spark, sf_dir), work_dir(spark, "detail")
    exports.write_history(t.urls, f"{path}/urls")
    exports.write_history(t.verified(), f"{path}/verifications")
    ids = _running(t)
    wanted = ids.withColumnRenamed("id", "job_id")
    rows = [store.read_jobs(spark, f"{path}/{name}", wanted) for name in ("urls", "verifications")]
    return flat(tables.job_detail(*rows, ids))


@query
def pages_profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored captures, read back whole with their header map, and fingerprinted."""
    path = work_dir(spark, "captured")
    t = Tables(spark, sf_dir)
    headers = F.create_map(F.lit("server"), F.lit("nginx"), F.lit("x-page"), F.col("page_id").cast("string"))
    t.fx_pages.select("page_id", "html", headers.alias("headers")).write.parquet(path)
    hits = tech.fingerprint(tables.captured_pages(spark, path))
    return flat(tech.explode_hits(hits))


@query
def results_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results table written as compressed TSV and read back."""
    path = work_dir(spark, "results-tsv")
    table = exports.results_table(Tables(spark, sf_dir).verifications, keys=("job_id",))
    exports.write_tsv(table, path, compression="gzip")
    return spark.read.schema(table.schema).csv(
        path, header=True, sep="\t", quote='"', escape='"', multiLine=True).fillna("")


@query
def history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification rows of all running jobs from a bucketed history."""
    t, path = Tables(spark, sf_dir), work_dir(spark, "history")
    exports.write_history(t.verified("vertical", "accepted"), path)
    rows = store.read_jobs(spark, path, _running(t).withColumnRenamed("id", "job_id"))
    return flat(rows.select("job_id", "domain", "version", "vertical", "accepted"))


@query
def history_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored history after an upsert, a replayed upsert, a deletion of jobs and an
    upsert of rows that bring some of them back."""
    t, path = Tables(spark, sf_dir), work_dir(spark, "changed")
    rows = t.fx_history.select("job_id", "domain", "version", "tiebreak", "vertical", "accepted")
    exports.write_history(fetchlog.latest_by(rows.where("version <= 3"), ["job_id", "domain"], ["version", "tiebreak"]), path)
    later = rows.where("version between 4 and 5")
    store.merge_history(spark, path, later, "later")
    store.merge_history(spark, path, later.where("domain < 's2'"), "again")
    gone = t.jobs.where("status = 'stopped'").select(F.col("id").alias("job_id"))
    store.delete_history(spark, path, gone, "gone")
    store.merge_history(spark, path, rows.where("version > 5"), "last")
    return flat(spark.read.parquet(path).drop("job_bucket"))


@query
def history_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected hosts inserted into a stored table if absent."""
    t, path = Tables(spark, sf_dir), work_dir(spark, "appended")
    exports.write_history(collect.first_by(t.fx_urls.where("seq <= 3"), ["job_id", "host"], ["seq", "tiebreak"]), path)
    store.append_history(spark, path, t.fx_urls.where("seq > 3"), "new")
    return flat(spark.read.parquet(path).drop("job_bucket"))


# --- query expansion ----------------------------------------------------------

@on
def expand_stack_queries(t):
    return expand.expand_stack_queries(t.fx_campaigns)


@on
def expand_or_queries(t):
    return expand.expand_or_queries(t.fx_campaigns)


@on
def query_pages(t):
    return expand.search_pages(t.fx_campaigns)


# --- cleaning and collection --------------------------------------------------

@on
def clean_urls(t):
    return t.cleaned.select("rank", "url", "host", "reject_reason")


@on
def clean_urls_whole_labels(t):
    return collect.clean_urls(t.fx_links, match="label").select(
        "rank", "url", "host", "reject_reason"
    )


@on
def first_per_host(t):
    return collect.first_per_host(t.cleaned)


@on
def reject_census(t):
    return collect.reject_census(t.cleaned)


@on
def links_topn(t):
    return collect.top_n_links(t.cleaned, 5)


@on
def engine_fallback(t):
    return collect.engine_fallback(t.cleaned).select("job_id", "query_idx", "engine", "rank", "url")


@on
def pages_before_stop(t):
    flagged = collect.flag_pages(t.fx_serp_pages)
    return collect.pages_before_stop(flagged).select("query_id", "page_no", "n_links")


@on
def serp_flags(t):
    return collect.flag_rates(collect.flag_pages(t.fx_serp_pages))


# --- attempt logs -------------------------------------------------------------

def _resolved(t, rule):
    return fetchlog.resolve_fetch(t.fx_fetch_log, rule, keys=("page_id", "url")).select(
        "page_id", "url", "ok", "attempt", "status", "final_url",
        F.md5("body").alias("body_md5"),
    )


@on
def resolve_fetch(t):
    return _resolved(t, "body")


@on
def resolve_fetch_text(t):
    return _resolved(t, "text")


@on
def landing_domains(t):
    done = fetchlog.resolve_fetch(t.fx_fetch_log, keys=("page_id", "url"))
    rows = done.select(
        F.concat(F.lit("job_"), F.col("page_id") % 5).alias("job_id"),
        F.col("page_id").alias("write_order"), "url", "final_url",
    )
    return fetchlog.landing_domains(rows)


@on
def resolve_verdicts(t):
    return fetchlog.resolve_verdicts(t.fx_verdicts)


@on
def failure_classes(t):
    return fetchlog.failure_classes(t.fx_probe_log)


@on
def probe_rollup(t):
    return fetchlog.probe_rollup(t.fx_probe_log)


@on
def probe_quantiles(t):
    """Latency quantiles from stored sketches of three runs, held against exact ranks."""
    log = t.fx_probe_log
    stored = settle(fetchlog.latency_sketches(log.withColumn("run", F.col("event_id") % 3)), "latency-sketches")
    marks = fetchlog.merged_latencies(stored)
    below, upto = F.col("l.elapsed_ms") < F.col("m.elapsed_ms"), F.col("l.elapsed_ms") <= F.col("m.elapsed_ms")
    ranked = log.alias("l").join(marks.alias("m"), "model").groupBy("model", "rank", "n_probes").agg(
        (F.count_if(below) / F.count("*")).alias("low"), (F.count_if(upto) / F.count("*")).alias("high"))
    close = (F.col("low") <= F.col("rank") + 0.033) & (F.col("high") >= F.col("rank") - 0.033)
    return ranked.select("model", "rank", "n_probes", close.alias("rank_close"))


# --- page profiling -----------------------------------------------------------

def _fingerprint(t, **kw):
    return tech.fingerprint(t.fx_pages.select("page_id", "url", "headers_text", "html"), **kw)


def _late(t):
    return tech.fingerprint(t.fx_rendered.select("page_id", "html"), headers=None)


@on
def tech_fingerprint(t):
    return tech.explode_hits(_fingerprint(t, implied=False)).drop("url")


@on
def tech_implied(t):
    return tech.explode_hits(_fingerprint(t)).drop("url")


@on
def tech_merge(t):
    return tech.explode_hits(tech.merge_passes(_fingerprint(t), _late(t))).drop("url")


@on
def rerender_candidates(t):
    return tech.rerender_candidates(_fingerprint(t)).select(
        "page_id", tech.platforms(F.col("hits")).alias("platforms")
    )


@on
def spa_pages(t):
    return tech.spa_pages(t.fx_pages)


@on
def stack_counts(t):
    return tech.stack_counts(_fingerprint(t))


@on
def stack_counts_merged(t):
    """Site counts from stored sketches of four runs, held against exact counts."""
    fp = _fingerprint(t).withColumn("run", F.col("page_id") % 4)
    merged = tech.merged_site_counts(settle(tech.site_sketches(fp), "site-sketches"))
    exact = tech.stack_counts(_fingerprint(t)).select("platform", F.col("n_sites").alias("_exact"))
    close = F.abs(F.col("n_sites") - F.col("_exact")) <= 0.065 * F.col("_exact")
    return merged.join(exact, "platform").select("platform", "n_pages", close.alias("n_sites_close"))


@on
def tech_by_table(t):
    """Stacks by a marker table with an entry per part."""
    return tech.fingerprint_by_table(t.fx_pages, t.fx_markers)


@on
def page_text(t):
    return text.page_text(t.fx_pages).select("page_id", "title", "text", "short")


@on
def url_tokens(t):
    return text.url_tokens(t.pages)


@on
def token_frequency(t):
    return text.token_frequency(text.url_tokens(t.pages))


@on
def page_footers(t):
    return text.page_footers(t.fx_pages.select("page_id", "html"), heuristic=False)


@on
def page_footers_marked(t):
    return text.page_footers(t.fx_pages.select("page_id", "html"))


# --- contacts -----------------------------------------------------------------

@on
def emails(t):
    return contacts.emails(t.fx_pages)


@on
def document_emails(t):
    docs = t.documents.select("doc_id", F.replace("text", F.lit(".example.com"), F.lit(".shop")).alias("html"))
    return contacts.emails(docs, key="doc_id")


@on
def phones(t):
    return contacts.phones(t.fx_pages)


@on
def document_phones(t):
    docs = t.documents.select("doc_id", F.replace("text", F.lit("+1 ("), F.lit("call +1 (")).alias("html"))
    return contacts.phones(docs, key="doc_id")


@on
def socials(t):
    return contacts.socials(t.fx_pages)


@on
def payload_contacts(t):
    return contacts.payload_contacts(t.fx_pages)


@on
def contact_candidates(t):
    return contacts.contact_candidates(t.sites, t.crawl)


@on
def footer_links(t):
    return contacts.footer_links(t.sites, t.crawl)


@on
def staged_contacts(t):
    return t.staged.groupBy("site", "kind", "network", "value").agg(F.min("stage").alias("stage"))


@on
def contact_cascade(t):
    return contacts.contact_cascade(t.searched)


@on
def contacts_row(t):
    return contacts.assemble_contacts(contacts.contact_cascade(t.searched))


# --- labels -------------------------------------------------------------------

def _profiles(t):
    return text.page_text(t.fx_crawl).select("page_id", "url", "title", "text")


@on
def label_requests(t):
    niche = F.when(F.col("page_id") % 2 == 0, "handmade gifts").otherwise("")
    return labels.label_requests(_profiles(t).withColumn("custom_niche", niche))


@on
def parse_labels(t):
    return labels.parse_responses(t.fx_responses).drop("content")


@on
def lexicon_labels(t):
    return labels.label_pages(_profiles(t)).select("page_id", "vertical", "confidence", "reason")


@on
def unknown_sweep(t):
    verdicts = t.urls.select(
        "job_id", F.col("host").alias("domain"),
        F.when(F.col("seq") % 2 == 0, "Retail").otherwise("Unknown").alias("vertical"),
        F.lit(0.5).alias("confidence"), F.lit("second look").alias("reason"),
    )
    return labels.sweep_unknown(t.verified("vertical", "confidence", "reason"), verdicts).select(
        "job_id", "domain", "vertical", "confidence", "reason"
    )


# --- acceptance ---------------------------------------------------------------

@on
def accept(t):
    return acceptance.accept(t.verified("platforms", "vertical"), t.jobs).select("job_id", "domain", "accepted")


@on
def accept_resume(t):
    return acceptance.accept(t.verified("platforms", "vertical"), t.jobs, "resume").select(
        "job_id", "domain", "accepted"
    )


@on
def niche_fallback(t):
    return acceptance.niche_policy(t.verified("vertical"), t.jobs)


@on
def run_summary(t):
    return acceptance.run_summary(t.urls, t.verified("vertical", "accepted"))


# --- job history --------------------------------------------------------------

@on
def append_urls(t):
    known = collect.first_by(t.fx_urls.where("seq <= 3"), ["job_id", "host"], ["seq", "tiebreak"])
    return history.append_urls(known, t.fx_urls.where("seq > 3"))


@on
def upsert_verifications(t):
    rows = t.fx_history
    return history.upsert(rows.where("version <= 3"), rows.where("version > 3"))


@on
def job_status(t):
    return history.apply_status(
        t.jobs.select("id", "created_at", "status", "ended_at"), t.fx_status_changes
    )


@on
def recover_orphans(t):
    live_ids = t.fx_urls.where("seq = 1").select(F.col("job_id").alias("id")).distinct()
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    return history.recover_orphans(t.jobs, live_ids, now).select(
        "id", "status", "ended_at", "recovered"
    )


@on
def list_jobs(t):
    return history.list_jobs(t.jobs, t.urls, t.verified("vertical", "accepted")).select(
        "id", "status", "created_at", "collected", "verified", "matched", "unknown_niche"
    )


@on
def list_jobs_all(t):
    return history.list_jobs(t.jobs, t.urls, t.verified("vertical", "accepted"), limit=None).select(
        "id", "status", "created_at", "collected", "verified", "matched", "unknown_niche"
    )


@on
def previous_run(t):
    return history.previous_run(t.jobs)


@on
def new_hosts(t):
    return history.new_hosts(t.jobs, t.fx_urls)


@on
def run_diff(t):
    return history.run_diff(t.jobs, t.fx_urls)


@on
def remaining_urls(t):
    return history.remaining_urls(t.urls, t.verified("accepted").where("accepted"))


@on
def backfill_set(t):
    return history.backfill_set(t.verified("emails", "phones", "socials")).select("job_id", "domain", "version")


@on
def patch_rows(t):
    updates = t.urls.where("seq % 2 = 0").select(
        "job_id", F.concat(F.lit("https://"), "host", F.lit("/")).alias("url"),
        F.array(F.concat(F.lit("new@"), "host")).alias("emails"),
        F.array().cast("array<string>").alias("phones"),
    )
    return history.patch(t.history, updates, ("emails", "phones")).select(
        "job_id", "domain", "version", "tiebreak", "vertical", "emails", "phones"
    )


@on
def delete_jobs(t):
    ids = t.jobs.where("status = 'stopped'").select("id")
    jobs, urls_left, ver = history.delete_jobs(t.jobs, t.urls, t.verified(), ids)
    parts = [jobs.select(F.lit("jobs").alias("kind"), "id", F.lit("").alias("name")),
             urls_left.select(F.lit("urls").alias("kind"), "job_id", "host"),
             ver.select(F.lit("verifications").alias("kind"), "job_id", "domain")]
    return parts[0].union(parts[1]).union(parts[2])


@on
def schema_upgrade(t):
    rows = t.fx_history.select("job_id", "domain", "version", "tiebreak", "vertical", "emails",
                               "phones", "socials")
    old = rows.where("version <= 3").drop("emails", "phones", "socials")
    return history.upgrade(old, rows.where("version > 3"))


# --- streams ------------------------------------------------------------------

def _lineitem_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(
        sf_dir
    )


def _live_rows(rows: DataFrame) -> DataFrame:
    """The history overlay's columns, derived row by row from a stream of line items."""
    return rows.selectExpr(
        "concat('job_', l_orderkey) as job_id",
        "concat('s', l_suppkey % 20, '.example') as domain",
        "l_linenumber as version",
        "l_partkey * 100000000 + l_suppkey * 10000 + cast(l_quantity * 100 as bigint) as tiebreak",
        "case l_returnflag when 'N' then 'Unknown' when 'A' then 'Jewelry' else 'Fashion' end as vertical",
        "l_linestatus = 'F' as accepted",
    )


@query
def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lineitem_stream(spark, sf_dir).selectExpr(
        "concat('job_', l_orderkey) as job_id", "concat('s', l_suppkey % 20, '.example') as host"
    )
    out = work_dir(spark, "stream-first")
    live.write_rows(live.stream_first(rows), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "stream-upsert")
    rows = _live_rows(_lineitem_stream(spark, sf_dir))
    live.stream_upsert(rows, f"{out}/log", f"{out}/checkpoint").awaitTermination()
    log = spark.read.parquet(f"{out}/log")
    return flat(live.read_latest(log, ("job_id", "domain"), ("version", "tiebreak")))


@query
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_dir(spark, "stream-counts")
    rows = _live_rows(_lineitem_stream(spark, sf_dir))
    live.stream_counts(rows, f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return flat(live.read_latest(spark.read.parquet(f"{out}/log"), ("job_id",), ()))


def _feed(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """Put ``rows`` in a folder of captures and give the folder as a stream."""
    rows.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


@query
def stream_first_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of an earlier run, then three runs of the stream, folded between two of them."""
    out = work_dir(spark, "stream-first-stored")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "concat('job_', l_orderkey) as job_id", "concat('s', l_suppkey % 20, '.example') as host",
        "cast((l_linenumber - 1) % 4 as int) as run")
    live.store_first(rows.where("run = 0"), f"{out}/store")
    schema = live.log_schema(rows)
    for run in (1, 2, 3):
        stream = _feed(spark, rows.where(F.col("run") == run), f"{out}/in")
        live.stream_first_stored(stream, f"{out}/store", f"{out}/checkpoint").awaitTermination()
        if run == 2:
            live.fold_log(spark, f"{out}/store", ("job_id", "host"), schema=schema)
    return flat(live.read_log(spark, f"{out}/store", schema=schema).select("job_id", "host", "run"))


@query
def stream_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert log that is folded between two runs of its stream, then read."""
    out = work_dir(spark, "stream-folded")
    rows = _live_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    for odd in (1, 0):
        stream = _feed(spark, rows.where(F.col("version") % 2 == odd), f"{out}/in")
        live.stream_upsert(stream, f"{out}/log", f"{out}/checkpoint").awaitTermination()
        if odd:
            live.fold_log(spark, f"{out}/log", ("job_id", "domain"), ("version", "tiebreak"))
            live.drop_covered(spark, f"{out}/log")
    log = live.read_log(spark, f"{out}/log")
    return flat(live.read_latest(log, ("job_id", "domain"), ("version", "tiebreak")))


# --- whole runs ---------------------------------------------------------------

def _verdict_columns(ver: DataFrame) -> DataFrame:
    return ver.select("job_id", "requested_host", "domain", "url", "platforms", "vertical",
                      "confidence", "reason", "emails", "phones", "socials", "accepted")


def _rendered(t):
    return t.fx_rendered.select("url", "html")


@on
def run_campaign(t):
    return _verdict_columns(
        runs.run_campaign(t.jobs, t.fx_run_links, t.fx_run_log, rendered=_rendered(t)).verifications
    )


@query
def run_campaign_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A campaign over a log stored by host."""
    t, path = Tables(spark, sf_dir), work_dir(spark, "captures")
    captures.write_captures(t.fx_run_log, path)
    run = runs.run_campaign(t.jobs, t.fx_run_links, captures.Captures(spark, path), rendered=_rendered(t))
    return flat(_verdict_columns(run.verifications))


@on
def run_campaign_asked(t):
    """Every (address, niche) is asked of a service that fails now and then."""
    run = runs.run_campaign(t.jobs, t.fx_run_links, t.fx_run_log, rendered=_rendered(t), service=services.flaky)
    return _verdict_columns(run.verifications)


@on
def run_bulk(t):
    return _verdict_columns(
        runs.run_bulk(t.fx_url_lists, t.jobs, t.fx_run_log, rendered=_rendered(t)).verifications
    )


@on
def run_resume(t):
    collected = collect.first_per_host(collect.clean_urls(t.fx_run_links)).withColumn(
        "write_order", F.struct("query_idx", "page_no", "rank")
    )
    known = collected.where("query_idx = 0").select(
        "job_id", F.col("host").alias("requested_host"), "write_order", "url",
        F.col("host").alias("domain"),
        F.array(F.lit("Wix")).alias("platforms"),
        F.when(F.col("rank") % 2 == 0, "Unknown").otherwise("Fashion").alias("vertical"),
        F.lit(0.25).alias("confidence"), F.lit("").alias("reason"),
        F.when(F.col("rank") % 4 < 2, F.array(F.lit("old@shop.co")))
        .otherwise(F.array().cast("array<string>")).alias("emails"),
        F.array().cast("array<string>").alias("phones"),
        F.create_map().cast(runs.SOCIALS).alias("socials"),
    )
    return _verdict_columns(runs.run_resume(
        t.jobs, collected, known, t.fx_run_log, rendered=_rendered(t)
    ).verifications)


@on
def verify_domains(t):
    rows = runs.verify_domains(t.fx_crawl, t.fx_run_log, rendered=_rendered(t))
    evidence = F.transform("hits", lambda h: F.concat(h["platform"], F.lit("="), F.array_join(
        F.coalesce(h["evidence"], F.array().cast("array<string>")), ",")))
    return rows.withColumn("hits", F.array_sort(evidence))
