"""History jobs against plain Python, with a key that holds a third of all rows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from hostweave.operators import acceptance, collect, fetchlog, history, labels
from hostweave.sources import exports, tables

JOB = ("id string, created_at timestamp_ntz, status string, keywords string, custom_niche string, "
       "city string, state string, country string, area string, tech_stacks array<string>")


def make_jobs(n: int, seed: int):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.34
        rows.append((
            f"j{i:05d}", start + dt.timedelta(days=rng.randrange(400)),
            rng.choice(["done", "stopped", "running", "error"]),
            "hot" if hot else f"k{rng.randrange(30)}", rng.choice(["", None]), "c", "", None, "",
            rng.choice([["a", "b"], ["b", "a"]]) if hot else rng.choice([[], None]),
        ))
    return rows


def test_previous_run_equals_a_scan(spark):
    rows = make_jobs(1200, 5)
    jobs = spark.createDataFrame(rows, JOB)
    expected, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (r[3], r[4] or "", r[5], r[6] or "", r[7] or "", r[8], tuple(sorted(r[9] or [])))
        expected[r[0]] = last.get(key)
        if r[2] in ("done", "stopped"):
            last[key] = r[0]
    for parts in (1, 7, 40):
        got = {r.job_id: r.prev_job_id for r in history.previous_run(jobs, parts).collect()}
        assert got == expected


def test_previous_run_spreads_a_hot_key_of_one_day(spark, monkeypatch):
    written = {}

    def seen(df, label):
        written[label] = settle(df, label)
        return written[label]

    settle = history.settle
    monkeypatch.setattr(history, "settle", seen)
    day = dt.datetime(2024, 5, 1)
    columns = "id string, created_at timestamp_ntz, status string, tech_stacks array<string>, " + ", ".join(
        f"{c} string" for c in history.SIMILAR_KEYS)
    same = spark.createDataFrame(
        [(f"j{i:05}", day, "done" if i % 3 == 0 else "running", [], *[""] * 6) for i in range(3000)], columns)
    found = history.previous_run(same, 20)
    got = {r.job_id: r.prev_job_id for r in found.collect()}
    assert got == {f"j{i:05}": f"j{(i - 1) // 3 * 3:05}" if i else None for i in range(3000)}
    sizes = [r["count"] for r in written["job-ranges"].groupBy("_span").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_latency_sketches_keep_ranks_of_a_hot_model(spark):
    log = spark.range(200_000).selectExpr("id % 5 as run", "if(id % 50 = 0, 'cold', 'hot') as model",
                                          "pmod(hash(id), 100003) as elapsed_ms")
    log = log.unionByName(spark.createDataFrame([(9, "hot", None)], "run long, model string, elapsed_ms int"))
    marks = fetchlog.merged_latencies(fetchlog.latency_sketches(log)).collect()
    assert len(marks) == 6
    for r in marks:
        below = log.where((F.col("model") == r.model) & (F.col("elapsed_ms") <= r.elapsed_ms)).count()
        assert abs(below / r.n_probes - r["rank"]) <= 0.033


def test_upsert_is_last_wins_and_repeatable(spark):
    rows = [("j", f"d{i % 5}", i, 0, f"v{i}") for i in range(20)]
    schema = "job_id string, domain string, version int, tiebreak int, vertical string"
    base = spark.createDataFrame(rows[:10], schema)
    new = spark.createDataFrame(rows[10:], schema)
    once = history.upsert(base, new)
    twice = history.upsert(once, new)
    expected = {f"d{i}": f"v{15 + i}" for i in range(5)}
    assert {r.domain: r.vertical for r in once.collect()} == expected
    assert {r.domain: r.vertical for r in twice.collect()} == expected


def test_append_keeps_known_rows(spark):
    schema = "job_id string, host string, seq int, tiebreak int"
    base = spark.createDataFrame([("j", "a", 9, 9)], schema)
    new = spark.createDataFrame([("j", "a", 1, 1), ("j", "b", 3, 0), ("j", "b", 2, 0)], schema)
    got = sorted(tuple(r) for r in history.append_urls(base, new).collect())
    assert got == [("j", "a", 9, 9), ("j", "b", 2, 0)]


def test_status_replay(spark):
    day = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame(
        [("a", day, "running", None), ("b", day, "done", day), ("c", day, "done", day)],
        "id string, created_at timestamp_ntz, status string, ended_at timestamp_ntz")
    later = day + dt.timedelta(1)
    changes = spark.createDataFrame([
        ("a", 1, later, "done", True, False), ("b", 1, later, "running", False, True),
        ("x", 1, later, "done", True, False), ("y", 1, later, "running", False, True),
        ("y", 2, later, "stopped", True, False),
    ], "id string, seq long, changed_at timestamp_ntz, status string, ended boolean, replaced boolean")
    got = {r.id: (r.created_at, r.status, r.ended_at) for r in
           history.apply_status(jobs, changes).collect()}
    assert got == {"a": (day, "done", later), "b": (later, "running", None),
                   "c": (day, "done", day), "y": (later, "stopped", later)}


def test_patch_touches_the_first_row_and_keeps_other_columns(spark):
    schema = "job_id string, url string, version int, tiebreak int, vertical string, emails array<string>"
    ver = spark.createDataFrame(
        [("j", "u", 2, 0, "A", ["x"]), ("j", "u", 1, 0, "B", ["y"]), ("j", "v", 1, 0, "C", ["z"])],
        schema)
    updates = spark.createDataFrame([("j", "u", "New")], "job_id string, url string, vertical string")
    got = {(r.url, r.version): (r.vertical, r.emails) for r in
           history.patch(ver, updates, ("vertical",)).collect()}
    assert got == {("u", 2): ("A", ["x"]), ("u", 1): ("New", ["y"]), ("v", 1): ("C", ["z"])}


def test_list_jobs_filters_facts_before_counting(spark, sf_dir):
    from hostweave.testkit.catalog import Tables
    t = Tables(spark, sf_dir)
    df = history.list_jobs(t.jobs, t.urls, t.verified("vertical", "accepted"), limit=5)
    assert df.count() == 5
    plan = df._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "LeftSemi" in plan


def test_acceptance_rules(spark):
    jobs = spark.createDataFrame([
        ("none", [], "", "all", True, False), ("skip", [], "", "all", True, True),
        ("stack", ["Wix"], "", "all", True, False), ("niche", [], " Rings ", "all", True, False),
        ("fallback", [], "rings", "all", True, False), ("off", [], "rings", "all", False, False),
    ], "id string, tech_stacks array<string>, custom_niche string, vertical string, "
       "classify_niche boolean, skip_tech_filter boolean")
    ver = spark.createDataFrame([
        ("none", "a", [], "Unknown"), ("none", "b", ["Wix"], "Unknown"), ("skip", "a", [], "Unknown"),
        ("stack", "a", ["Shopify"], ""), ("stack", "b", ["Wix", "React"], ""),
        ("niche", "a", ["Wix"], "rINGS "), ("niche", "b", ["Wix"], "Other"),
        ("fallback", "a", ["Wix"], "Unknown"), ("off", "a", ["Wix"], "Other"),
    ], "job_id string, domain string, platforms array<string>, vertical string")

    def run(policy):
        return {(r.job_id, r.domain): r.accepted for r in
                acceptance.accept(ver, jobs, policy).collect()}

    got = run("run")
    assert len(got) == ver.count()
    assert {k for k, v in got.items() if v} == {
        ("none", "b"), ("skip", "a"), ("stack", "b"), ("niche", "a"), ("fallback", "a"), ("off", "a")}
    assert {k for k, v in run("resume").items() if v} == {
        ("none", "b"), ("stack", "b"), ("niche", "a"), ("off", "a")}


def test_verdict_and_response_rules(spark):
    attempts = spark.createDataFrame([
        (1, 1, "Unknown", "429"), (1, 2, "Unknown", "429"), (1, 3, "Jewelry", ""),
        (2, 1, "Unknown", "model rejection"), (2, 2, "Jewelry", ""),
        (3, 1, "Unknown", "timeout"), (3, 2, "", "rate"), (3, 3, "Unknown", "5xx"), (3, 4, "Retail", ""),
    ], "doc_id int, n int, vertical string, reason string")
    whole = {r.doc_id: (r.n, r.vertical) for r in fetchlog.resolve_verdicts(attempts).collect()}
    assert whole[3] == (4, "Retail")
    got = {r.doc_id: (r.n, r.vertical) for r in fetchlog.resolve_verdicts(attempts, limit=3).collect()}
    assert got == {1: (3, "Jewelry"), 2: (1, "Unknown"), 3: (3, "Unknown")}
    responses = {
        '<think>{"vertical":"Other"}</think>{"vertical":"Jewelry","confidence":0.9}': ("Jewelry", 0.9),
        '{"confidence":0.4}': ("Other", 0.4), "no json here": ("Other", 0.0), "": ("Unknown", 0.0),
        "{'vertical':'Single'}": ("Other", 0.0), '{"vertical":"A","confidence":"high"}': ("Other", 0.0),
    }
    df = spark.createDataFrame([(r,) for r in responses], "content string")
    parsed = {r.content: (r.vertical, r.confidence) for r in labels.parse_responses(df).collect()}
    assert parsed == responses


def test_custom_scorer(spark):
    pages = spark.createDataFrame([("https://a.com/", "t", "rings"), ("https://b.com/", "t", "x")],
                                  "url string, title string, text string")

    def scorer(pdf):
        hit = pdf["text"] == "rings"
        return pdf.assign(vertical=hit.map({True: "R", False: "Other"}), confidence=1.0, reason="u")

    got = {r.url: r.vertical for r in labels.label_pages(pages, scorer).collect()}
    assert got == {"https://a.com/": "R", "https://b.com/": "Other"}


def test_exports_round_trip(spark, tmp_path):
    ver = spark.createDataFrame(
        [("j", "a.com", "https://a.com/", ["Wix", "React"], "Rings", 0.5, True,
          'say "hi",\tthen' + "x" * 400, ["e@a.co", "f@a.co"], [], {"tiktok": ["t1", "t2"]})],
        "job_id string, domain string, url string, platforms array<string>, vertical string, "
        "confidence double, accepted boolean, reason string, emails array<string>, "
        "phones array<string>, socials map<string,array<string>>")
    exports.write_csv(exports.results_table(ver), f"{tmp_path}/csv")
    exports.write_tsv(exports.outreach_table(ver, accepted_only=True), f"{tmp_path}/tsv")
    row = spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').collect()[0]
    assert (row.tech_stack, row.accepted) == ("Wix|React", "yes")
    assert row.reason.startswith('say "hi",\tthen') and len(row.reason) == len('say "hi",\tthen') + 400
    row = spark.read.csv(f"{tmp_path}/tsv", header=True, sep="\t", escape='"').collect()[0]
    assert (row.emails, row.tiktok, row.instagram) == ("e@a.co; f@a.co", "t1; t2", None)
    assert len(row) == 15
    exports.write_history(ver, f"{tmp_path}/history", buckets=4)
    back = spark.read.parquet(f"{tmp_path}/history").drop("job_bucket")
    assert back.select(ver.columns).collect() == ver.collect()


def test_compressed_tables_read_back_the_same(spark, tmp_path):
    rows = [("a.com", 'say "hi",\tthen\nmore', ""), ("b.com", "x" * 5000, " y ")]
    table = spark.createDataFrame(rows, "domain string, reason string, niche string")
    exports.write_tsv(table, f"{tmp_path}/tsv", compression="gzip")
    back = spark.read.schema(table.schema).csv(
        f"{tmp_path}/tsv", header=True, sep="\t", quote='"', escape='"', multiLine=True).fillna("")
    assert sorted(back.collect()) == sorted(table.collect())
    assert sum(p.stat().st_size for p in tmp_path.glob("tsv/part-*.csv.gz")) < 1000


def test_first_and_last_rows_carry_their_values_once(spark):
    rows = [("j", 1, 5, "a", ["x"]), ("j", 2, 4, None, None), ("j", 2, 4, "b", ["y"]), (None, 1, 1, "c", [])]
    df = spark.createDataFrame(rows, "job_id string, version int, tiebreak int, note string, tags array<string>")
    last = fetchlog.latest_by(df, ["job_id"], ["version", "tiebreak"])
    first = collect.first_by(df, ["job_id"], ["version", "tiebreak"])
    assert {r.job_id: r.version for r in last.collect()} == {"j": 2, None: 1}
    assert {r.job_id: (r.note, r.tags) for r in first.collect()} == {"j": ("a", ["x"]), None: ("c", [])}
    plan = "".join(d._jdf.queryExecution().optimizedPlan().toString() for d in (last, first))
    assert "_by(" not in plan
    mapped = df.withColumn("m", F.create_map(F.lit("k"), F.col("note")))
    assert fetchlog.latest_by(mapped, ["job_id"], ["version", "tiebreak"]).drop("m").collect() == last.collect()


def test_old_history_is_upgraded(spark):
    old = spark.createDataFrame([("j", 1)], "job_id string, version int")
    new = spark.createDataFrame([("j", 2, "e")], "job_id string, version int, emails string")
    got = sorted(tuple(r) for r in history.upgrade(old, new).collect())
    assert got == [("j", 1, ""), ("j", 2, "e")]


def test_stored_text_is_decoded(spark):
    raw = spark.createDataFrame(
        [("a,,b", "", '{"x": ["1"]}', 1), (None, "e", '{"x": ["cut', 0), ("", None, None, None)],
        "platforms string, emails string, socials string, accepted int")
    got = [tuple(r) for r in tables.decode_verifications(raw).collect()]
    assert got == [(["a", "b"], [], {"x": ["1"]}, True), ([], ["e"], {}, False), ([], [], {}, False)]


def test_pages_before_stop(spark):
    serp = spark.createDataFrame(
        [(1, 0, False, False, 5), (1, 1, False, True, 5), (1, 2, False, False, 5),
         (2, 0, False, False, 0), (3, 0, False, False, 1), (3, 1, False, False, 1)],
        "query_id int, page_no int, captcha boolean, no_results boolean, n_links int")
    got = sorted((r.query_id, r.page_no) for r in collect.pages_before_stop(serp).collect())
    assert got == [(1, 0), (3, 0), (3, 1)]


def test_fetch_resolution_keeps_failed_addresses(spark):
    log = spark.createDataFrame(
        [("a", 1, 403, "x", "b1"), ("a", 2, 200, "x", ""), ("a", 3, 200, "y", "b3"),
         ("b", 1, 500, "z", "c")],
        "url string, attempt int, status int, final_url string, body string")
    got = {r.url: (r.ok, r.attempt, r.final_url, r.body) for r in
           fetchlog.resolve_fetch(log).collect()}
    assert got == {"a": (True, 3, "y", "b3"), "b": (False, None, "", "")}
    landed = fetchlog.landing_domains(
        spark.createDataFrame([("j", 1, "u", "https://www.wix.com/"), ("j", 2, "v", "http://wix.com/x")],
                              "job_id string, write_order int, url string, final_url string"))
    assert [(r.domain, r.url) for r in landed.collect()] == [("wix.com", "v")]


def test_hot_job_gives_same_counts_in_any_layout(spark):
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("j"), F.col("id") % 40)).alias("job_id"),
        F.col("id").cast("string").alias("domain"), F.lit("Unknown").alias("vertical"),
        (F.col("id") % 2 == 0).alias("accepted"))
    urls = rows.select("job_id", F.col("domain").alias("host"))
    results = [
        sorted(tuple(r) for r in acceptance.run_summary(urls, rows.repartition(n)).collect())
        for n in (1, 7)
    ]
    assert results[0] == results[1]
    assert ("hot", 3000, 3000, 1500, 1500, 0, 3000) in results[0]


# --- rows that joins must neither lose nor multiply -----------------------------

def test_rows_of_unknown_jobs_stay_and_are_decided(spark):
    ver = spark.createDataFrame([("a", "x.com", ["Wix"], "Jewelry"), ("ghost", "y.com", ["Wix"], "Unknown"),
                                 ("ghost", "z.com", [], "Unknown")],
                                "job_id string, domain string, platforms array<string>, vertical string")
    jobs = spark.createDataFrame([("a", ["Shopify"], "", "all", True, False)],
                                 "id string, tech_stacks array<string>, custom_niche string, vertical string, "
                                 "classify_niche boolean, skip_tech_filter boolean")
    for policy in ("run", "resume"):
        got = {r.domain: r.accepted for r in acceptance.accept(ver, jobs, policy).collect()}
        assert got == {"x.com": False, "y.com": True, "z.com": False}


def test_duplicate_live_ids_verdicts_and_null_times(spark):
    jobs = spark.createDataFrame([("a", "running", None), ("b", "running", None)],
                                 "id string, status string, ended_at timestamp_ntz")
    live = spark.createDataFrame([("a",), ("a",)], "id string")
    assert history.recover_orphans(jobs, live, F.lit(None).cast("timestamp_ntz")).count() == 2
    ver = spark.createDataFrame([("a", "x.com", "Unknown", 0.0, "")],
                                "job_id string, domain string, vertical string, confidence double, reason string")
    verdicts = spark.createDataFrame([("a", "x.com", "Old", 0.5, "r", 1), ("a", "x.com", "New", 0.4, "r", 2)],
                                     "job_id string, domain string, vertical string, confidence double, reason string, n int")
    swept = labels.sweep_unknown(ver, verdicts, order=("n",)).collect()
    assert [r.vertical for r in swept] == ["New"]
    columns = "id string, created_at timestamp_ntz, status string, tech_stacks array<string>, " + ", ".join(
        f"{c} string" for c in history.SIMILAR_KEYS)
    same = spark.createDataFrame([("n1", None, "done", [], *[""] * 6), ("n2", None, "done", [], *[""] * 6)], columns)
    assert sorted(tuple(r) for r in history.previous_run(same).collect()) == [("n1", None), ("n2", None)]


def test_first_rows_carry_maps_and_upgrades_keep_nulls(spark):
    rows = spark.createDataFrame([(1, 2, {"a": "b"}), (1, 1, {"c": "d"})], "k int, o int, m map<string,string>")
    assert collect.first_by(rows, ["k"], ["o"]).first().m == {"c": "d"}
    old = spark.createDataFrame([(1,)], "k int")
    new = spark.createDataFrame([(2, None)], "k int, t string")
    assert {r.k: r.t for r in history.upgrade(old, new).collect()} == {1: "", 2: None}


def test_history_lookup_lists_only_its_buckets(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('job_', id) as job_id", "id as n")
    exports.write_history(rows, str(tmp_path / "h"))
    found = exports.read_history(spark, str(tmp_path / "h"), ["job_7"])
    assert [r.n for r in found.collect()] == [7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "job_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_runs_read_only_wanted_hosts(spark):
    from hostweave.plans import runs
    log = spark.createDataFrame(
        [(f"https://s{i}.com/", 1, 200, "", "", "<p>body</p>") for i in range(50)],
        "url string, attempt int, status int, final_url string, headers_text string, body string")
    wanted = spark.createDataFrame([("https://s3.com/",)], "url string")
    pages = runs.resolved_pages(log, wanted, runs.site_hosts(log, wanted))
    assert [r.url for r in pages.collect()] == ["https://s3.com/"]


def test_contacts_of_a_landing_host_are_found(spark):
    from hostweave.plans import runs

    def row(url, landed, body):
        return (url, 1, 200, landed, "", body)

    log = spark.createDataFrame([
        row("https://a.com/", "https://b.com/", "<p>home</p>"),
        row("https://b.com/contact", "", "<a href='mailto:hi@b.com'>m</a>"),
        row("https://c.com/", "https://b.com/", "<a href='mailto:other@b.com'>m</a>"),
        row("https://x.com/contact", "", "<a href='mailto:no@x.com'>m</a>"),
    ], "url string, attempt int, status int, final_url string, headers_text string, body string")
    wanted = spark.createDataFrame([("https://a.com/",)], "url string").select(
        runs.urls.canonical_url(runs.F.col("url")).alias("url"), runs.F.lit(True).alias("label"), runs.F.lit(True).alias("search"))
    rendered = spark.createDataFrame([("https://b.com/", "<p>late</p>"), ("https://x.com/", "<p>x</p>")],
                                     "url string, html string")
    seen = {r.url for r in runs.resolved_pages(log, wanted, runs.site_hosts(log, wanted)).collect()}
    assert len(seen) == 3 and not any("x.com" in u for u in seen)
    work = runs.page_work(wanted, log, rendered)
    assert work.late.count() == 0  # only stacks of wanted addresses
    assert runs.rendered_contacts(rendered, runs.site_hosts(log, wanted)).count() == 1
    assert "other@b.com" in work.found.first().emails
    without = log.where("url <> 'https://c.com/'")
    assert runs.page_work(wanted, without, None).found.first().emails == ["hi@b.com"]
