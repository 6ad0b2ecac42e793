"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of cores and
``BENCH_QUERIES`` an optional comma list of queries (``all`` for every one).
Each query is planned and run to the end once, writing to a sink that discards
rows.  The first, untimed query starts the session's machinery.
"""

from __future__ import annotations

import json
import os
import sys
import time

from hostweave.session import get_session
from hostweave.testkit.catalog import QUERIES

HEADLINE = [
    "serp_links", "bulk_ingest", "history_decode", "results_export", "outreach_export",
    "expand_stack_queries", "expand_or_queries", "query_pages",
    "clean_urls", "first_per_host", "links_topn", "engine_fallback", "pages_before_stop",
    "serp_flags", "resolve_fetch", "landing_domains", "resolve_verdicts", "failure_classes",
    "tech_fingerprint", "tech_merge", "stack_counts", "page_text", "url_tokens",
    "page_footers_marked", "emails", "document_emails", "phones", "document_phones", "socials",
    "payload_contacts", "footer_links", "contact_cascade", "contacts_row",
    "label_requests", "parse_labels", "lexicon_labels", "unknown_sweep",
    "accept", "niche_fallback", "run_summary",
    "append_urls", "upsert_verifications", "job_status", "list_jobs", "list_jobs_all",
    "previous_run", "run_diff", "remaining_urls", "patch_rows",
    "stream_first", "stream_upsert", "stream_counts", "run_campaign", "run_bulk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["list_jobs"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
