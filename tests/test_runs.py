"""Whole runs: what jobs ask for, and asking a labelling service."""

from __future__ import annotations

from itertools import product

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostweave.operators import labels, tech
from hostweave.plans import runs

LOG = "url string, attempt int, status int, final_url string, headers_text string, body string"
JOBS = ("id string, tech_stacks array<string>, custom_niche string, vertical string, classify_niche boolean, "
        "extract_contacts boolean, skip_tech_filter boolean")
LINKS = "job_id string, query_idx int, engine string, page_no int, rank int, href string"


def captured(spark, sites):
    home = "<title>Rings</title><p>Fine rings and watches of our own, made by hand in our workshop since 1950.</p>"
    rows = []
    for s in sites:
        rows += [(f"https://{s}.com/", 1, 200, "", "", home),
                 (f"https://{s}.com/contact", 1, 200, "", "", f"<a href='mailto:info@{s}.com'>mail</a>")]
    rows.append(("https://moved.com/", 1, 200, "https://landed.com/", "", home))
    rows.append(("https://landed.com/contact", 1, 200, "", "", "<a href='mailto:info@landed.com'>mail</a>"))
    return spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize("policy", ["campaign", "bulk"])
def test_jobs_get_what_they_ask_for(spark, policy):
    flags = dict(zip("abcd", product([True, False], [True, False]), strict=True))
    jobs = spark.createDataFrame([(j, [], "", "all", c, e, True) for j, (c, e) in flags.items()], JOBS)
    log = captured(spark, flags)
    hosts = {j: [j, "moved"] for j in flags}
    if policy == "campaign":
        links = spark.createDataFrame([(j, 0, "google", 0, k, f"https://{h}.com/")
                                       for j, own in hosts.items() for k, h in enumerate(own)], LINKS)
        run = runs.run_campaign(jobs, links, log)
    else:
        lists = spark.createDataFrame([(k, j, " ".join(f"{h}.com" for h in own))
                                       for k, (j, own) in enumerate(hosts.items())], "list_id int, job_id string, raw string")
        run = runs.run_bulk(lists, jobs, log)
    rows = run.verifications.collect()
    assert len(rows) == 8
    for r in rows:
        classify, extract = flags[r.job_id]
        assert r.vertical == ("Jewelry" if classify else "Unknown")
        assert r.emails == ([f"info@{r.domain}"] if extract else [])


def test_a_run_reads_its_jobs_once(spark, monkeypatch):
    """Of a long job table only the jobs of collected rows are joined to them."""
    few = spark.createDataFrame([("a", [], "", "all", False, True, True), ("a", [], "", "all", False, True, True),
                                 (None, [], "", "all", True, True, True)], JOBS)
    many = spark.range(500).select(F.concat(F.lit("x"), "id").alias("id"), *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema.fields[1:]])
    links = spark.createDataFrame([("a", 0, "google", 0, 0, "https://a.com/"), ("gone", 0, "google", 0, 0, "https://a.com/"),
                                   (None, 0, "google", 0, 0, "https://a.com/")], LINKS)
    sizes, flags = [], runs.acceptance.job_flags
    monkeypatch.setattr(runs.acceptance, "job_flags", lambda jobs: sizes.append(jobs.count()) or flags(jobs))
    rows = runs.run_campaign(few.union(many), links, captured(spark, "a")).verifications.collect()
    assert {(r.job_id, r.vertical, *r.emails) for r in rows} == {
        (None, "Jewelry"), ("a", "Unknown", "info@a.com"), ("gone", "Jewelry")}
    assert set(sizes) == {2}


def test_nothing_is_extracted_unless_a_job_asks(spark):
    wanted = spark.createDataFrame([("https://a.com/", True, False), ("https://b.com/", True, True)],
                                   "url string, label boolean, search boolean")
    wanted = wanted.withColumn("url", runs.urls.canonical_url(F.col("url")))
    log = captured(spark, "abc")
    work = runs.page_work(wanted, log, None)
    facts = {r.url: r for r in work.facts.collect()}
    assert len(facts) == 3
    assert [u for u, r in facts.items() if r.whole] == [u for u in facts if "b.com/contact" in u]
    work = runs.page_work(wanted.withColumn("search", F.lit(False)), log, None)
    assert work.found is None and "whole" not in work.facts.columns and work.facts.count() == 2
    unlabelled = runs.page_work(wanted.withColumn("label", F.lit(False)), log, None)
    assert {r.text for r in unlabelled.facts.collect()} == {""}


def test_resume_asks_again_only_where_a_job_classifies(spark):
    jobs = spark.createDataFrame([("a", [], "rings", "all", True, False, True), ("b", [], "", "all", False, True, True)], JOBS)
    empty = "array<string>"
    done = spark.createDataFrame([(j, f"{j}.com", f"https://{j}.com/", f"{j}.com", "Unknown") for j in "ab"],
                                 "job_id string, requested_host string, url string, domain string, vertical string")
    done = done.withColumns({
        "write_order": F.struct(F.lit(0).alias("query_idx"), F.lit(0).alias("page_no"), F.lit(0).alias("rank")),
        "platforms": F.array(F.lit("Wix")), "confidence": F.lit(0.0), "reason": F.lit(""),
        "emails": F.array().cast(empty), "phones": F.array().cast(empty), "socials": F.create_map().cast(runs.SOCIALS)})
    collected = done.select("job_id", F.col("requested_host").alias("host"), "url", "write_order")

    def service():
        def answer(batch):
            return pd.DataFrame({"content": ['{"vertical": "rings", "confidence": 1}'] * len(batch)})
        return answer

    run = runs.run_resume(jobs, collected, done, captured(spark, "ab"), service=service)
    rows = {r.job_id: r for r in run.verifications.collect()}
    assert rows["a"].vertical == "rings" and rows["a"].emails == [] and rows["a"].accepted
    assert rows["b"].vertical == "Unknown" and rows["b"].emails == ["info@b.com"]


def counting(folder: str):
    """Fails transiently once for b, always for c, for good for d, breaks on e; notes its calls."""
    def service():
        import os
        import uuid

        def answer(batch):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("".join(f"{n}{q}\n" for n, q in zip(batch["n"], batch["request"], strict=True)))
            if "e" in set(batch["request"]):
                raise OSError("network down")
            said = {"a": ('{"vertical": "x"}', None), "c": ("", "timeout"), "d": ("", "model rejection")}
            out = [('{"vertical": "y"}', "") if q == "b" and n == 2 else ("", "429") if q == "b" else said[q]
                   for q, n in zip(batch["request"], batch["n"], strict=True)]
            return pd.DataFrame(out, columns=["content", "error"], index=batch.index + 7)
        return answer
    return service


def test_only_transient_answers_are_asked_again(spark, tmp_path):
    questions = spark.createDataFrame([(q, "", q) for q in "abcd"], "url string, niche string, request string").coalesce(1)
    rows = {r.url: r for r in labels.ask(questions, counting(str(tmp_path))).collect()}
    assert (rows["a"].vertical, rows["b"].vertical, rows["c"].vertical, rows["d"].vertical) == ("x", "y", "Unknown", "Unknown")
    assert (rows["c"].reason, rows["d"].reason) == ("timeout", "model rejection")
    asked = sorted(line for f in tmp_path.iterdir() for line in f.read_text().split())
    assert asked == ["1a", "1b", "1c", "1d", "2b", "2c", "3c"]


def test_an_error_of_the_service_is_an_answer(spark, tmp_path):
    questions = spark.createDataFrame([("e", "", "e")], "url string, niche string, request string")
    row = labels.ask(questions, counting(str(tmp_path))).first()
    assert (row.vertical, row.reason) == ("Unknown", "API error: network down")
    assert len(list(tmp_path.iterdir())) == 3
    assert labels.ask(questions.where("false"), counting(str(tmp_path))).count() == 0


def test_a_page_rendered_twice_is_one_row(spark):
    static = spark.createDataFrame([(1, [])], f"page_id int, hits {tech.HITS_TYPE}")
    late = spark.createDataFrame([(1, [("Wix", ["w"])]), (1, [("Wix", ["w"]), ("React", ["r"])])],
                                 f"page_id int, hits {tech.HITS_TYPE}")
    rows = tech.merge_passes(static, late).collect()
    assert len(rows) == 1 and [h.platform for h in rows[0].hits] == ["Wix", "React"]
