"""Changes of a stored history touch only their buckets and survive a break."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from hostweave.plans import runs
from hostweave.sources import captures, exports, store

KEYS, ORDER = ("job_id", "domain"), ("version",)


def files(path):
    return {p: hashlib.sha256(p.read_bytes()).hexdigest() for p in path.rglob("*.parquet") if "_change" not in str(p)}


def content(spark, path):
    return sorted((r.job_id, r.domain, r.version, r.note) for r in spark.read.parquet(str(path)).collect())


@pytest.fixture
def stored(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "concat('job_', id % 100) as job_id", "concat('s', id) as domain", "1 as version", "'old' as note")
    exports.write_history(rows, str(tmp_path / "h"))
    return tmp_path / "h"


def new_rows(spark, rows):
    return spark.createDataFrame(rows, "job_id string, domain string, version int, note string")


def test_untouched_buckets_stay_byte_equal(spark, stored):
    before, was = files(stored), content(spark, stored)
    change = new_rows(spark, [("job_7", "s7", 2, "new"), ("job_7", "s7", 1, "lost"), ("job_7", "x", 1, "more")])
    store.merge_history(spark, str(stored), change, "a", KEYS, ORDER)
    after = files(stored)
    [bucket] = store.touched_buckets(change)
    other = {p: h for p, h in before.items() if f"job_bucket={bucket}" not in str(p)}
    assert other.items() <= after.items()
    want = sorted([r for r in was if r[:2] != ("job_7", "s7")] + [("job_7", "s7", 2, "new"), ("job_7", "x", 1, "more")])
    assert content(spark, stored) == want
    store.merge_history(spark, str(stored), change, "a", KEYS, ORDER)
    assert content(spark, stored) == want and not list(stored.glob("_change*"))


def test_deleted_jobs_go_and_empty_buckets_with_them(spark, stored):
    was = content(spark, stored)
    ids = new_rows(spark, [("job_1", "", 0, ""), ("nobody", "", 0, "")])
    store.delete_history(spark, str(stored), ids, "d")
    assert content(spark, stored) == [r for r in was if r[0] != "job_1"]
    everyone = spark.createDataFrame([(f"job_{i}",) for i in range(2, 100)], "job_id string")
    store.delete_history(spark, str(stored), everyone, "e")
    assert {r[0] for r in content(spark, stored)} == {"job_0"}
    store.delete_history(spark, str(stored), everyone.where("false"), "f")
    assert len(list(stored.glob("job_bucket=*"))) == 1


def test_a_broken_change_is_made_again(spark, stored, monkeypatch):
    was = content(spark, stored)
    change = new_rows(spark, [("job_3", "s3", 5, "new")])
    with monkeypatch.context() as m:  # breaks off with the staged content complete
        m.setattr(store, "_remove", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.merge_history(spark, str(stored), change, "c", KEYS, ORDER)
    [bucket] = store.touched_buckets(change)
    for p in (stored / f"job_bucket={bucket}").glob("*"):  # as if the last step had only deleted
        p.unlink()
    store.merge_history(spark, str(stored), change, "c", KEYS, ORDER)
    want = sorted([r for r in was if r[:2] != ("job_3", "s3")] + [("job_3", "s3", 5, "new")])
    assert content(spark, stored) == want
    staged = stored / "_change-n" / f"job_bucket={bucket}"
    staged.mkdir(parents=True)  # breaks off before the staged content is complete
    (staged / "part-0.parquet").write_bytes(b"half")
    store.merge_history(spark, str(stored), change, "n", KEYS, ORDER)
    assert content(spark, stored) == want


def test_a_change_moves_staged_files_and_goes_on_after_a_break(spark, stored, monkeypatch):
    was = content(spark, stored)
    change = spark.range(100).selectExpr("concat('job_', id) as job_id", "concat('s', id) as domain", "7 as version", "'new' as note")
    move, moved = store._move, []

    def some(session, path, to):
        if len(moved) == 3:
            raise OSError("gone")
        moved.append((path, to, next(p.name for p in (stored / path).glob("*.parquet"))))
        move(session, path, to)

    with monkeypatch.context() as m:
        m.setattr(store, "_move", some)
        with pytest.raises(OSError):
            store.merge_history(spark, str(stored), change, "m", KEYS, ORDER)
    assert all((stored / to / name).exists() for _, to, name in moved)
    store.merge_history(spark, str(stored), change, "m", KEYS, ORDER)
    want = [r if int(r[1][1:]) >= 100 else (*r[:2], 7, "new") for r in was]
    assert content(spark, stored) == sorted(want) and not list(stored.glob("_change*"))


def test_stored_rows_win_over_appended_ones(spark, stored):
    new = new_rows(spark, [("job_5", "s5", 0, "late"), ("job_5", "y", 2, "b"), ("job_5", "y", 1, "a")])
    store.append_history(spark, str(stored), new, "p", KEYS, ORDER)
    rows = {r[1]: r[3] for r in content(spark, stored) if r[0] == "job_5"}
    assert rows["s5"] == "old" and rows["y"] == "a"


def test_a_job_is_read_from_its_bucket(spark, stored):
    rows = store.read_jobs(spark, str(stored), spark.createDataFrame([("job_7",)], "job_id string"))
    assert rows.count() == 4 and "job_bucket" not in rows.columns
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "job_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert rows.where(F.col("job_id") != "job_7").isEmpty()


LOG = "url string, attempt int, status int, final_url string, headers_text string, body string"


def test_a_run_on_one_site_reads_its_files_only(spark, tmp_path):
    rows = [(f"https://www.s{i}.com/{p}", 1, 200, "", "", f"<p>{i}</p>") for i in range(300) for p in ("", "contact")]
    rows += [("https://old.org/", 1, 200, "https://s7.com/contact-us", "", "<a href='mailto:a@s7.com'>m</a>"),
             ("https://s9.com/moved", 1, 200, "https://s11.com/", "", "x"), (None, 1, 200, "", "", "n"), ("junk", 1, 200, "", "", "j")]
    log = spark.createDataFrame(rows, LOG)
    path = str(tmp_path / "c")
    captures.write_captures(log, path, buckets=64)
    stored = captures.Captures(spark, path, 64)
    assert spark.read.parquet(f"{path}/attempts").count() == len(rows)
    wanted = spark.createDataFrame([("https://s7.com/",), ("https://s9.com/moved",)], "url string")
    names = spark.createDataFrame([("s7.com",), ("old.org",), ("s9.com",), ("s11.com",)], "host string")
    keep = {r.b for r in names.select(captures.job_bucket(F.col("host"), 64).alias("b")).collect()}
    for folder in (tmp_path / "c" / "attempts").glob("host_bucket=*"):
        if int(folder.name.split("=")[1]) not in keep:
            for file in folder.glob("*.parquet"):
                data = file.read_bytes()  # the footer stays: one file tells the schema
                file.write_bytes(data[:4] + b"\xff" * 60 + data[64:])
                (folder / f".{file.name}.crc").unlink(missing_ok=True)
    found = {r.url for r in stored.around(wanted).collect()}
    assert found == {f"https://www.s{i}.com/{p}" for i in (7, 9, 11) for p in ("", "contact")} | {
        "https://old.org/", "https://s9.com/moved"}
    searched = wanted.withColumns({"label": F.lit(True), "search": F.lit(True)})
    work = runs.page_work(searched.withColumn("url", runs.urls.canonical_url(F.col("url"))), stored, None)
    assert {r.url for r in work.facts.collect()} == {r.url for r in runs.page_work(
        searched.withColumn("url", runs.urls.canonical_url(F.col("url"))), log, None).facts.collect()}


def test_captures_of_many_hosts_and_of_none(spark, tmp_path):
    log = spark.range(500).selectExpr("concat('https://s', id % 100, '.com/', id) as url", "1 as attempt", "200 as status",
                                      "'' as final_url", "'' as headers_text", "'b' as body")
    captures.write_captures(log, str(tmp_path / "c"))
    captures.write_captures(log.limit(0), str(tmp_path / "c"), mode="append")
    stored = captures.Captures(spark, str(tmp_path / "c"))
    hosts = spark.range(60).selectExpr("concat('s', id, '.com') as host")
    assert stored.of_hosts(hosts).count() == 300 and stored.of_hosts(hosts.limit(0)).count() == 0
