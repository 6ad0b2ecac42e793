from __future__ import annotations

import os
import time

from hostweave.streaming import live


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


SCHEMA = "job_id string, domain string, version int, tiebreak int, vertical string, accepted boolean"


def test_upsert_and_counts_over_batches_and_restarts(spark, tmp_path):
    source = f"{tmp_path}/in"
    batches = [
        [("j", "a", 1, 0, "Unknown", False), ("j", "a", 2, 0, "Rings", True), ("k", "b", 1, 0, "", False)],
        [("j", "a", 3, 0, "Shoes", False), ("j", "c", 1, 0, "Shoes", True)],
    ]
    for rows in batches:
        feed(spark, source, rows, SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        live.stream_upsert(stream, f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination()
        live.stream_counts(stream, f"{tmp_path}/counts", f"{tmp_path}/c2").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log")
    current = live.read_latest(log, ("job_id", "domain"), ("version", "tiebreak"))
    got = {(r.job_id, r.domain): r.vertical for r in current.collect()}
    assert got == {("j", "a"): "Shoes", ("k", "b"): "", ("j", "c"): "Shoes"}
    live.compact(log, f"{tmp_path}/compacted", ("job_id", "domain"), ("version", "tiebreak"))
    assert spark.read.parquet(f"{tmp_path}/compacted").count() == 3
    counts = live.read_latest(spark.read.parquet(f"{tmp_path}/counts"), ("job_id",), ())
    got = {r.job_id: (r.verified, r.matched, r.unknown_niche) for r in counts.collect()}
    assert got == {"j": (4, 2, 1), "k": (1, 0, 1)}


def test_first_seen_survives_a_restart(spark, tmp_path):
    schema = "job_id string, host string"
    for rows in ([("j", "a"), ("j", "a"), ("k", "a")], [("j", "a"), ("j", "b")]):
        feed(spark, f"{tmp_path}/in", rows, schema)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        live.write_rows(live.stream_first(stream), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("j", "a"), ("j", "b"), ("k", "a")]


def test_bounded_first_seen_has_a_watermark(spark, tmp_path):
    schema = "job_id string, host string, found_at timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    bounded = live.stream_first(stream, event_time="found_at", within="1 hour")
    assert bounded.isStreaming
    assert "EventTimeWatermark" in bounded._jdf.queryExecution().logical().toString()


FOUND = "job_id string, host string, run int"


def find(spark, folder, rows, **options):
    feed(spark, f"{folder}/in", rows, FOUND)
    stream = spark.readStream.schema(FOUND).parquet(f"{folder}/in")
    query = live.stream_first_stored(stream, f"{folder}/store", f"{folder}/c", buckets=4, **options)
    query.awaitTermination()
    return query


def found(spark, folder):
    schema = live.log_schema(spark.createDataFrame([], FOUND))
    return sorted(((r.job_id, r.host, r.run) for r in live.read_log(spark, f"{folder}/store", schema=schema).collect()),
                  key=str)


def test_first_seen_against_the_store_with_bounded_state(spark, tmp_path):
    many = [("j", f"h{i}", 1) for i in range(300)]
    live.store_first(spark.createDataFrame([("j", "old", 0), ("j", "old", 0), ("j", None, 0)], FOUND),
                     f"{tmp_path}/store", buckets=4)
    find(spark, tmp_path, [*many, ("j", "old", 1), ("j", None, 1), (None, "x", 1)], within="1 second")
    time.sleep(3)
    find(spark, tmp_path, [("j", "h7", 2), ("j", "new", 2), (None, "x", 2)], within="1 second")
    time.sleep(3)
    last = find(spark, tmp_path, [("j", "h8", 3), ("j", "old", 3), ("j", "new", 3)], within="1 second")
    want = [("j", "old", 0), ("j", None, 0), *many, (None, "x", 1), ("j", "new", 2)]
    assert found(spark, tmp_path) == sorted(want, key=str)
    assert last.lastProgress["stateOperators"][0]["numRowsTotal"] < 50


def test_a_replayed_batch_finds_its_rows_again(spark, tmp_path):
    find(spark, tmp_path, [("j", "a", 1), ("j", "b", 1)])
    find(spark, tmp_path, [("j", "a", 2), ("j", "c", 2)])
    before = found(spark, tmp_path)
    done = sorted((f for f in os.listdir(f"{tmp_path}/c/commits") if f.isdigit()), key=int)
    for name in (done[-1], f".{done[-1]}.crc"):  # the last batch was written but not committed
        if os.path.exists(f"{tmp_path}/c/commits/{name}"):
            os.remove(f"{tmp_path}/c/commits/{name}")
    find(spark, tmp_path, [("j", "d", 3)])
    assert found(spark, tmp_path) == sorted([*before, ("j", "d", 3)], key=str)


def in_state(query):
    return query.lastProgress["stateOperators"][0]["customMetrics"]


def test_stored_first_seen_keeps_its_state_on_disk(spark, tmp_path):
    before = {key: spark.conf.get(key, None) for key in live.DISK_STATE}
    last = find(spark, tmp_path, [("j", "a", 1), ("j", "a", 1), (None, "b", 1), ("j", None, 1)])
    assert any(name.startswith("rocksdb") for name in in_state(last))
    last = find(spark, tmp_path, [("j", "a", 2), (None, "b", 2), ("j", None, 2), ("j", "c", 2)])
    assert last.lastProgress["stateOperators"][0]["numRowsTotal"] == 4
    want = [("j", "a", 1), (None, "b", 1), ("j", None, 1), ("j", "c", 2)]
    assert found(spark, tmp_path) == sorted(want, key=str)
    assert {key: spark.conf.get(key, None) for key in live.DISK_STATE} == before  # the session stays as it was


def test_a_stream_begun_with_state_in_memory_goes_on(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:  # the session's own setting wins
        first = find(spark, tmp_path, [("j", "a", 1), ("j", "b", 1)])
        assert "HDFSBacked" in spark.conf.get(key)
    finally:
        spark.conf.unset(key)
    last = find(spark, tmp_path, [("j", "a", 2), ("j", "c", 2)])
    for query in (first, last):
        assert not any(name.startswith("rocksdb") for name in in_state(query))
    assert found(spark, tmp_path) == [("j", "a", 1), ("j", "b", 1), ("j", "c", 2)]


def test_fold_under_open_readers(spark, tmp_path):
    keys, order, log = ("job_id", "domain"), ("version", "tiebreak"), f"{tmp_path}/log"

    def run(rows):
        feed(spark, f"{tmp_path}/in", rows, SCHEMA)
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        live.stream_upsert(stream, log, f"{tmp_path}/c").awaitTermination()

    def current(df):
        return sorted((r.domain, r.version) for r in live.read_latest(df, keys, order).collect())

    assert live.read_log(spark, log) is None and live.fold_log(spark, log, keys, order) is None
    run([("j", "a", 1, 0, "", False), ("j", "b", 1, 0, "", False)])
    run([("j", "a", 2, 0, "", False)])
    early = live.read_log(spark, log)
    upto = live.fold_log(spark, log, keys, order)
    assert live.read_log(spark, log).count() == 2 and early.count() == 3
    assert current(early) == current(live.read_log(spark, log)) == [("a", 2), ("b", 1)]
    os.remove(f"{log}/_base-{upto}/_SUCCESS")  # a fold that broke off does not count
    assert live.read_log(spark, log).count() == 3
    assert live.fold_log(spark, log, keys, order) == upto
    run([("j", "b", 3, 0, "", True)])
    live.drop_covered(spark, log)
    assert current(live.read_log(spark, log)) == [("a", 2), ("b", 3)]
    assert live.fold_log(spark, log, keys, order) > upto
    live.drop_covered(spark, log)
    assert live.read_log(spark, log).count() == 2
