"""Streams over several micro-batches: state that goes away, batches whose cost does not grow, counted late rows."""

from __future__ import annotations

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from evidencelake.operators import lexical as L
from evidencelake.streaming import events as K


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def feed(spark, folder, parts, schema):
    """One file for each part, in order."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        newest = max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (1_000_000 + n, 1_000_000 + n))


def states(query):
    """Rows in state after each micro-batch."""
    return [sum(x["numRowsTotal"] for x in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def test_idle_sessions_leave_the_buffers(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp"
    feed(spark, str(tmp_path / "in"), [[(u, u, at(u)) for u in range(20)], [(1, 100, at(50))], [(99, 101, at(10_000))], [(1, 102, at(10_001))]], schema)
    got = []
    query = K.run_to_end(K.live_buffer(K.read_stream(spark, str(tmp_path / "in"), schema), 4, 100, "10 seconds"), "update", str(tmp_path / "cp"), lambda df, n: got.append(sorted(tuple(r) for r in df.collect())))
    rows = states(query)
    assert rows[0] == 20 and rows[-1] == 2, rows
    assert [x for x in got if x] == [[(u, u) for u in range(20)], [(1, 1), (1, 100)], [(99, 101)], [(1, 102)]]  # the session begins anew


def test_finished_and_idle_jobs_leave_the_state(spark, tmp_path):
    schema = "job_id long, event_id long, ts timestamp, status string"
    parts = [[(1, 1, at(0), "queued"), (1, 2, at(1), "cancelled"), (2, 3, at(0), "queued")], [(1, 4, at(5), "queued"), (3, 5, at(1000), "queued")], [(1, 6, at(1001), "queued"), (2, 7, at(1001), "running")], [(4, 8, at(9000), "queued")]]
    feed(spark, str(tmp_path / "in"), parts, schema)
    got = []
    query = K.run_to_end(K.live_transitions(K.read_stream(spark, str(tmp_path / "in"), schema), "10 seconds", 60, 2000), "append", str(tmp_path / "cp"), lambda df, n: got.extend(sorted(tuple(r) for r in df.collect())))
    legal = {r[1]: (r[2], r[4]) for r in got}
    assert legal[4] == ("cancelled", False)  # a finished job is remembered for a while
    assert legal[7] == ("queued", True) and len(legal) == 8
    assert states(query)[-1] == 1


def test_late_rows_are_counted(spark, tmp_path):
    schema = "user_id long, ts timestamp, tokens long"
    day = 86_400
    feed(spark, str(tmp_path / "in"), [[(1, at(0), 5), (2, at(5), 7)], [(1, at(3 * day), 1)], [(1, at(3 * day + 1), 1)], [(1, at(10), 100), (3, at(20), 100), (1, at(3 * day - 60), 2)]], schema)
    watch = K.StreamCounts()
    spark.streams.addListener(watch)
    try:
        query = K.run_to_end(K.live_budget(K.read_stream(spark, str(tmp_path / "in"), schema)), "update", str(tmp_path / "cp"), lambda df, n: df.collect())
        until = time.time() + 20
        while time.time() < until and watch.late[str(query.id)] < 2:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watch)
    assert watch.late[str(query.id)] == 2 and watch.in_state[str(query.id)] == 2


def test_event_numbers_read_only_their_own_buckets(spark, tmp_path):
    write, want, last = K.event_log(str(tmp_path / "log"), 8), set(), {}
    for n in range(9):
        rows = [(u, 100 * n + i, i) for i, u in enumerate([1, 1, 2, 1000 + n])]
        df = spark.createDataFrame(rows, "user_id long, event_id long, ts long")
        for again in range(1 + (n == 4)):
            write(df, n)
        for u, e, _ in rows:
            last[u] = last.get(u, 0) + 1
            want.add((u, e, last[u]))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "log/rows")).select("user_id", "event_id", "seq").collect()]
    assert len(got) == len(want) and set(got) == want
    held = [p for p in (tmp_path / "log/last").glob("b=*/bucket=*")]
    assert len(held) <= 2 * 8  # a bucket's newest version, and the one before it
    assert len(list((tmp_path / "log/current").glob("b=*"))) == 2


def test_ids_seen_are_state_that_can_end(spark, tmp_path):
    schema = "doc_id long, text string, seen timestamp"
    parts = [[(i, "word " * 50, at(i)) for i in range(5)] + [(None, "no id", at(1))], [(3, "again", at(60)), (7, "new", at(100_000))], [(8, "x", at(100_001))], [(3, "much later", at(100_002))]]
    feed(spark, str(tmp_path / "in"), parts, schema)
    for name, more in (("ever", {}), ("while", {"event_time": "seen", "within": "1 hour"})):
        out = str(tmp_path / name)
        query = K.enrich_new_documents(K.read_stream(spark, str(tmp_path / "in"), schema), out, str(tmp_path / f"cp-{name}"), **more)
        query.awaitTermination()
        ids = sorted(r.doc_id for r in spark.read.parquet(out).collect())
        assert ids == ([0, 1, 2, 3, 4, 7, 8] if name == "ever" else [0, 1, 2, 3, 3, 4, 7, 8])
        assert states(query)[-1] == (7 if name == "ever" else 3)
        vectors = spark.read.parquet(f"{out}-embeddings")
        assert vectors.where(F.size("embedding") == 64).count() == len(ids)
    assert spark.read.parquet(str(tmp_path / "ever")).where("doc_id = 3").count() == L.chunk_fixed(spark.createDataFrame([(3, "word " * 50)], "doc_id long, text string")).count()
