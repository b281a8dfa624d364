"""Models in workers, stored tables that change by bucket, observed writes."""

from __future__ import annotations

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import models as M, ranking as R, vectors as V, verify as H
from evidencelake.operators.stored import StoredTable


def test_offline_models():
    assert M.TokenOverlap().score([("Which GRAPH works?", "a graph that works"), ("", "x"), ("abc", "")]) == [2 / 3, 0.0, 0.0]
    assert M.LexicalEntailment().judge([("It improves recall", "it never improves recall here"), ("It improves recall", "improves recall"), ("alpha beta", "not gamma")]) == [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


def test_a_model_is_loaded_once_in_a_process(spark, tmp_path):
    folder = str(tmp_path)

    class Counting:
        def __init__(self):
            open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def score(self, pairs):
            return [None if t == "skip" else float(len(t)) for _, t in pairs]

    rows = spark.createDataFrame([(i, "q", None if i == 0 else "skip" if i == 1 else "x" * i) for i in range(60)], "i int, q string, t string").repartition(12)
    for _ in range(3):
        got = {r.i: r.s for r in rows.select("i", M.model_score(F.col("q"), F.col("t"), Counting).alias("s")).collect()}
        assert got == {i: None if i < 2 else float(i) for i in range(60)}
    loads = [f.split("-")[0] for f in os.listdir(folder)]
    assert loads and len(loads) == len(set(loads)) <= 8


def test_rerank_and_unified_score_through_models(spark):
    hits = spark.createDataFrame([(1, "a", 0.5, "graph retrieval"), (1, "b", 0.4, "neural graph retrieval model"), (1, "c", 0.3, None)], "query_id int, chunk_id string, rrf_score double, text string")
    scores = hits.select("query_id", "chunk_id", M.model_score(F.lit("neural graph retrieval"), F.col("text")).alias("model_score")).where("model_score is not null")
    assert [(r.chunk_id, r.rerank_rank) for r in R.rerank(hits, scores).orderBy("rerank_rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    pairs = spark.createDataFrame([("It reaches 91% accuracy", "accuracy reaches 91% here", 0.8, 0.5), ("It reaches 91% accuracy", "it never reaches accuracy", 0.8, 0.5), (None, "x", 0.0, 0.0)], "c string, s string, lexical double, citation double")
    e = M.entailment(F.col("c"), F.col("s"))
    got = [r[0] for r in pairs.select("*", e.alias("e")).select(H.unified_score(F.col("lexical"), F.col("citation"), F.col("e.entail"), M.numeric_share(F.col("c"), F.col("s")), F.col("e.contradiction"))).collect()]
    assert got == pytest.approx([0.32 + 0.3 + 0.1 + 0.1, 0.32 + 0.3 + 0.1 - 0.3, 0.0])


def at(d):
    return dt.datetime(2024, 1, d)


def test_stored_table(spark, tmp_path):
    schema = "paper_id long, title string, stars int, at timestamp"
    t = StoredTable(spark, str(tmp_path / "t"), "paper_id", schema, 8)
    t.create(spark.createDataFrame([(i, f"t{i}", 0, at(1 + i % 20)) for i in range(200)], schema))
    written = lambda: {os.path.join(root, p): os.stat(os.path.join(root, p)).st_mtime_ns for root, _, files in os.walk(tmp_path) for p in files if p.endswith(".parquet")}
    before = written()
    updates = spark.createDataFrame([(5, "new", None, at(25)), (5, "older", 9, at(24)), (900, "added", 1, at(2)), (7, "stale", 3, at(1)), (None, "no key", 1, at(3))], schema)
    change = {r.change: r.n for r in t.upsert(updates, "at").collect()}
    assert change == {"updated": 1, "inserted": 2}
    rows = {r.paper_id: (r.title, r.stars) for r in t.read().collect()}
    assert len(rows) == 202 and rows[5] == ("new", 0) and rows[900] == ("added", 1) and rows[7] == ("t7", 0) and rows[None] == ("no key", 1)
    after = written()
    assert len(set(before) & set(after)) >= 3  # untouched buckets keep their files
    assert t.upsert(updates, "at").count() == 0 and written() == after  # the same batch again changes nothing
    assert {r.change: r.n for r in t.delete(spark.createDataFrame([(5,), (12345,), (None,)], "paper_id long")).collect()} == {"deleted": 2}
    assert {r.change: r.n for r in t.retain("at", "2024-01-11 00:00:00").collect()} == {"deleted": 100}
    assert t.read().count() == 100 and t.read().where("at < '2024-01-11'").count() == 0
    assert {r.change: r.n for r in t.delete(t.read()).collect()} == {"deleted": 100} and t.read().count() == 0
    assert t.upsert(updates, "at").count() == 1 and t.read().count() == 4


def test_vectors_are_counted_while_they_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [0.5, 0.5])], "vec_id int, embedding array<double>")
    got = V.write_vectors(df, str(tmp_path / "v"), 2)
    assert {r.reason: r.n for r in got.collect()} == {"kept": 2, "no_embedding": 2, "wrong_dimension": 1}
    assert sorted(r.vec_id for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [1, 5]
