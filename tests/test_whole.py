"""The queries over all rows leave out no id."""

from __future__ import annotations

import pytest

from evidencelake.operators import joins as C
from evidencelake.plans.catalog import QUERIES
from evidencelake.plans.views import frame
from evidencelake.sources.tables import read_table
from evidencelake.streaming import events as K

SF = "/root/testdata/sf0.001"


def ids(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


@pytest.mark.parametrize("name,column", [("compare_queries_all", "paper_id"), ("paper_graph_doc_all", "paper_id"), ("answer_confidence_all", "answer_id")])
def test_every_paper_and_answer(spark, name, column):
    every = ids(read_table(spark, SF, "orders"), "o_orderkey")
    assert max(every) >= 400 and ids(QUERIES[name](spark, SF), column) == every


def test_every_citation_query_and_line(spark):
    hits = frame(spark, SF, "hits_v")
    queries = ids(hits, "query_id")
    assert {r.legacy_id // 100000 for r in QUERIES["resolve_source_all"](spark, SF).collect()} == queries
    for name in ("forward_citation_hints_all", "backward_citation_hints_all"):
        assert any(q % 10 for q in ids(QUERIES[name](spark, SF), "query_id"))
    band = QUERIES["evolution_band_all"](spark, SF)
    assert any(p % 7 and p >= 40 for p in ids(band, "paper_id")) and any(q % 25 for q in ids(band, "query_id"))
    methods = lambda name: {tuple(r) for r in QUERIES[name](spark, SF).collect()}
    assert methods("same_method_hints_all") == methods("same_method_hints")
    lines = read_table(spark, SF, "lineitem")
    pairs = lines.select("l_orderkey", "l_suppkey").distinct().groupBy("l_orderkey").count().where("count > 1").select("l_orderkey")
    linked = ids(lines.join(pairs, "l_orderkey"), "l_suppkey")
    assert ids(QUERIES["communities"](spark, SF), "node") == linked


def test_short_and_repeated_titles_match(spark):
    jobs = spark.createDataFrame([(1, 1, "Short", "a", 2020), (2, 1, "short ", "a", 2020), (3, 1, "", None, None), (4, 1, "", None, None), (5, 2, "short", "a", 2020)], "job_id long, user_id long, title string, author string, year int")
    papers = spark.createDataFrame([(9, 1, "short", "a", 2020), (8, 1, "short", "a", 2020), (7, 1, "", None, None), (6, 1, "shore", "b", 2000)], "paper_id long, user_id long, title string, author string, year int")
    assert sorted((r.job_id, r.paper_id) for r in C.fuzzy_title_match(jobs, papers).collect()) == [(1, 8), (2, 8), (3, 7), (4, 7)]


def test_documents_of_short_first_lines_match(spark, tmp_path):
    docs = [(i, f"{t}\nbody {i}", "web", "en") for i, t in ((1, "A short title"), (2, "A short title"), (3, "Another"))]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.job_id, r.paper_id) for r in QUERIES["fuzzy_title_match"](spark, str(tmp_path)).collect()] == [(1, 2)]


def test_event_numbers_go_on_and_a_hot_user_has_several_parts(spark, tmp_path):
    rows = [(1 if i % 3 else i % 7, i, (i * 37) % 50 if i % 11 else None) for i in range(3000)] + [(None, 5000, 3), (None, 5001, 1)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = {r["part"]: r["count"] for r in K.spread(df).where("user_id = 1").groupBy("part").count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(parts.values()) < sum(parts.values()) * 0.7
    write, batches = K.event_log(str(tmp_path)), [df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1 and event_id < 5000"), df.where("event_id = 5001")]
    for n in (0, 1, 1, 2):
        write(batches[n], n)
    wanted, last = set(), {}
    for n, keep in enumerate((lambda i: i % 2 == 0, lambda i: i % 2 and i < 5000, lambda i: i == 5001)):
        for user, event, _ in sorted((r for r in rows if keep(r[1])), key=lambda r: (r[2] is None, r[2] or 0, r[1])):
            last[user] = last.get(user, 0) + 1
            wanted.add((user, event, last[user]))
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/rows").select("user_id", "event_id", "seq").collect()]
    assert len(got) == len(rows) and set(got) == wanted
