"""Findings of round 3, each with a case that its query got wrong or did group by group before."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import chunking as G, graph as J, joins as C, reports as R
from evidencelake.plans import retrieval
from evidencelake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rounding_of_halves_as_in_sql(spark):
    values = [0.585625, 0.123455, 0.5, -0.585625, 2.675, 1.0000005, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.rounded(F.col("v"), 5).alias("r"))
    assert [r.r for r in df.collect()] == [duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchone()[0] for v in values]
    assert df.where("v = 0.585625").first().r == 0.58562


def test_chunks_hold_questions_across_lines_and_inside_words(spark):
    q = spark.createDataFrame([(1, "alpha beta gamma\ndelta eps zeta eta theta"), (2, "lph"), (3, "two words"), (4, "a b c d e"), (5, None)], "query_id int, question string")
    c = spark.createDataFrame([("x", "so alpha beta gamma\ndelta eps zeta eta theta."), ("y", "(two words) xa b c d ey"), ("z", "a b c  d e")], "chunk_id string, content string")
    assert sorted((r.query_id, r.chunk_id) for r in retrieval.passages(q, c).collect()) == [(1, "x"), (2, "x"), (3, "y"), (4, "y")]


def test_papers_are_folded_without_a_group_each(spark):
    items = spark.createDataFrame([(p, n, 1, "", f"word{n} of paper {p}") for p in [None, *range(9000)] for n in range(2)], "paper_id long, pos long, page_num int, section string, text string")
    packed, semantic = G.fold_chunks(items.select("paper_id", "pos", "text"), 500), G.chunk_semantic(items)
    for df in (packed, semantic):
        assert "MapInArrow" in plan(df) and "FlatMapGroups" not in plan(df)
        assert {(r.paper_id, r.chunk_no, r.text) for r in df.collect()} == {(p, 0, f"word0 of paper {p}\n\nword1 of paper {p}") for p in [None, *range(9000)]}


def test_sections_are_cut_into_several_windows(spark):
    assert QUERIES["chunk_by_section"](spark, SF).where("chunk_no > 1").count() > 0
    text = "".join(chr(97 + i % 26) for i in range(3000))
    cuts = [0, 1, 7, 700, 701, 1400, 3000]
    rows = [(1, n, text[a:b], "results") for n, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(1, 6, "", "results"), (2, 0, "", "other"), (3, 0, None, "other")]
    whole = "\n".join(r[2] for r in rows[:7])
    got = {(r.chunk_no, r.start): r.content for r in G.chunk_by_section(spark.createDataFrame(rows, "paper_id int, pos int, text string, section string")).collect()}
    assert got == {(n, s): whole[s : s + 650].strip(" ") for n, s in enumerate(range(0, len(whole) - 100, 550))}


def test_hints_take_no_more_of_a_list_than_can_matter(spark):
    edges = [(s, d) for s in range(200) for d in (s * 7 % 40, s * 3 % 40, s % 5) if s != d] + [(None, 3), (4, None)]
    hits = [(q, (q * 11 + i * i) % 40) for q in range(30) for i in range(1 + q % 7)]
    e, h = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(hits, "query_id long, paper_id long")
    one = {(s, d) for s, d in edges}
    for forward in (True, False):
        df = C.citation_hints(h, e, forward, 3)
        assert "room" in plan(df)
        got, want = {}, {}
        for r in df.collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.cited_by, r.paper_id))
        for q in range(30):
            own = {p for x, p in hits if x == q}
            near = {s if forward else d for s, d in one if (d if forward else s) in own} - own - {None}
            every = sorted((-sum(d == p for _, d in one), p) for p in near)[:3]
            if every:
                want[q] = [(n, -c, p) for n, (c, p) in enumerate(every, 1)]
        assert {q: sorted(x for x in v if x[2] is not None) for q, v in got.items()} == want


def test_queries_that_ask_the_same_share_their_candidates(spark):
    q = spark.createDataFrame([(i, "compare" if i % 2 else "numeric", i % 3) for i in range(60)] + [(1, "numeric", 2), (1, "compare", 1), (61, "fact", 1), (62, "compare", None)], "query_id long, family string, subject long")
    rel = [(p, p % 4 % 3, "improves_metric_on_dataset" if p % 5 < 3 else "compares_against_baseline") for p in [*range(40), *range(9)]]
    df = J.graph_candidates(q, spark.createDataFrame(rel, "paper_id long, subject long, predicate string"), 4)
    assert "asks" in plan(df)
    got, want = {}, {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.paper_id, r.relations, list(r.predicates)))
    for i in range(60):
        asks = [("compare" if i % 2 else "numeric", i % 3)] + ([("numeric", 2), ("compare", 1)] if i == 1 else [])
        found = {}
        for family, subject in asks:
            for p, s, x in rel:
                if s == subject and x in J.FAMILY_RELATIONS[family]:
                    found.setdefault(p, []).append(x)
        best = sorted(found.items(), key=lambda kv: (-len(kv[1]), kv[0]))[:4]
        want[i] = [(n, p, len(x), sorted(set(x))) for n, (p, x) in enumerate(best, 1)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_papers_of_equal_methods_are_compared_once(spark):
    rows = [(p, m) for p in range(60) for m in range(8) if (p % 4 + 1) * m % 5 < 3] + [(70, 0), (70, None), (71, None), (3, 0)]
    df = C.same_method_hints(spark.createDataFrame(rows, "paper_id long, method long"), 0.4)
    assert "methods" in plan(df)
    sets = {}
    for p, m in rows:
        sets.setdefault(p, set()).update(() if m is None else (m,))
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {(r.paper_id, r.other_id): r.similarity for r in df.collect()} == pytest.approx({k: v for k, v in want.items() if v >= 0.4})


def test_evolution_band_is_whole(spark):
    papers = [(i, 2000 + i * 7 % 12, [f"k{i % 9}", f"k{i % 4}"] if i % 10 else None, i % 3) for i in range(120)] + [(200, None, ["k1"], 0)]
    hits = [(q, (q * 13 + i * 5) % 121 if q else 5) for q in range(15) for i in range(1 + q % 3)]
    by, want = {p[0]: p for p in papers}, set()
    for q in range(15):
        own = {p for x, p in hits if x == q}
        known = [by[p] for p in own if p in by]
        if known:
            years, mine = [p[1] for p in known], {w for p in known for w in p[2] or ()}
            for p, y, ws, _ in papers:
                ws = set(ws or ())
                if p not in own and y and min(years) - 2 <= y <= max(years) + 2 and (abs(y - max(years)) <= 1 or mine | ws and len(mine & ws) / len(mine | ws) >= 0.05):
                    want.add((q, p, y))
    df = C.evolution_band_all(spark.createDataFrame(hits, "query_id int, paper_id int"), spark.createDataFrame(papers, "paper_id int, pub_year int, keywords array<string>, citations int"), 2)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    band = QUERIES["evolution_band"](spark, SF)
    assert band.groupBy("query_id").count().where("count > 5").limit(1).count() == 1 and band.columns == ["query_id", "paper_id", "pub_year"]


def test_full_starts_go_no_further(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, 1000 + i) for i in range(1, 300)] + [(500, 0), (500, 1)]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    starts = spark.createDataFrame([(0,), (500,), (1001,)], "node long")
    got = {}
    for r in J.nearest(both, starts, 2, 4, spark.createDataFrame([(7, 2.0), (0, 1.0)], "node long, score double")).collect():
        got.setdefault(r.start, []).append((r["rank"], r.node, r.distance))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(1, 7, 1), (2, 1, 1), (3, 2, 1), (4, 3, 1)], 500: [(1, 0, 1), (2, 1, 1), (3, 7, 2), (4, 2, 2)], 1001: [(1, 1, 1), (2, 0, 2), (3, 500, 2)]}


def test_vectors_meet_within_their_scope_in_blocks(spark):
    rng = np.random.default_rng(5)
    vec = [(i, i % 3, rng.normal(size=6).round(2).tolist()) for i in range(150)] + [(200 + i, 1, [1.0] * 6) for i in range(40)] + [(300, 1, None), (301, 1, [0.0] * 6), (302, 2, [1.0, 2.0]), (303, None, [1.0] * 6)]
    q = [(i, i % 3, rng.normal(size=6).round(2).tolist()) for i in range(30)] + [(31, 1, [1.0] * 6), (32, 1, None), (33, 2, [2.0, 4.0])]
    both = lambda rows, key: spark.createDataFrame(rows, f"{key} long, user_id long, embedding array<double>")
    df = R.memory_search(both(q, "query_id"), both(vec, "memory_id").withColumn("memory", F.lit("m")), 4)
    assert "MapInPandas" in plan(df)
    cos = lambda a, b: 0.0 if not a or not b or len(a) != len(b) or not any(a) or not any(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.memory_id))
    want = {i: [(n, m) for n, (_, m) in enumerate(sorted((-round(cos(e, x), 12) + 0.0, m) for m, v, x in vec if v == u)[:4], 1)] for i, u, e in q}
    assert {i: sorted(v) for i, v in got.items()} == want
