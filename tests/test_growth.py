"""Findings on growth: results as before, and a plan that no longer does what grew."""

from __future__ import annotations

from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa
import pytest

from evidencelake.functions import text as T
from evidencelake.operators import claim_scores as S, compare as M, graph as J, joins as C, vectors as V, verify as H
from evidencelake.plans import views
from evidencelake.plans.catalog import QUERIES
from tests.test_operators import plain_neighbours

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_chunks_are_read_once(spark):
    texts = ["We train a model with an adapter. It improves accuracy by 12% on the task.", "Nothing here", None, "The answers give better responses than bard: 42% of cases."]
    rows = [(p, p * 10 + i, s, t) for p in range(30) for i, (t, s) in enumerate(zip(texts, ("2 Method", "other", None, "4 Results")))]
    df = M.dimension_scores(spark.createDataFrame(rows, "paper_id long, chunk_id long, section string, content string"))
    assert "RLIKE" not in plan(df) and "regexp" not in plan(df)  # sentences were scored before chunks are joined
    found = {}
    for r in df.collect():
        found.setdefault(r.chunk_id, set()).add((r.dimension, r.snippet, round(r.score, 6)))
    assert all(found[p * 10 + i] == found[i] for p in range(30) for i in (0, 3)) and len(found) == 60
    assert ("method", "We train a model with an adapter.") in {x[:2] for x in found[0]}
    assert ("results", "The answers give better responses than bard: 42% of cases.") in {x[:2] for x in found[3]}


@pytest.mark.parametrize("name", ["hits_v", "chunks_v"])
def test_large_views_are_dealt_by_their_rows(spark, monkeypatch, name):
    before = views.frame(spark, SF, name)
    assert "RepartitionByExpression" not in plan(before)
    monkeypatch.setattr(views, "MOST_AT_ONCE", 1000)
    monkeypatch.setattr(views, "ROWS_A_TASK", 1000)
    dealt = views.frame(spark, SF, name)
    assert plan(dealt).count("RepartitionByExpression") == 2 and ", 6" in plan(dealt)
    assert sorted(before.collect()) == sorted(dealt.collect())


def test_hits_and_sources_are_read_once(spark):
    assert plan(QUERIES["candidate_pool"](spark, SF)).count("l_linenumber") == plan(views.frame(spark, SF, "hits_v")).count("l_linenumber")
    df = QUERIES["answer_consistency"](spark, SF)
    assert plan(df).count("Join") == plan(views.frame(spark, SF, "chunks_v")).count("Join") + 1


def test_hybrid_retrieval_joins_its_hits_once(spark):
    for name in ("hybrid_retrieval", "hybrid_report"):
        assert "l_linenumber" not in plan(QUERIES[name](spark, SF))


def test_blocks_of_vectors_meet_in_groups(spark, monkeypatch):
    rows = [(i, [float((i * i * 7 + j * 13) % 11 - 5) for j in range(8)]) for i in range(300)]
    v = spark.createDataFrame(rows + [(300 + i, e) for i, e in rows[:50]], "vec_id long, embedding array<float>")  # equal vectors tie
    q = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    m = np.array([r[1] for r in rows + rows[:50]])
    unit, want = m / np.linalg.norm(m, axis=1, keepdims=True), set()
    for i in range(0, 350, 5):
        s = [round(float(x), 9) for x in (unit * unit[i]).sum(axis=1)]
        want |= {(i, b, n + 1) for n, b in enumerate(sorted((j for j in range(350) if j != i), key=lambda j: (-s[j], j))[:4])}
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 40)
    df = V.knn_join(q, v, 4, drop_same=True)
    assert "FlatMapCoGroups" in plan(df) and {(r.query_id, r.vec_id, r.rank) for r in df.collect()} == want
    near = V.ann_join(q, v, 4, nlist=6, nprobe=6)  # all cells, so exact
    rows_of = lambda df: {(r.query_id, r.vec_id, r.rank) for r in df.collect()}
    assert "FlatMapCoGroups" in plan(near) and rows_of(near) == rows_of(V.knn_join(q, v, 4))


def test_labels_are_counted_not_paired(spark):
    text = plan(QUERIES["knn_label_metrics"](spark, SF))
    assert "NOT (vec_id" not in text and "MapInPandas" not in text


@pytest.mark.parametrize("most", [110, 1_000_000])
def test_neighbours_meet_in_cells(spark, monkeypatch, most):
    rng = np.random.default_rng(3)
    edges = [(0, i) for i in range(1, 120)] + [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(7, 7), (None, 3)]
    e = spark.createDataFrame(edges, "src long, dst long")
    for name in ("PAIRS_A_CELL", "BITS_A_CELL", "FOUND_A_CELL"):
        monkeypatch.setattr(J, name, most)  # node 0 has more pairs than a cell of 110
    df = J.neighbours(e, spark.range(0, 400, 3).select(F.col("id").alias("node")), 3)
    assert "FlatMapCoGroups" in plan(df) and ("Aggregate" in plan(df)) == (most == 110)  # without such a node the last step is dealt, not summed up
    assert {tuple(r) for r in df.collect()} == plain_neighbours(edges, range(0, 400, 3), 3)


def test_long_titles_are_compared_in_step_and_within_reach(monkeypatch):
    monkeypatch.setattr(C, "_common_length", None)  # no pair on its own
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("etaoin shrdlu"), n))
    base = [word(n) for n in (0, 3, 70, 200, 1300)]
    near = lambda t, p: "".join(word(2) if rng.random() < p else c for c in t if rng.random() > p)
    a = [near(t, p) for t in base for p in (0.0, 0.04, 0.1)]
    b = [near(t, p) for t in base for p in (0.0, 0.05, 0.09)] + [t[n:] + t[:n] for t in base for n in (10, 100)]
    i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    both = np.array([len(a[x]) + len(b[y]) for x, y in zip(i, j)])
    exact = np.array([round(C.indel_ratio(a[x], b[y]) * n / 200) if n else 0 for x, y, n in zip(i, j, both)])
    for cutoff in (60, 85, 95):
        need = np.ceil(cutoff * both / 200 - 1e-6).astype(np.int64)
        got = C.common_lengths(a, b, i, j, need)
        assert got.tolist() == np.where(exact >= need, exact, -1).tolist() and 0 < (got >= 0).sum() < len(i)


def test_large_graphs_are_dealt_by_their_rows(spark, monkeypatch):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_suppkey", F.col("l_suppkey") + F.col("l_partkey") % 7 * 100)
    edges = lambda: J.coauthor_edges(li, "l_orderkey", "l_suppkey").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("shared").alias("weight"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    before = [rows(edges()), rows(J.communities(edges())), rows(J.louvain(edges())[0])]
    monkeypatch.setattr(J, "MOST_AT_ONCE", 1000)
    monkeypatch.setattr(J, "ROWS_A_TASK", 4000)
    assert plan(edges()).count("RepartitionByExpression") == 3
    matrix = J._matrix(edges(), "weight", "test")
    votes = matrix.join(J._with_labels(spark.range(800).select(F.col("id").alias("dst"), F.col("id").alias("label")), 800), "dst").groupBy("src", "label").agg(F.sum("weight"))
    votes.collect()
    text = votes._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text and "Bucketed: true" in text  # neither pairs nor votes are shuffled in a round
    assert [rows(edges()), rows(J.communities(edges())), rows(J.louvain(edges())[0])] == before
    monkeypatch.setattr(J, "MAX_LABELS", 0)
    assert rows(J.communities(edges())) == before[1]


def test_claims_and_sources_meet_as_texts(spark):
    """The scores of all pairs of a batch equal those of arrays, which were made and shuffled before; claims are not shuffled once more."""
    rng = np.random.default_rng(11)
    bits = ["model", "Not", "never", "12.5%", "12", "7.", "a_b", "İxİyz", "Kelvin", "。", "！", "\n", "? ", ". ", "! ", "\x0b", "汉字", "FAILS", "1.2.3%", "٣٤٥", "recall", "Σας", "　", "x1y2"]
    made = lambda n: ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.integers(0, 14))) for _ in range(n)] + ["", None]
    c = spark.createDataFrame([(i % 9, i, t, ["numeric", "factual", None][i % 3], 0) for i, t in enumerate(made(60))], "answer_id long, claim_no long, claim string, claim_type string, n_citations int")
    s = spark.createDataFrame([(i % 8, i, t) for i, t in enumerate(made(150))], "answer_id long, source_id long, text string")
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(f"({T.NUMBER})"), 1))
    common = lambda a, b: F.size(F.array_intersect(a, b))
    neg = lambda t: F.arrays_overlap(t, F.array(*[F.lit(w) for w in H.NEGATIONS]))
    both = c.join(s, "answer_id", "left").select("*", T.tokens3(F.col("claim")).alias("ct"), T.tokens3(F.col("text")).alias("st"), numbers(F.col("claim")).alias("cn"), numbers(F.col("text")).alias("sn"))
    n = F.greatest(F.size("ct"), F.lit(1))
    lexical = common(F.col("ct"), F.col("st")) / n
    parts = F.split(F.coalesce("text", F.lit("")), r"(?<=[。！？.!?])\s+")
    total = lexical * 0.4 + common(F.col("ct"), F.col("st")) / F.greatest(F.least(F.size("ct"), F.size("st")), F.lit(1)) * 0.25 + F.array_max(F.transform(parts, lambda x: common(F.col("ct"), T.tokens3(x)) / n)) * 0.2
    total += F.when(F.size("cn") > 0, common(F.col("cn"), F.col("sn")) / F.size("cn")).otherwise(0.0) * F.when(F.col("claim_type") == "numeric", 0.25).otherwise(0.05)
    total -= F.when((neg(F.col("ct")) != neg(F.col("st"))) & (lexical >= 0.2), 0.18).otherwise(0.0)
    want = both.select("claim_no", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("s")).groupBy("claim_no").agg(F.max("s"))
    df = H.verify_claims(c, s)
    assert "array_intersect" not in plan(df) and "array_distinct" not in plan(df)
    scores = {r.claim_no: r.score for r in df.collect()}
    assert scores == {r[0]: r[1] for r in want.collect()} and len(set(scores.values())) > 20 and scores[8] == 0.0  # answer 8 has no sources
    report = QUERIES["claim_report"](spark, SF)
    report.collect()
    assert plan(report).count("RepartitionByExpression") == 1


def test_claim_scores_in_slices(monkeypatch):
    texts = ["The model fails. Recall is 12.5% of it", "", None, "recall 12.5%", "no such words", "model recall! model"]
    rows = [(a, i % 2 == 0, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.string(), pa.bool_(), pa.string()))]
    whole = S.scores(*columns).to_pylist()
    monkeypatch.setattr(S, "BYTES_AT_ONCE", 50)
    assert S.scores(*columns).to_pylist() == whole and len(S.scores(*[x[:0] for x in columns])) == 0
    assert whole[0] == 1.0 and whole[3] == pytest.approx(0.4 / 4 + 0.25 + 0.2 / 4 + 0.05 - 0.18)  # the, model, fails, recall; only one side negates


def test_claims_keep_what_citations_leave(spark):
    a = spark.createDataFrame([(1, "[Paper A, Results] [Paper B, Methods]. [Paper C, Results]  [Paper D, x] . [Paper A, Results][Paper B, Methods] [A, b] It is better than [B, c]. [x] is a plain bracket")], "answer_id int, answer string")
    got = [(r.claim_no, r.claim, r.n_citations, r.claim_type) for r in H.extract_claims(a).collect()]
    assert got == [(1, ".", 2, "factual"), (2, ".", 2, "factual"), (3, "It is better than .", 4, "comparative"), (4, "[x] is a plain bracket", 0, "factual")]


def test_papers_of_one_method_set_meet_in_blocks(spark, monkeypatch):
    rows = [(p, m) for p in range(300) for m in range(6) if p % 3 == 0 or m != p % 4] + [(900, None), (None, 1)]
    monkeypatch.setattr(C, "SET_BLOCK", 20)
    df = C.same_method_hints(spark.createDataFrame(rows, "paper_id long, method long"), 0.7)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "paper_id" in physical and not any("BroadcastHashJoin" in x and "other_id" in y for x, y in zip(physical.splitlines(), physical.splitlines()[1:]))
    assert sum("SortMergeJoin [set" in x for x in physical.splitlines()) >= 2  # cells of papers are shuffled, whatever Spark guesses of their size
    sets = {}
    for p, m in rows:
        if p is not None and m is not None:
            sets.setdefault(p, set()).add(m)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert {(r.paper_id, r.other_id): r.similarity for r in df.collect()} == pytest.approx({k: v for k, v in want.items() if v >= 0.7})


@pytest.mark.parametrize("most", [1_000_000, 10])
@pytest.mark.parametrize("name", [int, "n{:03d}".format])
def test_first_neighbours_are_chosen_without_a_shuffle_of_candidates(spark, monkeypatch, most, name):
    rng = np.random.default_rng(5)
    edges = sorted({(name(int(a)), name(int(b))) for a, b in zip(rng.integers(0, 200, 500), rng.integers(0, 25, 500))})
    e = spark.createDataFrame(edges, "src long, dst long" if name is int else "src string, dst string")
    monkeypatch.setattr(J, "MAX_LISTED", most, raising=False)
    monkeypatch.setattr(J, "STARTS_AT_ONCE", 7, raising=False)
    plans, put = [], J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, n: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if n == "front" else None, put(df, n))[1])
    score = {name(i): float(i * 7 % 5) for i in range(0, 200, 2)}
    weights = spark.createDataFrame(list(score.items()), e.select(e.src.alias("node")).schema.add("score", "double"))
    starts = [name(i) for i in range(0, 210, 3)]
    got = {}
    for r in J.neighbours(e, spark.createDataFrame([(s,) for s in [*starts, None, starts[0]]], e.select(e.src.alias("node")).schema), 3, None, 6, weights).collect():
        got.setdefault(r.start, []).append((r.rank, r.node, r.distance))
    want = {}
    for a, b, d in plain_neighbours(edges, starts, 3):
        want.setdefault(a, []).append((d, -score.get(b, 0.0), b))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(n, b, d) for n, (d, _, b) in enumerate(sorted(v)[:6], 1)] for k, v in want.items()}
    assert most == 10 or not any("hashpartitioning(start" in line and "node" in line for p in plans for line in p.splitlines())
