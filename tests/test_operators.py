"""Operators on small rows whose results are worked out by hand."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import chunking as G, compare as M, filters as B, graph as J, joins as C, lexical as L, ranking as R, vectors as V
from evidencelake.operators.components import connected_components
from evidencelake.sources import artifacts as A
from evidencelake.streaming import events as K


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(f(F.col("x"))).collect()]


def test_indel_ratio():
    assert C.indel_ratio("abc", "abc") == 100 and C.indel_ratio("", "") == 100 and C.indel_ratio("abc", "") == 0
    assert C.indel_ratio("abcd", "abxd") == 75  # common subsequence abd: 2 * 3 / 8
    assert C.indel_ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)


def test_valid_ids(spark):
    values = ["a-1:b", "a b", "", None, "x" * 129, "näh"]
    assert col(spark, values, lambda c: B.valid_id(c, "paper")) == [True, False, False, False, False, False]
    assert col(spark, values, lambda c: B.valid_id(c, "section")) == [True, True, False, False, True, True]


def test_titles(spark):
    assert col(spark, [" A_b\x00c .PDF", None, "x  y"], B.normalize_title) == ["A bc .PDF".replace(" .PDF", ""), "", "x y"]
    assert col(spark, ["Untitled", "", None, "Real"], B.is_placeholder) == [True, True, True, False]


def test_display_metadata(spark):
    df = spark.createDataFrame([("untitled", "my_paper.pdf", ["Ann", "ann ", "a@b.c", "et al", "Bo"], 1700, "N/A"), ("T", None, [], 2000, " V ")], "title string, filename string, authors array<string>, year int, venue string")
    a, b = B.clean_display_metadata(df).collect()
    assert (a.title, a.authors, a.year, a.venue) == ("my paper", ["Ann", "Bo"], None, None)
    assert (b.title, b.authors, b.year, b.venue) == ("T", [], 2000, "V")


def test_handoff(spark):
    df = spark.createDataFrame([("p", None, "c", "x"), (None, "", "c", "y"), (None, "q", None, "z")], "paper_id string, paperId string, sourceChunkId string, claimText string")
    assert [tuple(r) for r in B.normalize_handoff(df).collect()] == [("p", "c", "x")]


def test_source_types(spark):
    values = ["10.1000/x", "https://doi.org/10.1000/x", "2101.00001v2", "arXiv:2101.00001", "a" * 40, "https://h.org/a.pdf", "https://h.org/", "words", None]
    assert col(spark, values, T.source_type) == ["doi", "doi", "arxiv", "arxiv", "s2", "pdf_url", "url", "unknown", "unknown"]


def test_section_paths(spark):
    values = ["1. Introduction > Background", "Methods/Ablation study", "", None, "Foo Bar :: 3.2 Results"]
    assert col(spark, values, T.normalize_section_path) == ["introduction", "method/experiment", "", "", "foo_bar/result"]
    assert col(spark, ["a/b/c", "a", ""], T.section_parent) == ["a/b", "", ""]


def test_chunk_fixed_offsets(spark):
    df = spark.createDataFrame([(1, "x" * 2500), (2, ""), (3, None), (4, "y" * 200)], "doc_id long, text string")
    got = [(r.doc_id, r.start, len(r.content)) for r in L.chunk_fixed(df).orderBy("doc_id", "start").collect()]
    assert got == [(1, 0, 1400), (1, 1200, 1300), (4, 0, 200)]


def test_fuzzy_titles(spark):
    jobs = [(1, 9, "deep learning for graphs", "Ann Lee", 2020), (2, 9, "completely different words", "Bo", 2020), (3, 8, "deep learning for graphs", "Ann Lee", 2020)]
    papers = [(10, 9, "Deep Learning for Graph", "Ann Lee", 2021), (11, 9, "deep learning for graphs", "Someone Else", 2001)]
    cols = "user_id int, title string, author string, year int"
    got = {r.job_id: (r.paper_id, r.match_score) for r in C.fuzzy_title_match(spark.createDataFrame(jobs, f"job_id int, {cols}"), spark.createDataFrame(papers, f"paper_id int, {cols}")).collect()}
    assert got == {1: (10, pytest.approx(200 * 23 / 47))}


def test_no_fuzzy_pair_is_lost(spark):
    import random

    rng, rows = random.Random(3), []
    for i in range(150):
        base = "".join(rng.choice("abcde ") for _ in range(rng.randint(2, 24)))
        for k in range(2):
            t = list(base)
            for _ in range(k * rng.randint(0, max(1, len(t) // 6))):
                t.insert(rng.randrange(len(t) + 1), rng.choice("abcde"))
            rows.append((2 * i + k, 0, "".join(t).strip() or "x"))
    jobs = [(i, 0, t, "a", 1) for i, _, t in rows if i % 2 == 0]
    papers = [(i, 0, t, "a", 1) for i, _, t in rows if i % 2 == 1]
    best = {}
    for i, _, t, *_ in jobs:
        found = [(-C.indel_ratio(t, u), j) for j, _, u, *_ in papers if C.indel_ratio(t, u) >= 85]
        if found:
            best[i] = min(found)[1]
    cols = "user_id int, title string, author string, year int"
    got = C.fuzzy_title_match(spark.createDataFrame(jobs, f"job_id int, {cols}"), spark.createDataFrame(papers, f"paper_id int, {cols}"))
    assert {r.job_id: r.paper_id for r in got.collect()} == best and len(best) > 60


def test_three_tiers(spark):
    cols = "user_id int, title string, author string, year int"
    jobs = spark.createDataFrame([(1, "e1", "h1", 1, "t", "a", 1), (2, "", "h1", 1, "t", "a", 1), (3, "", "h9", 1, "a long enough title", "a", 2000)], f"job_id int, external_id string, file_hash string, {cols}")
    papers = spark.createDataFrame([(7, "e1", 1, "zzzz", "a", 1), (8, "", 1, "A long enough title", "a", 2000)], f"paper_id int, external_id string, {cols}")
    done = spark.createDataFrame([(5, "h1", 1), (6, "h1", 2)], "paper_id int, file_hash string, finished_at int")
    assert sorted(tuple(r[c] for c in ("job_id", "paper_id", "tier")) for r in C.three_tier_dedupe(jobs, papers, done).collect()) == [(1, 7, 1), (2, 6, 2), (3, 8, 3)]


def test_merge_keeps_the_end_of_a_chain(spark):
    a, b, c = "abcdefghijklmnopqrst", "abcdefghijklmnopqrxy", "abcdefghijklmnopzwxy"
    assert C.indel_ratio(a, b) == C.indel_ratio(b, c) == 90 and C.indel_ratio(a, c) < 90
    rows = [(1, "arxiv", "", a), (2, "arxiv", "", b), (3, "arxiv", "", c), (4, "semantic-scholar", "X1", "other"), (5, "arxiv", "X1", "unrelated"), (6, "arxiv", None, "")]
    df = spark.createDataFrame([(1, *r) for r in rows] + [(2, 9, "arxiv", "X1", a)], "scope int, result_id int, source string, arxiv_id string, title string")
    ids = lambda cut: sorted(r.result_id for r in M.merge_search_results(df, cut).collect())
    assert ids(90) == [1, 2, 3, 4, 6, 9]  # a ratio of exactly 90 is not over 90
    assert ids(89) == [1, 3, 4, 6, 9]


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8)).astype(np.float32)
    m[7] = 0
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    q = v.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    unit = m / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-12)
    want = {(i, int(j)) for i in range(0, 60, 10) for j in sorted(range(60), key=lambda j: (-(unit[i] @ unit[j]), j))[:5]}
    got = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    assert got(V.knn_join(q, v, 5)) == want
    assert V.knn_join(q.limit(0), v, 5).count() == 0
    assert sum(V.valid_vectors(v, 8) is not None for _ in [0]) and v.where(V.valid_vectors(v, 8)).count() == 59


def test_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 4)))], "vec_id long, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "query_id")
    few = sorted(map(tuple, V.knn_join(q, v, 3).select("query_id", "vec_id", "rank").collect()))
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, V.knn_join(q, v, 3).select("query_id", "vec_id", "rank").collect())) == few


def test_ann_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    exact = pairs(V.knn_join(q, e, 10))
    assert len(exact & pairs(V.ann_join(q, e, 10))) / len(exact) >= 0.9


def test_rrf_does_not_depend_on_order(spark):
    rows = [(1, b, c, s) for b, c, s in (("x", 1, 0.9), ("x", 2, 0.8), ("y", 2, 0.7), ("y", 3, 0.7))]
    df = spark.createDataFrame(rows, "query_id int, branch string, chunk_id int, score double")
    get = lambda d: [(r.chunk_id, round(r.rrf_score, 9)) for r in R.rrf_fuse(d).orderBy("pre_rerank_rank").collect()]
    assert get(df) == get(df.orderBy(F.desc("chunk_id")).repartition(3)) == [(2, round(1 / 62 + 1 / 61, 9)), (1, round(1 / 61, 9)), (3, round(1 / 62, 9))]


def test_recall_grows_with_k(spark):
    res = spark.createDataFrame([(1, c, r) for r, c in enumerate([5, 9, 5, 7], 1)], "query_id int, chunk_id int, rank int")
    rel = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "query_id int, chunk_id int")
    a, b = L.retrieval_metrics(res, rel, ks=(1, 3, 5)).orderBy("query_id").collect()
    assert (a.recall_1, a.recall_3, a.recall_5, a.mrr) == (0.5, 0.5, 1.0, 1.0) and (b.recall_5, b.mrr, b.ndcg) == (0, 0, 0)


def test_pagerank_by_hand(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (4, 3)], "src long, dst long")
    s = {n: 0.1 for n in (1, 2, 3, 4)}
    for _ in range(20):
        s = {1: 0.1 + 0.9 * s[3], 2: 0.1 + 0.9 * s[1], 3: 0.1 + 0.9 * (s[2] + s[4]), 4: 0.1}
    got = {r.node: r.score for r in J.pagerank(e, tolerance=0.0).collect()}
    assert got == pytest.approx(s)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    e = spark.createDataFrame([*chain, (5, 4), (4, 4), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 4: 4, 5: 4, 7: 7}
    assert connected_components(e.limit(0)).count() == 0


def test_evolution_band_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    words = [f"k{i}" for i in range(60)]
    pick = lambda most: sorted({words[int(60 * x**2)] for x in rng.random(int(rng.integers(0, most)))})
    papers = [(i, int(rng.integers(2000, 2012)), pick(8), int(rng.integers(0, 9))) for i in range(300)] + [(900, 2005, None, None)]
    hits = [(q, int(p)) for q in range(25) for p in rng.integers(0, 300, rng.integers(1, 4 if q % 3 else 25))]
    got = {}
    for r in C.evolution_band(spark.createDataFrame(hits, "query_id int, paper_id int"), spark.createDataFrame(papers, "paper_id int, pub_year int, keywords array<string>, citations int"), 2, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.paper_id))
    by_id, want, wide = {p[0]: p for p in papers}, {}, 0
    for q in range(25):
        own = {p for x, p in hits if x == q}
        years, mine = [by_id[p][1] for p in own], {w for p in own for w in by_id[p][2]}
        wide += len(mine) > 14
        every = []
        for p, y, ws, c in papers:
            ws = set(ws or ())
            alike = bool(mine | ws) and len(mine & ws) / len(mine | ws) >= 0.05
            if p not in own and min(years) - 2 <= y <= max(years) + 2 and (alike or abs(y - max(years)) <= 1):
                every.append((-(c or 0), p))
        if every:
            want[q] = [(n, p) for n, (_, p) in enumerate(sorted(every)[:4], 1)]
    assert wide and wide < 25 and {q: sorted(v) for q, v in got.items()} == want


def test_louvain(spark):
    clique = lambda g, n: [(a, b, 1) for a in range(g, g + n) for b in range(a + 1, g + n)]
    ring = [e for g in range(0, 60, 10) for e in clique(g, 5)] + [(g, (g + 10) % 60, 1) for g in range(0, 60, 10)] + [(None, 3, 1), (0, 0, 2)]
    e = spark.createDataFrame(ring, "src long, dst long, weight long").repartition(3)
    labels, levels = J.louvain(e)
    got = {r.node: r.label for r in labels.collect()}
    assert len(got) == 30 and len(set(got.values())) == 6 and all(got[g + i] == got[g] for g in range(0, 60, 10) for i in range(5))
    assert levels == sorted(levels) and levels[-1] > 0.7
    assert J.louvain(e.limit(0))[0].count() == 0


def test_louvain_is_no_worse_than_votes(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    e = J.coauthor_edges(li, "l_orderkey", "l_suppkey").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("shared").alias("weight"))
    labels, levels = J.louvain(e)
    assert J.modularity(e, labels).first()[0] == pytest.approx(levels[-1]) and levels == sorted(levels)
    assert levels[-1] >= J.modularity(e, J.communities(e)).first()[0] - 1e-9


def plain_neighbours(edges, starts, hops):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = set()
    for s in starts:
        seen, front = {s}, {s}
        for d in range(1, hops + 1):
            front = {x for f in front for x in near.get(f, ())} - seen
            seen |= front
            out |= {(s, x, d) for x in front}
    return out


def test_neighbours_past_hubs(spark):
    rng = np.random.default_rng(6)
    edges = [(0, int(i)) for i in range(1, 200)] + [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(None, 4), (5, 5)]
    e = spark.createDataFrame([(a, b, "x" if (a or 0) % 2 else "y") for a, b in edges], "src long, dst long, relation string")
    starts = list(range(0, 260))
    s = spark.createDataFrame([(i,) for i in [*starts, 3, None]], "node long")
    assert {tuple(r) for r in J.neighbours(e, s, 3).collect()} == plain_neighbours(edges, starts, 3)
    some = [(a, b) for a, b in edges if (a or 0) % 2]
    score = spark.createDataFrame([(i, float(i % 7)) for i in range(0, 300, 2)], "node long, score double")
    got = {}
    for r in J.neighbours(e, s, 2, ["x"], 3, score).collect():
        got.setdefault(r.start, []).append((r.rank, r.node, r.distance))
    want = {}
    for a, b, d in plain_neighbours(some, starts, 2):
        want.setdefault(a, []).append((d, -(b % 7) if b % 2 == 0 and b < 300 else 0, b))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(n, b, d) for n, (d, _, b) in enumerate(sorted(v)[:3], 1)] for k, v in want.items()}


def test_communities(spark):
    e = spark.createDataFrame([(a, b, 1) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(0, 10, 1)], "src long, dst long, weight long")
    labels = J.communities(e)
    got = {r.node: r.label for r in labels.collect()}
    assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(10, 14)}) == 1 and got[1] != got[11]
    assert J.modularity(e, labels).first()[0] == pytest.approx(12 / 13 - 2 * 13 * 13 / (4 * 13 * 13))


def test_imrad_without_headings(spark):
    df = spark.createDataFrame([(1, i, 1, f"text {i}") for i in range(8)], "paper_id long, pos int, page_num int, text string")
    got = {r.section: (r.words, r.confidence) for r in G.imrad(df).collect()}
    assert got == {s: (4, 0.3) for s in ("introduction", "methods", "results", "conclusion")}


def test_fold_chunks(spark):
    df = spark.createDataFrame([(1, 0, "a" * 30), (1, 1, "b" * 30), (1, 2, None), (1, 3, "c" * 80)], "paper_id long, pos long, text string")
    got = [(r.chunk_no, len(r.text), r.first_pos, r.last_pos) for r in G.fold_chunks(df, 61).orderBy("chunk_no").collect()]
    assert got == [(0, 62, 0, 1), (1, 80, 3, 3)]
    three = spark.createDataFrame([(1, i, "x" * 300) for i in range(3)], "paper_id long, pos long, text string")
    assert [len(r.text) for r in G.fold_chunks(three).orderBy("chunk_no").collect()] == [602, 300]


def test_fold_chunks_with_pages_and_media(spark):
    rows = [(1, 0, "table", "|a|", 1, "b0", None), (1, 1, "text", "w" * 40, None, None, "intro"), (1, 2, "text", "x" * 30, 2, None, "later"), (1, 3, "picture", "alt", 3, "b3", None), (1, 4, "text", "y", 4, None, "results"), (1, 5, "footnote", "z", 5, None, None), (1, 6, "text", "v", 6, None, None), (2, 0, "picture", None, 1, None, None)]
    df = spark.createDataFrame(rows, "paper_id long, pos long, type string, text string, page int, bbox string, section string")
    got = [(r.text, r.section, r.page_start, r.page_end, [tuple(m) for m in r.media]) for r in G.fold_chunks(df, 60).orderBy("chunk_no").collect()]
    assert got == [("w" * 40 + "\n\n" + "x" * 30, "intro", 2, 2, [("table", 1, "b0", "|a|"), ("picture", 3, "b3", None)]), ("y\n\nv", "results", 4, 6, [])]


def test_average_linkage():
    unit = np.array([[1, 0], [0.99, 0.14], [0, 1], [0.1, 0.995]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert G.average_linkage(unit, 0.3).tolist() == [0, 0, 1, 1]
    assert G.average_linkage(unit, 2.0).tolist() == [0, 0, 0, 0] and len(set(G.average_linkage(unit, 0.0))) == 4


def greedy(unit, cutoff):
    """Average linkage by always merging the nearest pair."""
    groups = [[i] for i in range(len(unit))]
    far = 1 - unit @ unit.T
    while len(groups) > 1:
        d, a, b = min((np.mean(far[np.ix_(x, y)]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if d > cutoff:
            break
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups)


def test_average_linkage_equals_merging_the_nearest_pair():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 60):
        unit = rng.normal(size=(n, 5))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for cutoff in (0.05, 0.3, 0.6, 0.9):
            labels = G.average_linkage(unit, cutoff)
            assert sorted(np.flatnonzero(labels == k).tolist() for k in range(labels.max() + 1)) == greedy(unit, cutoff)
    big = rng.normal(size=(2500, 8))
    big /= np.linalg.norm(big, axis=1, keepdims=True)
    assert len(np.unique(G.average_linkage(big, 0.4))) > 10


def test_silhouette():
    unit = np.array([[1, 0], [1, 0], [0, 1], [0, 1], [0.6, 0.8]])
    labels = np.array([0, 0, 1, 1, 2])
    assert G.silhouette(unit, labels) == pytest.approx(4 / 5)  # each pair lies on one point; the fifth row is alone
    pairs = np.array([0, 0, 0, 1, 1])
    want = []
    far = 1 - unit @ unit.T
    for i in range(5):
        own = [far[i, j] for j in range(5) if pairs[j] == pairs[i] and j != i]
        other = [far[i, j] for j in range(5) if pairs[j] != pairs[i]]
        a, b = np.mean(own), np.mean(other)
        want.append((b - a) / max(a, b))
    assert G.silhouette(unit, pairs) == pytest.approx(np.mean(want)) and G.silhouette(unit, np.zeros(5, int)) == 0


def test_trees_stop_where_they_should(spark):
    near = lambda a, n: [[np.cos(a + 0.01 * i), np.sin(a + 0.01 * i)] for i in range(n)]
    papers = {1: near(0, 3) + near(1.5, 3), 2: near(0, 2), 3: near(0, 8), 4: [*np.eye(6), np.eye(6)[0]], 5: near(0, 2) + near(1.5, 3), 6: near(0, 4) + near(0.5, 4) + near(2.5, 7)}
    df = spark.createDataFrame([(p, i, [float(x) for x in v]) for p, vs in papers.items() for i, v in enumerate(vs)], "paper_id long, vec_id long, embedding array<double>")
    tree = {}
    for r in G.raptor_tree(df, 0.3, tighter=0.3).collect():
        tree.setdefault(r.paper_id, {})[r.node] = r.parent
    assert tree[1] == {**{f"c{i}": "n1_0" for i in range(3)}, **{f"c{i}": "n1_1" for i in range(3, 6)}, "n1_0": None, "n1_1": None}
    for p in (2, 3, 4, 5):  # two chunks; one cluster; no clear clusters; few chunks
        assert set(tree[p].values()) == {None} and all(n.startswith("c") for n in tree[p]), p
    assert tree[6]["c0"] == "n2_0" and tree[6]["c5"] == "n2_1" and tree[6]["n2_0"] == tree[6]["n2_1"] == "n1_0" and tree[6]["c9"] == "n1_1"


def test_table_rows(spark):
    df = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\nnot a row")], "table_id int, markdown string")
    assert [r.cells for r in G.table_rows(df).orderBy("row_no").collect()] == [{"a": "1", "b": "2"}, {"a": "3"}]


def test_compare(spark):
    chunks = spark.createDataFrame([(1, 10, "Methods", "Our approach is new. It improves recall."), (2, 20, "Data", "The corpus is big.")], "paper_id int, chunk_id int, section string, content string")
    rows = {r.paper_id: r.asDict() for r in M.compare_matrix(chunks, chunks).collect()}
    assert rows[1] == {"paper_id": 1, "problem": "none", "method": "full", "dataset": "none", "metrics": "full", "results": "full", "limitations": "none", "innovation": "none"}
    assert rows[2]["dataset"] == "full" and rows[2]["method"] == "none"
    assert {r.dimension for r in M.cross_paper_insights(M.dimension_scores(chunks)).collect()} == set()


def test_timeline(spark):
    p = spark.createDataFrame([(1, "yolo", "YOLO v2", 2016), (2, "yolo", "Version 3 of YOLO", 2018), (3, "yolo", "plain", 2019)], "paper_id int, method string, title string, year int")
    assert [(r.paper_id, r.version, r.step) for r in M.version_timeline(p).orderBy("year").collect()] == [(1, 2, None), (2, 3, 1)]
    e = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    assert [(r.src, r.dst) for r in M.citation_order(e, p).collect()] == [(1, 2)]


def test_artifacts(spark, tmp_path):
    def put(path, value):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(value if isinstance(value, str) else json.dumps(value))

    put("papers/p1/chunks_rule.json", [{"source_chunk_id": "a", "content_data": "x", "page_num": 1}])
    put("papers/p1/chunks_raw.json", [{"source_chunk_id": "old"}])
    put("papers/p2/chunks_raw.json", {"chunks": [{"source_chunk_id": "b", "paper_id": "other", "content_type": "table"}]})
    put("papers/p3/chunks_raw.json", "not json")
    got = sorted((r.paper_id, r.source_chunk_id, r.content_type, r.stage) for r in A.read_chunk_artifacts(spark, str(tmp_path)).collect())
    assert got == [("other", "b", "table", "raw"), ("p1", "a", "text", "rule")]
    put("golden.json", {"papers": [{"paper_id": "p", "queries": [{"id": "1", "query": "compare x", "expected_chunks": ["c"], "query_type": ""}, {"id": "2", "query": " "}]}], "cross_paper_queries": [{"id": "3", "query": "related work on x", "paper_ids": ["p", "q"]}], "multimodal_queries": [{"id": "4", "query": "figure 1", "expected_content_type": ["figure"]}]})
    assert sorted((r.id, r.kind, r.family) for r in A.read_golden(spark, str(tmp_path / "golden.json")).collect()) == [("1", "paper", "compare"), ("3", "cross_paper", "related_work"), ("4", "multimodal", "figure")]
    put("runs/r1/meta.json", {"mode": "real"})
    put("runs/r1/dashboard_summary.json", {"retrieval_hit_rate": 0, "top_k_recall": {"recall_at_5": 0.5}})
    put("runs/r1/retrieval.json", {"recall_at_5": 0.4, "recall_at_10": 0.6, "hit_rate": 0.7})
    r = A.read_runs(spark, str(tmp_path / "runs")).first()
    assert (r.run_id, r.mode, r.recall_at_5, r.recall_at_10, r.hit_rate) == ("r1", "real", 0.5, 0.6, 0.7)
    report = A.write_report(spark.createDataFrame([("a", 0.5)], "name string, value double"), str(tmp_path / "report"), "Title")
    assert report == "# Title\n\n| name | value |\n|-|-|\n| a | 0.5 |\n"
    with pytest.raises(ValueError):
        A.write_report(spark.range(200), str(tmp_path / "long"), "Title")


def test_chunk_source_index(spark):
    df = spark.createDataFrame([("c", "p", 1, "raw", "", "first"), ("c", "p", 2, "llm", "anchor", "later"), ("d", "p", 1, "rule", None, "x" * 900)], "source_chunk_id string, paper_id string, page_num int, stage string, anchor_text string, content_data string")
    c, d = A.chunk_source_index(df).orderBy("source_chunk_id").collect()
    assert (c.stage, c.anchor, c.quote, c.url) == ("llm", "anchor", "later", "/read/p?page=2&source=evidence&source_id=c")
    assert (len(d.anchor), len(d.quote)) == (300, 600)


def test_new_documents_are_chunked_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 300) for i in range(4)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    run = lambda: K.enrich_new_documents(K.read_stream(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(3, "again"), (9, "new text")], docs.schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in out.select("doc_id").distinct().collect()) == [0, 1, 2, 3, 9]
    assert out.where("doc_id = 3").count() == L.chunk_fixed(docs.where("doc_id = 3")).count()
