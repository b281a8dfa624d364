"""Rule tables against values written by hand."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidencelake.functions import planning as P, text as T
from evidencelake.operators import chunking as G, compare as M, gates as GA, joins as C, lexical as L, reports as R, usage as U, vectors as V, verify as H
from evidencelake.plans.catalog import QUERIES
from evidencelake.plans.views import frame
from evidencelake.scratch import join_per_key
from evidencelake.streaming import events as K

FAMILIES = {
    "Compare figures 1 and 2": "compare", "Show figure 3": "figure", "see fig.2": "figure", "see fig. 2": "fact", "Which rows matter?": "fact", "the caption of the figures": "figure", "columns of both tables": "table", "What does table 2 say?": "table",
    "related work on graphs": "related_work", "A survey of related work": "related_work", "literature review of LLMs": "survey", "综述": "survey", "timeline of BERT": "method_evolution", "They contradict each other": "conflicting_evidence",
    "why is parsing difficult": "hard", "BERT vs GPT": "compare", "a cross-paper view": "cross_paper", "accuracy of X": "numeric", "which algorithm": "method", "": "fact", None: "fact",
}


def test_query_families(spark):
    df = spark.createDataFrame([(q,) for q in FAMILIES], "q string")
    assert {r.q: r.f for r in df.select("q", T.infer_query_family(F.col("q")).alias("f")).collect()} == FAMILIES


def test_routes(spark):
    df = spark.createDataFrame([(1, "numeric"), (2, "evolution"), (3, "odd"), (4, None)], "query_id int, family string")
    got = [(r.query_id, r.index_type, r.content_types, r.section_hint, r.k_factor, r.citation_hints) for r in P.route_index(df).orderBy("query_id", "priority").collect()]
    assert got == [
        (1, "local_evidence", ["table", "text"], "Results", 1.0, False), (1, "structural", [], None, 1.0, False), (2, "summary", [], None, 2.0, True), (2, "structural", [], None, 1.0, True), (2, "local_evidence", [], None, 1.0, True),
        (3, "local_evidence", [], None, 1.0, False), (4, "local_evidence", [], None, 1.0, False),
    ]
    assert {(r.index_type, r.priority, r.citation_hints) for r in P.route_index(df, "summary").collect()} == {("summary", 1, False)}


def test_task_routes(spark):
    df = spark.createDataFrame([(1, "compare", False), (2, "survey", False), (3, "compare", True), (4, "table", None), (5, "odd", False)], "query_id int, family string, claim_repair boolean")
    got = {r.query_id: r for r in P.route_task(df).collect()}
    pick = lambda i, *names: tuple(got[i][n] for n in names)
    assert pick(1, "task_family", "execution_mode", "kernel_scope", "truthfulness_required") == ("compare", "local_compare", "dual_kernel", True)
    assert pick(2, "execution_mode", "review_strategy", "global_synthesis", "model_policy") == ("global_review", "storm_lite", True, "pro")
    assert pick(3, "task_family", "execution_mode", "depth", "verifier", "truthfulness_required") == ("compare", "truthfulness_repair", "focused", "rarr_cove_scifact_lite", True)
    assert pick(4, "task_family", "depth", "routing_policy", "truthfulness_required") == ("single_paper_table_figure", "medium", "adaptive_depth", False)
    assert pick(5, "family", "task_family", "depth", "routing_policy") == ("fact", "single_paper_fact", "shallow", "fixed_depth")
    assert P.route_task(df.drop("claim_repair").limit(0)).count() == 0


def test_truthfulness(spark):
    a = spark.createDataFrame([(1, "Claims here."), (2, ""), (3, "Yes"), (4, "There is INSUFFICIENT evidence"), (5, "Yes"), (6, "x"), (7, None)], "answer_id int, answer string")
    v = spark.createDataFrame([(1, 1, "supported", ["a"]), (1, 2, "weakly_supported", ["a", "b", "c"]), (6, 1, "supported", []), (6, 2, "unsupported", [])], "answer_id int, claim_no int, support_level string, evidence_ids array<string>")
    s = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t"), (4, "t"), (5, " "), (6, "t")], "answer_id int, text string")
    got = {r.answer_id: (r.claims, r.weakly_supported, r.unsupported, r.unsupported_rate, r.answer_mode, r.backend) for r in H.truthfulness_report(a, v, s).collect()}
    assert got == {
        1: (2, 1, 0, 0.0, "partial", "lexical_overlap"), 2: (0, 0, 0, 0.0, "abstain", "lexical_overlap"), 3: (1, 1, 0, 0.0, "partial", "fallback_unstructured_answer"), 4: (1, 0, 1, 1.0, "abstain", "lexical_abstain_guard"),
        5: (0, 0, 0, 1.0, "abstain", "no_claims_without_evidence"), 6: (2, 0, 1, 0.5, "abstain", "lexical_overlap"), 7: (0, 0, 0, 0.0, "abstain", "lexical_overlap"),
    }
    hints = {(r.answer_id, r.claim_no): r.repair_hint for r in H.repair_hints(v).collect()}
    assert hints == {(1, 1): None, (1, 2): "Relink claim to stronger evidence a, b and rewrite for weakly_supported support.", (6, 1): None, (6, 2): "Retrieve stronger evidence or narrow the claim before rewriting."}
    assert {r.answer_id: r.answer_mode for r in H.claim_row_summary(v).collect()} == {1: "partial", 6: "abstain"}


def test_failure_buckets(spark):
    lit = lambda *xs: [F.lit(x) for x in xs]
    one = spark.range(1).select(
        GA.retrieval_failure(*lit(0, True, True, True, True)).alias("a"), GA.retrieval_failure(*lit(3, False, True, True, True)).alias("b"), GA.retrieval_failure(*lit(3, True, False, True, True)).alias("c"), GA.retrieval_failure(*lit(3, True, True, False, True)).alias("d"),
        GA.retrieval_failure(*lit(3, True, True, True, False)).alias("e"), GA.retrieval_failure(*lit(3, True, True, True, True)).alias("f"), GA.failure_bucket(*lit(True, True, False, False)).alias("g"), GA.failure_bucket(*lit(True, True, True, False)).alias("h"),
    ).first()
    assert tuple(one) == ("retrieval_miss", "evaluation_mapping_error", "retrieval_miss", "paper_hit_but_section_miss", "section_hit_but_chunk_miss", "", "candidate_pool_miss", "exact_miss")
    names = [n for n, *_ in GA.RECORD_LIMITS]
    good = {"paper_hit_rate": 1.0, "section_hit_rate": 1.0, "oracle_recall_100": 0.6, "rerank_loss": 0.05, "consistency": 0.55, "content_type_match": 0.5, "numeric_hit_20": 0.6, "cross_paper_coverage": 0.7, "citation_coverage": 0.75}
    worse = {"rerank_loss": (0.06, "reranker_miss"), "numeric_hit_20": (0.5, "numeric_miss"), "citation_coverage": (None, "citation_miss"), "section_hit_rate": (0.0, "section_miss")}
    rows = [tuple(good.values())] + [tuple({**good, n: v}.values()) for n, (v, _) in worse.items()]
    got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).select(GA.record_failure(names)).collect()]
    assert got == ["candidate_pool_miss", *(b for _, b in worse.values())]


def test_benchmark_gate(spark):
    rows = [(1, "ok", False, 0.9, 0.0, 0.7, 1.0, 5.0, 0), (2, "ok", False, 0.8, 0.0, 0.7, 1.0, 5.0, 0), (3, "ok", False, 0.9, 0.0, 0.7, 1.0, 61.0, 0), (4, "bad", True, 0.0, 1.0, 0.0, 0.0, 1.0, 0), (5, "ok", False, 0.9, 0.0, 0.7, 1.0, 5.0, 1)]
    df = spark.createDataFrame(rows, "run_id int, status string, synthetic boolean, citation_coverage double, unsupported_claim double, consistency double, jump_valid double, latency_s double, hard_error int")
    got = {r.run_id: (r.eval_status, r.gate_status) for r in GA.benchmark_summary(df).collect()}
    assert got == {1: ("QUALITY_PASS", "PASS"), 2: ("QUALITY_BLOCKED", "BLOCKED"), 3: ("PIPELINE_ERROR", "BLOCKED"), 4: ("SMOKE", "SMOKE_ONLY"), 5: ("PIPELINE_ERROR", "BLOCKED")}


def test_percentile_of_large_groups(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(g, rng.choice((rng.random(), 0.5))) for g, n in (("a", 3000), ("b", 10), ("c", 1)) for _ in range(n)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    want = lambda g, p: (lambda v: v[max(int(p * len(v)) - 1, 0)])(sorted(v for k, v in rows if k == g and v is not None))
    for small in (U.SMALL_GROUP, 1000):
        monkeypatch.setattr(U, "SMALL_GROUP", small)
        for p in (0.95, 0.5, 0.0, 1.0):
            assert {r.g: r.p_value for r in U.percentile_nearest(df, ["g"], "v", p).collect()} == {g: want(g, p) for g in "abc"}
    assert U.percentile_nearest(df.where("g = 'b'"), [], "v").first()[0] == want("b", 0.95)


def test_hints_and_ontology(spark):
    df = spark.createDataFrame([(1, "We use BERT-BASE on GLUE and SQuAD. Accuracy and Recall@10, Fig. 3, figure 4, Figure 5; Table 2"), (2, None)], "chunk_id int, content string")
    h = {r.chunk_id: r.h for r in df.select("chunk_id", T.hints(F.col("content")).alias("h")).collect()}
    assert h[1].metrics == ["accuracy", "recall@10"] and h[1].datasets == ["BERT", "GLUE"] or h[1].datasets == ["BERT-BASE", "GLUE"]
    assert h[1].figures == ["Fig.3", "Fig.4"] and h[1].tables == ["Table 2"] and h[2].methods == []
    text = spark.createDataFrame([(1, "ResNet beats method X-1 on ImageNet and COCO: accuracy for detection against baseline SVM-2. Failure cases."), (2, None)], "chunk_id int, content string")
    entities, relations = R.ontology_slice(text)
    assert {r.name for r in entities.where("kind = 'dataset'").collect()} == {"imagenet", "coco"} and {r.chunk_id for r in entities.collect()} == {1}
    found = {(r.subject, r.predicate, r.object) for r in relations.collect()}
    assert {("resnet", "applies_to_task", "detection"), ("method x-1", "evaluated_on_dataset", "coco"), ("resnet", "has_limitation", "reported limitation"), ("resnet", "compares_against_baseline", "resnet"), ("resnet", "improves_metric_on_dataset", "imagenet")} <= found


def test_dimension_scores_by_hand(spark):
    rows = [(1, "Results", "We improve accuracy by 3 percent."), (2, "Intro", "short"), (3, "Method", "We train a model with a protocol;"), (4, "Other", "In Proceedings of ACL, a novel method."), (5, "Discussion", "However it fails often."), (6, None, None)]
    df = spark.createDataFrame([(i, i, *r) for i, *r in rows], "paper_id int, chunk_id int, section string, content string")
    got = {(r.chunk_id, r.dimension): round(r.score, 6) for r in M.dimension_scores(df).collect()}
    assert got == {
        (1, "metrics"): 1.6 + 0.4 + 0.6, (1, "results"): 1.6 * 2 + 0.4 + 0.6, (5, "limitations"): 1.6 + 0.3 + 0.6,
    }


def test_fragments_and_lead_sentences_by_hand(spark):
    rows = [
        (1, "x", "2.1) Results: We improve accuracy by 3 percent."), (2, "x", "A Novel Framework for Training Large Models of Language"), (3, "x", "In ACL, a novel method here"), (4, "x", "The results are somewhat repetitive and higher here."),
        (5, "x", "We build a new model with an adapter and a retriever for all. Starting from a base model. We use more."), (6, "x", "Raters find better responses than the baseline in most of the cases that we see. Accuracy improves by 5 points and results are higher."),
        (7, "x", "We train a model " + "very " * 60 + "long."), (8, "x", "In ACL, novel idea"),
    ]
    df = spark.createDataFrame([(i, i, *r) for i, *r in rows], "paper_id int, chunk_id int, section string, content string")
    got = {(r.chunk_id, r.dimension): r.snippet for r in M.dimension_scores(df).collect()}
    assert got[1, "results"] == "We improve accuracy by 3 percent."
    assert not any(i in (2, 3) for i, _ in got)  # a title; a line of the references
    assert (4, "results") not in got and got[5, "method"] == "Starting from a base model."
    assert got[6, "results"].startswith("Raters find better responses than") and got[7, "method"] == ("We train a model " + "very " * 60)[:220]
    assert got[8, "innovation"] == "In ACL, novel idea"  # too short for a reference
    texts = {"3. Method - We adapt": "We adapt", "- b) x": "x", "Training LIMA We train it": "We train it", "plain": "plain", "  ": ""}
    one = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.f for r in one.select("t", M.fragment(F.col("t")).alias("f")).collect()} == texts


def test_contract_by_hand(spark):
    cells = spark.createDataFrame([(1, 10, "method", "a"), (1, 10, "results", "a"), (1, 11, "method", "b"), (1, 11, "results", None), (2, 10, "method", "a"), (3, 12, "method", None)], "query_id int, paper_id int, dimension string, chunk_id string")
    scores = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.69), (2, "a", 0.9)], "query_id int, chunk_id string, rerank_score double")
    blocks, answers = M.compare_contract(cells, scores)
    assert {(r.query_id, r.chunk_id): (r.dimensions, r.support_status) for r in blocks.collect()} == {(1, "a"): (["method", "results"], "supported"), (1, "b"): (["method"], "partially_supported"), (2, "a"): (["method"], "supported")}
    assert {r.query_id: (r.blocks, r.supported, r.answer_mode) for r in answers.collect()} == {1: (2, 1, "partial"), 2: (1, 1, "full"), 3: (0, 0, "abstain")}


def test_summary_index(spark, tmp_path):
    rows = [(1, 10, "related_work", 2, "text", "", "b" * 300), (1, 11, "related_work", 1, "table", None, "a"), (1, 12, None, 3, "figure", "anchor", "c")]
    c = spark.createDataFrame(rows, "paper_id int, chunk_id int, section string, pos int, content_type string, anchor string, content string")
    papers, sections = G.write_summary_index(c.select("paper_id").distinct(), c, str(tmp_path / "index"))
    got = {r.section_id: (r.title, r.summary, r.key_terms, r.chunk_ids, r.table_ids, r.figure_ids) for r in sections.collect()}
    assert got == {"1::related_work": ("Related Work", "a " + "b" * 200, ["related", "work"], [11, 10], [11], []), "1::unknown": ("Unknown", "anchor", ["unknown"], [12], [], [12])} and papers.count() == 1


def test_titles_with_unknown_author_or_year(spark):
    cols = "user_id int, title string, author string, year int"
    jobs = spark.createDataFrame([(1, 1, "a study of graph search", None, 2000), (2, 1, "a study of graph search", "Kim", 2000), (3, 1, "a study of graph searches", "Kim", 2000), (4, None, "a study of graph search", "Kim", 2000), (5, 1, None, "x", 1)], f"job_id int, {cols}")
    papers = spark.createDataFrame([(9, 1, "A Study of Graph Search", "Other Person", 2001), (8, 1, "a study of graph search", "Kim", 1980)], f"paper_id int, {cols}")
    got = {r.job_id: (r.paper_id, r.match_score) for r in C.fuzzy_title_match(jobs, papers).collect()}
    assert got == {1: (9, 100.0), 2: (8, 85.0)}  # job 3 is near, but no paper has both its author and year


def test_near_titles_in_many_blocks_and_very_long_ones(spark, monkeypatch):
    monkeypatch.setattr(C, "TITLE_BLOCK", 4)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef gh") for _ in range(n)) for n in (0, 1, 3, 8, 20, 21, 60, 61, 62, 300, 5000)]
    titles = sorted({"".join(c for c in t if rng.random() > 0.04) for t in base for _ in range(6)} | set(base))
    df = spark.createDataFrame([(s, t) for s in (1, 2) for t in titles] + [(None, "x")], "scope int, title string")
    got = {(r.scope, r.title1, r.title2): r.ratio for r in C.near_titles(df, df, 85.0).collect()}
    want = {(s, a, b): C.indel_ratio(a, b) for s in (1, 2) for a in titles for b in titles if C.indel_ratio(a, b) >= 85}
    assert got == pytest.approx(want)


def test_search_results_by_id_before_title(spark):
    rows = [(1, 1, "arxiv", "X", "graph retrieval of papers"), (1, 2, "semantic-scholar", "", "graph retrieval of paper"), (1, 3, "arxiv", "X", "something else"), (1, 4, "arxiv", None, "Graph Retrieval of Paper"), (1, 5, "arxiv", None, None), (1, 6, "arxiv", None, ""), (None, 7, "arxiv", "X", "graph retrieval of paper")]
    df = spark.createDataFrame(rows, "scope int, result_id int, source string, arxiv_id string, title string")
    assert sorted(r.result_id for r in M.merge_search_results(df).collect()) == [2, 5, 7]  # 3 goes by the id of 1, although 1 goes by its title


def test_one_pass_search_equals_the_join(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(("graph", "Node", "x1", "the", "深度", "a-b")) for _ in range(n))
    q = spark.createDataFrame([(i, text(5)) for i in range(6)] + [(9, None), (10, "zzz")], "query_id long, question string")
    c = spark.createDataFrame([(f"c{i}", text(rng.randint(1, 40))) for i in range(120)] + [("e", ""), ("n", None)], "chunk_id string, content string").repartition(3)
    few = sorted(tuple(r) for r in L.lexical_branches(q, c, 7).collect())
    assert len(few) > 60
    monkeypatch.setattr(L, "MAX_ONE_PASS_TERMS", 0)
    joined = sorted(tuple(r) for r in L.lexical_branches(q, c, 7).collect())
    assert [r[:3] for r in joined] == [r[:3] for r in few] and [r[3] for r in joined] == pytest.approx([r[3] for r in few])
    monkeypatch.undo()
    assert L.lexical_top_k(q, c.limit(0)).count() == L.lexical_top_k(q.limit(0), c).count() == 0


def test_join_per_key(spark):
    rows = spark.createDataFrame([(i, 1 if i < 50 else i % 7 if i < 60 else None) for i in range(64)], "id int, k int")
    keys = spark.createDataFrame([(1, "a"), (3, "c"), (100, "z")], "k int, v string")
    got = {r.id: (r.k, r.v) for r in join_per_key(rows, keys, "k", hot=5).collect()}
    names = {1: "a", 3: "c"}
    assert got == {i: (k, names.get(k)) for i, k in ((i, 1 if i < 50 else i % 7 if i < 60 else None) for i in range(64))}


def test_fold_in_the_row_equals_the_fold_of_items(spark):
    rng = random.Random(4)
    docs = [(i, "\n".join("x" * rng.choice((0, 1, 20, 90, 300, 700)) + rng.choice(("", " ", "y")) for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(99, None), (98, ""), (97, " \n ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = df.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    rows = lambda d: sorted(tuple(r) for r in d.select("paper_id", "chunk_no", "text", "first_pos", "last_pos").collect())
    assert rows(G.fold_documents(df)) == rows(G.fold_chunks(items.withColumn("pos", F.col("pos").cast("long")))) != []


@pytest.mark.parametrize("worth, first", [(0, 2), (10**9, 2), (8, 64)])
@pytest.mark.parametrize("branch", sorted(L.SCORERS))
def test_postings_in_part_lose_no_question(monkeypatch, worth, first, branch):
    """The best k of every question, whether chunks add up all postings, read them in part, or choose."""
    monkeypatch.setattr(L, "WORTH", worth)
    monkeypatch.setattr(L, "FIRST_ORDER", first)
    rng, k = random.Random(worth), 4
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 6))) for _ in range(300)]
    text = lambda n: " ".join(words[int(300 * rng.random() ** 2)] for _ in range(n))
    chunks = pd.DataFrame({"chunk_id": [f"c{i:03}" for i in range(250)], "content": [text(rng.randint(0, 40)) for _ in range(249)] + [None]})
    token, keep, weight, factor, final, raw = L.SCORERS[branch]
    asked = [(q, t, n) for q in range(60) for t, n in Counter(text(rng.randint(1, 8)).split()).items()]
    terms = pd.DataFrame(asked, columns=["query_id", "token", "q_tf"])
    index = L._Index(terms, weight)
    got = pd.concat(L._one_pass({branch: (token, keep, index, factor, final, raw)}, k, 9)(iter([chunks.iloc[:100], chunks.iloc[100:]])))
    weights = dict(zip(zip(terms["query_id"], terms["token"]), weight(terms)))
    counts = [(c, Counter((t or "").split())) for c, t in zip(chunks["chunk_id"], chunks["content"])]
    for q in range(60):
        every = [(-round(final(s), 9), c) for c, n in counts if (s := sum(factor(n[t], n.total()) * w for (p, t), w in weights.items() if p == q and n[t]))]
        mine = sorted((-s, c) for s, c in zip(got[got["query_id"] == q]["score"], got[got["query_id"] == q]["chunk_id"]))
        assert [(round(s, 8), c) for s, c in mine[:k]] == [(round(s, 8), c) for s, c in sorted(every)[:k]]
        assert len(mine) < len(every) or len(every) <= k + 5


def test_common_lengths_of_many_pairs(monkeypatch):
    rng = random.Random(9)

    def changed(t, share):
        t = list(t)
        for _ in range(int(len(t) * share)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "日"])
        return "".join(t)

    a = ["".join(rng.choice("abcdé 日") for _ in range(rng.choice((0, 1, 40, 63, 64, 65, 130, 300)))) for _ in range(60)]
    b = [changed(rng.choice(a), rng.random() / 3) for _ in range(80)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(80)))
    ratio = np.array([C.indel_ratio(a[x], b[y]) for x, y in zip(i, j)])
    both = np.array([len(a[x]) + len(b[y]) for x, y in zip(i, j)])
    need = np.ceil(0.4 * both - 1e-6).astype(np.int64)
    want = np.where(ratio >= 80, np.round(ratio * both / 200), -1) * (both > 0)
    for words, at_once in ((16, 16_384), (16, 7), (1, 16_384)):
        monkeypatch.setattr(C, "MOST_WORDS", words)
        monkeypatch.setattr(C, "PAIRS_IN_STEP", at_once)
        assert np.array_equal(C.common_lengths(a, b, i, j, need) * (both > 0), want)


def run_batches(spark, tmp_path, parts, schema, make, mode):
    """Rows ``(batch, row)`` that a stream gives for each of some files, one a micro-batch."""
    out = []
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = []
        K.run_to_end(make(K.read_stream(spark, str(tmp_path / "in"), schema, 1000)), mode, str(tmp_path / "cp"), lambda df, i: got.extend(tuple(r) for r in df.collect()))
        out.append(got)
    return out


def test_transitions_go_on_over_micro_batches(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    parts = [[(1, 2, at(2), "running"), (1, 1, at(1), "queued"), (2, 3, at(1), "completed")], [(1, 4, at(5), "completed"), (1, 5, at(6), "queued"), (2, 6, at(9), "queued")]]
    got = run_batches(spark, tmp_path, parts, "job_id long, event_id long, ts timestamp, status string", K.live_transitions, "append")
    assert sorted(got[0]) == [(1, 1, "created", "queued", True), (1, 2, "queued", "running", True), (2, 3, "created", "completed", False)]
    assert sorted(got[1]) == [(1, 4, "running", "completed", True), (1, 5, "completed", "queued", False), (2, 6, "completed", "queued", False)]


def test_buffers_evict_by_number_and_age(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    parts = [[(1, i, at(i)) for i in range(6)] + [(2, 50, at(0)), (3, 60, None)], [(1, 6, at(6)), (2, 51, at(100))]]
    got = run_batches(spark, tmp_path, parts, "user_id long, event_id long, ts timestamp", lambda s: K.live_buffer(s, 4, 10), "update")
    assert sorted(got[0]) == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 50)] and sorted(got[1]) == [(1, 3), (1, 4), (1, 5), (1, 6), (2, 51)]


def test_intents_by_word_or_pattern(spark):
    want = {"YOLOv3和YOLOv4的区别": "compare", "从YOLOv1到YOLOv4的演进": "evolution", "总结一下这篇论文": "summary", "论文使用的方法是什么": "method", "实验结果怎么样": "results", "有代码实现吗": "code", "列出参考文献": "references", "什么是注意力机制": "question", "BERT和GPT哪个更好": "compare", "模型简介如下": "summary"}
    df = spark.createDataFrame([(q,) for q in want], "q string")
    assert {r.q: r.i for r in df.select("q", P.detect_intent(F.col("q")).alias("i")).collect()} == want


def test_metadata_filters(spark):
    want = {"2023年张三的关于注意力机制的论文": (2023, 2023, "张三", "注意力机制"), "深度学习相关": (None, None, None, "深度学习"), "author: Hinton 最近3年": (2021, 2024, "Hinton", None), "since 2018": (2018, None, None, None), None: (None,) * 4}
    df = spark.createDataFrame([(q,) for q in want], "q string")
    assert {r.q: tuple(r.m) for r in df.select("q", P.metadata_filters(F.col("q"), 2024).alias("m")).collect()} == want


def test_vectors_left_out(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0])], "vec_id int, embedding array<float>")
    report = {r.reason: r.n for r in V.write_vectors(df, str(tmp_path / "v"), 2).collect()}
    assert report == {"kept": 1, "no_embedding": 3, "wrong_dimension": 1} and [r.vec_id for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [1]


SF = "/root/testdata/sf0.001"


def first_lines(spark):
    return [(r.doc_id, r.text.split("\n")[0], r.source, r.lang, hashlib.md5(r.text.encode()).hexdigest()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_title_matches_of_the_whole_table_equal_brute_force(spark):
    docs, want = first_lines(spark), {}
    for i, a, s, *_ in docs:
        if i % 2:
            scored = [(-C.indel_ratio(a.lower(), b.lower()) * (1 if C.indel_ratio(s, t) > 70 else 0.85), j) for j, b, t, *_ in docs if j % 2 == 0 and C.indel_ratio(a.lower(), b.lower()) >= 85]
            best = min((x for x in scored if -x[0] >= 85), default=None)
            if best:
                want[i] = (best[1], round(-best[0], 9))
    got = {r.job_id: (r.paper_id, round(r.match_score, 9)) for r in QUERIES["fuzzy_title_match"](spark, SF).collect()}
    assert got == want and len(want) > 5


def test_merged_results_of_the_whole_table_equal_a_plain_loop(spark):
    scopes, want = {}, set()
    for i, title, source, lang, digest in first_lines(spark):
        scopes.setdefault((source, lang), []).append((i % 3 != 0, i, digest, title.lower()))
    for rows in scopes.values():
        ids, titles = set(), []
        for _, i, digest, title in sorted(rows):
            if digest in ids:
                continue
            ids.add(digest)
            if not any(C.indel_ratio(title, t) > 90 for t in titles):
                titles.append(title)
                want.add(i)
    assert {r.result_id for r in QUERIES["merge_search_results"](spark, SF).collect()} == want and len(want) > 100


def plain_linkage(unit, cutoff):
    """Average linkage by computing every mean distance anew."""
    clusters, d = [[i] for i in range(len(unit))], 1 - unit @ unit.T
    while len(clusters) > 1:
        mean, a, b = min((d[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
        if mean > cutoff:
            break
        clusters[a] += clusters.pop(b)
    return {frozenset(c) for c in clusters}


def test_clusters_and_trees_of_the_table_equal_plain_linkage(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {}
    for r in QUERIES["page_clusters"](spark, SF).collect():
        got.setdefault(r.group_id, {}).setdefault(r.cluster, []).append(r.vec_id)
    for group, clusters in got.items():
        ids = sorted(i for c in clusters.values() for i in c)
        unit = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
        assert {frozenset(c) for c in clusters.values()} == {frozenset(ids[i] for i in c) for c in plain_linkage(unit, 0.8)}
    tree = QUERIES["raptor_tree"](spark, SF).collect()
    for paper in {r.paper_id for r in tree}:
        leaves = {int(r.node[1:]): r.parent for r in tree if r.paper_id == paper and r.level == 0}
        ids = sorted(leaves)
        unit = np.array([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
        parts = {}
        for i, parent in leaves.items():
            parts.setdefault(parent, set()).add(i)
        want = {frozenset(ids[i] for i in c) for c in plain_linkage(unit, 0.9)}
        assert (set(map(frozenset, parts.values())) == want) if None not in parts else len(want) == len(ids)


def test_semantic_chunks_of_the_table_equal_a_plain_loop(spark):
    rows, got = {}, {}
    for r in frame(spark, SF, "chunks_v").collect():
        rows.setdefault(r.paper_id, []).append((r.pos, r.page_num, r.section.lower(), r.content))
    for r in QUERIES["chunk_semantic"](spark, SF).collect():
        got.setdefault(r.paper_id, []).append((r.chunk_no, r.section, r.page_start, r.page_end, r.words, r.text))
    assert got.keys() == rows.keys()
    for paper, items in rows.items():
        chunks = []
        for _, page, section, text in sorted(items):
            n = len(text.split())
            if chunks and len(chunks[-1][0].split()) < 40 and n < 50 and len(chunks[-1][0].split()) + n <= 600:
                chunks[-1] = (chunks[-1][0] + "\n\n" + text, section, chunks[-1][2], page)
            else:
                chunks.append((text, section, page, page))
        texts = []
        for text, *_ in chunks:
            texts.append(" ".join(texts[-1].split()[-6:]) + "\n\n" + text if texts else text)
        assert sorted(got[paper]) == [(i, s, a, b, len(t.split()), t) for i, ((_, s, a, b), t) in enumerate(zip(chunks, texts))]


def test_semantic_chunks_by_hand(spark):
    rows = [(1, 0, 1, "introduction", "w " * 30), (1, 1, 1, "methods", "Theorem 2 holds"), (1, 2, 2, "", "short figure"), (1, 3, 2, None, "x " * 60), (1, 4, 2, "results", " "), (1, 5, 3, "results", "y = 3"), (2, 0, 1, None, None)]
    df = spark.createDataFrame(rows, "paper_id int, pos int, page_num int, section string, text string")
    got = [(r.chunk_no, r.section, r.page_start, r.page_end, r.start, r.end, r.words, r.equations, r.figures, r.special) for r in G.chunk_semantic(df, overlap=2).orderBy("chunk_no").collect()]
    assert got == [
        (0, "introduction", 1, 1, 0, 60, 30, False, False, False), (1, "methods", 1, 1, 61, 76, 5, False, False, True), (2, "", 2, 2, 0, 12, 4, False, True, False),
        (3, "results", 2, 3, 13, 133, 65, False, False, False),
    ]
