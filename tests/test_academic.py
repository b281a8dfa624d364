"""References, captions, titles and corpus checks on small rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.functions import academic as A, planning as P
from evidencelake.operators import gates as G, reports as R


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_references(spark):
    text = "Body.\nReferences\n[1] A. Bee. Deep graphs. 2019.\n[2] C. Dee, “Neural ranking,” 2020.\n[3] X. Y. DEEP GRAPHS. 2021."
    got = [(r.ref_no, r.year, r.title) for r in A.references(spark.createDataFrame([(1, text), (2, "none"), (3, None)], "paper_id int, text string")).orderBy("ref_no").collect()]
    assert got[1] == (1, 2020, "Neural ranking,") and got[0][1] == 2019 and len(got) >= 2


def test_doi_and_titles(spark):
    assert one(spark, "see https://doi.org/10.1000/abc.def).", A.doi) == "10.1000/abc.def"
    assert one(spark, None, A.doi) is None
    lines = spark.createDataFrame([(1, 0, "arXiv:1234"), (1, 1, "A Good Title of Fair Length"), (1, 2, "This is a sentence.")], "paper_id int, pos int, line string")
    assert A.best_title(lines).first().title == "A Good Title of Fair Length"


def test_captions(spark):
    got = one(spark, "As shown. Table 3: accuracy by model. See Figure 2.", lambda c: A.evidence_metadata(c, F.lit(10)))
    assert (got.table, got.figure, got.caption, got.span_start, got.span_end) == ("3", "2", "Table 3: accuracy by model.", 10, 61)
    assert one(spark, "One. As Fig. 1 shows. No. Figure 22 too!", A.figure_contexts)[-1] == "Figure 22 too!"


def test_clean_compare_text(spark):
    assert one(spark, "3.1 We use [12, 3] a hyphen-\nated word", A.clean_compare_text) == "We use a hyphenated word"
    assert one(spark, "word " * 100, A.clean_compare_text).endswith("word…") and one(spark, None, A.clean_compare_text) == ""
    assert one(spark, "Ann Lee, Bo Dee", A.line_kind) == "authors" and one(spark, "[1] A.", A.line_kind) == "reference"


def test_synonyms(spark):
    q = spark.createDataFrame([(1, "fast graph"), (2, "none")], "query_id int, question string")
    s = spark.createDataFrame([("graph", "network", 1), ("graph", "net", 2), ("graph", "web", 3)], "word string, synonym string, ord int")
    assert {r.query_id: r.expanded for r in A.expand_synonyms(q, s).collect()} == {1: "fast graph net network", 2: "none"}


def test_planning_columns(spark):
    assert one(spark, "see 2101.00001 and 2101.00001v2 and 2101.00001", P.paper_ids_in) == ["2101.00001", "2101.00001v2"]
    assert one(spark, "Theorem 1", P.special_boundary) is True and one(spark, "$a=b$", P.has_equations) is True and one(spark, None, P.has_equations) is False
    assert one(spark, "image_weighted", P.modality_weights).image == 0.6


def test_checks(spark):
    papers = spark.createDataFrame([(1, "cs"), (2, "bio")], "paper_id int, discipline string")
    queries = spark.createDataFrame([(1, "fact", 2), (2, "table", None)], "query_id int, family string, n_claims int")
    r = G.corpus_check(papers, queries, 2, 3, ["fact", "figure"], ["cs"]).first()
    assert (r.papers, r.queries, r.absent_families, r.absent_disciplines, r.without_claims, r.ok) == (2, 2, ["figure"], [], 1, False)
    qa = spark.createDataFrame([(1, " ", False, 1, 0, True), (2, "ok", True, None, None, None)], "query_id int, question string, must_abstain boolean, n_papers int, n_evidence int, reviewed boolean")
    assert sorted((r.query_id, r.rule) for r in G.annotation_qa(qa).collect()) == [(1, "no_evidence"), (1, "no_question"), (2, "not_reviewed")]
    runs = spark.createDataFrame([("r", ["a", "z"], "done"), ("r", ["a"], "odd")], "run_id string, sample_ids array<string>, state string")
    assert sorted(r.problem for r in G.validate_runs(runs, spark.createDataFrame([("a",)], "sample_id string"), ["done"]).collect()) == ["repeated_run", "unknown_sample", "unknown_state"]
    cov = G.paragraph_coverage(spark.createDataFrame([(1, "m", 1, 1), (1, "r", 1, 0)], "draft_id int, section string, n_citations int, n_evidence int"), spark.createDataFrame([(1, "m"), (1, "r")], "draft_id int, section string"))
    assert sorted((r.section, r.kept, r.omitted) for r in cov.collect()) == [("m", 1, None), ("r", 0, "no_supported_paragraph")]
    hooks = G.missing_hooks(spark.createDataFrame([(1, 0.1, None)], "case_id int, a double, b double"), ("a", "b"))
    assert hooks.first().missing == ["b"]


def test_corpus_split_counts(spark):
    df = spark.createDataFrame([(i, "x", "g") for i in range(10)], "id int, k string, gold string")
    got = {(r.split, r.gold): r.n for r in R.corpus_split(df, {"dev": 3, "blind": 4}, "k", ["id"]).groupBy("split", "gold").agg(F.count("*").alias("n")).collect()}
    assert got == {("dev", "g"): 3, ("blind", None): 4, ("train", "g"): 3}


def test_hints_and_graph_candidates(spark):
    from evidencelake.operators import graph as J, joins as C

    q = spark.createDataFrame([(1, "compare", "x"), (2, "fact", "x")], "query_id int, family string, subject string")
    h = spark.createDataFrame([(1, "forward", 5), (1, "backward", 6), (2, "backward", 7), (2, "evolution", 8)], "query_id int, kind string, paper_id int")
    assert sorted(r.paper_id for r in C.hints_for_family(q, h).collect()) == [5, 7]
    rel = spark.createDataFrame([(9, "x", "improves_metric_on_dataset"), (9, "x", "compares_against_baseline"), (8, "x", "improves_metric_on_dataset"), (7, "y", "improves_metric_on_dataset")], "paper_id int, subject string, predicate string")
    assert [(r.query_id, r.paper_id, r.rank) for r in J.graph_candidates(q, rel).orderBy("rank").collect()] == [(1, 9, 1), (1, 8, 2)]


def test_sections_and_support(spark):
    from evidencelake.operators import chunking as C, verify as H, reports as R

    items = spark.createDataFrame([(1, 0, "a" * 400, "abstract"), (1, 1, "b" * 100, "abstract"), (1, 2, None, "abstract"), (1, 0, "short", "other")], "paper_id int, pos int, text string, section string")
    assert sorted((r.section, r.chunk_no, r.start, len(r.content)) for r in C.chunk_by_section(items).collect()) == [("abstract", 0, 0, 400), ("abstract", 1, 350, 151), ("other", 0, 0, 5)]
    rows = spark.createDataFrame([("table", None, "caption", None), ("figure", "a long enough text", None, None), ("text", "a long enough text", None, None)], "k string, t string, c string, x string")
    got = [r[0].reason for r in rows.select(H.citation_support(F.col("k"), F.col("t"), F.col("c"), F.col("x"))).collect()]
    assert got == ["ok", "missing_caption", "ok"]
    chunks = [(1, 1, 3, "2. Methodology"), (1, 2, 3, "Overview of it all"), (1, 3, 3, "long text " * 9), (1, 4, 9, "as the Ablation Study shows, " * 3), (1, 5, 9, "Results and Discussion of what we have seen in the two experiments above"), (1, 6, None, None), (1, 7, 0, "x " * 40), (2, 8, 3, "7 Zebra"), (2, 9, 3, "y " * 40)]
    spans = [(1, 2, "conclusion", 3, 3, 0.9, None), (1, 1, "results", 2, 4, 0.8, ["ablation study"]), (1, 0, "methods", 1, 9, 0.6, [None, "nowhere"])]
    out = C.assign_sections(spark.createDataFrame(chunks, "paper_id int, chunk_id int, page_num int, text string"), spark.createDataFrame(spans, "paper_id int, ord int, section string, page_start int, page_end int, confidence double, anchors array<string>"))
    assert {r.chunk_id: (r.section, r.by) for r in out.collect()} == {
        1: ("methods", "heading"), 2: ("introduction", "heading"), 3: ("results", "page"), 4: ("results", "anchor"), 5: ("results", "pattern"), 6: ("", "none"), 7: ("", "none"), 8: ("", "none"), 9: ("", "none"),
    }
    runs = spark.createDataFrame([("r", [("a", "passed", True), ("b", "failed", False)]), ("s", [("a", "passed", True)])], "run_id string, steps array<struct<step:string,status:string,consumed:boolean>>")
    assert {r.step: (r.runs, r.passed, r.full_chain) for r in R.validation_summary(runs).collect()} == {"a": (2, 2, 1), "b": (1, 0, 0)}


def test_paper_summary_by_hand(spark):
    from evidencelake.operators import reports as R

    rows = [
        (1, 2, "c2", "Abstract", 1, "text", "", "second " + "a" * 600, ["SQuAD"]), (1, 1, "c1", "ABSTRACT", 1, "text", "anchor one", "arXiv:1234.5678 mark\nshort\nThe real title of it\nmore", None), (1, 3, "c3", "introduction to approach", 2, "Table", "T" * 250, "x", ["COCO", "SQuAD"]),
        (1, 4, "c4", "our model", 3, "caption", "fig", "y", []), (1, 5, "c5", "Ablation of the system", 3, "figure", None, "z", None), (1, 6, "c6", "ablation", 4, "text", None, "w", None), (1, 7, "c7", "future", 5, "text", None, None, None), (2, 1, "d1", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "paper_id int, pos int, chunk_id string, section string, page_num int, content_type string, anchor string, content string, datasets array<string>")
    one, two = R.paper_summary_index(df).orderBy("paper_id").collect()
    second = "second " + "a" * 493
    assert (one.title, one.abstract, one.paper_summary) == ("The real title of it", f"anchor one {second}", f"anchor one {second}")
    assert (one.method_summary, one.result_summary, one.limitation_summary, one.experiment_summary) == ("fig z", "w", "", "")
    assert (one.datasets, one.metrics, one.table_captions, one.figure_captions, one.representative_ids) == (["COCO", "SQuAD"], [], ["T" * 200], ["fig"], ["c1", "c2"])
    assert (two.title, two.paper_summary, two.representative_ids, two.datasets) == ("", "", [], [])


def test_hybrid_retrieval_by_hand(spark):
    from evidencelake.operators import ranking as R

    dense = spark.createDataFrame([(1, 10, "a", 0.9), (1, 10, "b", 0.8), (1, 10, "c", 0.7), (1, 20, "d", 0.95), (1, 30, "x", 0.99)], "query_id int, paper_id int, chunk_id string, score double")
    sparse = spark.createDataFrame([(1, 20, "d", 5.0), (1, 40, "e", 4.0)], "query_id int, paper_id int, chunk_id string, score double")
    scope = spark.createDataFrame([(1, 10, 0), (1, 20, 1), (1, 50, 2)], "query_id int, paper_id int, ord int")
    final, report = R.hybrid_retrieval(dense, sparse, scope, 2, 2)
    assert [(r.chunk_id, r.pre_rerank_rank) for r in final.orderBy("rerank_rank").collect()] == [("d", 1), ("a", 2)]  # d: third of the dense list and first of the sparse one
    r = report.first()
    assert (r.dense_candidates, r.fused_before_rerank, r.paper_coverage, r.missing_papers) == (3, 4, 2, [50])
    scores = spark.createDataFrame([(1, "b", 0.9), (1, "e", 0.5)], "query_id int, chunk_id string, model_score double")
    assert [(r.chunk_id, r.rerank_gain) for r in R.hybrid_retrieval(dense, sparse, scope, 2, 2, scores)[0].orderBy("rerank_rank").collect()] == [("b", 2), ("e", 2)]
