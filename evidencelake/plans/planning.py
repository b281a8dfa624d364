"""Queries over the planning functions (F) and remaining reports (D, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidencelake.functions import planning as P, text as T
from evidencelake.operators import compare as M
from evidencelake.plans.registry import ORACLES, QUERIES, query
from evidencelake.plans.relational import q
from evidencelake.plans.understanding import CASE, FAMILY

MATCH = lambda col, patterns: "(" + " OR ".join(f"regexp_matches({col}, '{p}')" for p in patterns) + ")"


INTENT = "CASE " + " ".join("WHEN " + " OR ".join([f"contains(lower(question), '{w}')" for w in ws] + [f"regexp_matches(question, '(?i){p}')" for p in P.INTENT_PATTERNS.get(n, [])]) + f" THEN '{n}'" for ws, n in P.INTENTS) + " ELSE 'question' END"


@q("question_plans", f"""SELECT query_id, {INTENT} AS intent, {CASE('lower(question)', [(P.IMAGE_WORDS, 'image_weighted'), (P.TABLE_WORDS, 'table_weighted')], 'default')} AS modality,
CASE WHEN {MATCH('question', P.COMPLEX)} THEN 'complex' WHEN {MATCH('question', P.SIMPLE)} THEN 'simple' ELSE 'default' END AS complexity FROM questions_v""", "questions_v")
def question_plans(x):
    c = F.col("question")
    return x.select("query_id", P.detect_intent(c).alias("intent"), P.detect_modality(c).alias("modality"), P.complexity(c).alias("complexity"))


@q("query_budgets", f"""WITH f AS (SELECT query_id, {FAMILY} AS family, CASE p_size % 4 WHEN 0 THEN 'shallow' WHEN 1 THEN 'medium' WHEN 2 THEN 'deep' ELSE 'auto' END AS depth FROM questions_v)
SELECT query_id, CASE depth WHEN 'shallow' THEN 6 WHEN 'medium' THEN 10 WHEN 'deep' THEN 16 ELSE 12 END AS paper_top_k, CASE depth WHEN 'shallow' THEN 24 WHEN 'medium' THEN 40 WHEN 'deep' THEN 72 ELSE 180 END AS pool_max,
CASE WHEN family IN ('compare', 'cross_paper', 'survey', 'related_work', 'method_evolution', 'conflicting_evidence') THEN 80 ELSE 50 END AS graph_top_k, CASE WHEN family IN ('table', 'figure') THEN 80 ELSE 50 END AS caption_top_k, 120 AS lexical_top_k FROM f""", "questions_v")
def query_budgets(x):
    depth = F.when(F.col("p_size") % 4 == 0, "shallow").when(F.col("p_size") % 4 == 1, "medium").when(F.col("p_size") % 4 == 2, "deep").otherwise("auto")
    return P.query_plan(x.withColumns({"family": T.infer_query_family(F.col("question")), "depth": depth})).select("query_id", "paper_top_k", "pool_max", "graph_top_k", "caption_top_k", "lexical_top_k")


PLANNER = CASE("lower(question)", T.PLANNER_RULES, "fact")
ROLE_SQL = "CASE family " + " ".join(f"WHEN '{f}' THEN {r}" for f, r in P.ROLES.items()) + " ELSE ['fact_lookup'] END"


@q("sub_questions", f"WITH f AS (SELECT query_id, question, {PLANNER} AS family FROM questions_v), r AS (SELECT query_id, question, unnest({ROLE_SQL}) AS role FROM f) SELECT query_id, role, CASE WHEN role = 'fact_lookup' THEN trim(question) ELSE replace(role, '_', ' ') || ' for: ' || trim(question) END AS sub_question FROM r", "questions_v")
def sub_questions(x):
    return P.sub_questions(x.withColumn("family", T.planner_family(F.col("question"))))


@q("query_rewrites", f"""WITH f AS (SELECT query_id, lower(trim(question)) AS x, {PLANNER} AS family FROM questions_v) SELECT query_id, concat_ws('|', x || ' evidence results methods', x || ' experiments ablation', x || ' ' || CASE family {" ".join(f"WHEN '{f}' THEN '{w}'" for f, w in P.REWRITES.items())} END) AS rewrites FROM f""", "questions_v")
def query_rewrites(x):
    return x.select("query_id", F.array_join(P.rewrites(F.col("question"), T.planner_family(F.col("question"))), "|").alias("rewrites"))


@q("entity_hints", r"""SELECT query_id, array_to_string(list_filter(['accuracy', 'f1', 'auc', 'precision', 'recall', 'bleu', 'rouge'], lambda w: contains(lower(question), w)), ',') AS metrics, array_to_string(list_filter(['method', 'result', 'table', 'figure', 'ablation', 'baseline'], lambda w: contains(lower(question), w)), ',') AS objects,
len(list_distinct(regexp_extract_all(question, '\b([A-Z][A-Za-z0-9\-]{2,})\b', 1)[1:5])) AS methods FROM questions_v""", "questions_v")
def entity_hints(x):
    h = P.entity_hints(F.col("question"))
    return x.select("query_id", F.array_join(h["metrics"], ",").alias("metrics"), F.array_join(h["objects"], ",").alias("objects"), F.size(h["methods"]).alias("methods"))


@q("chunk_features", r"""SELECT chunk_id, CASE WHEN regexp_matches(lower(section), '\babstract\b') THEN 'Abstract' WHEN regexp_matches(lower(section), '\bintroduction\b') THEN 'Introduction' WHEN regexp_matches(lower(section), '\bmethodology\b') THEN 'Methods' WHEN regexp_matches(lower(section), '\bresults\b') THEN 'Results' WHEN page_num <= 2 THEN 'Introduction' ELSE 'Body' END AS page_section,
regexp_matches(content, '\b(Table|recall|accuracy)\b') AS high_value, substr('[Title: T' || paper_id || '] [Section: ' || section || '] [Page: ' || page_num || '] ' || content, 1, 90) AS contextual, md5('T | ' || section || ' | ' || content) AS compact FROM chunks_v""", "chunks_v")
def chunk_features(c):
    title = F.concat(F.lit("T"), F.col("paper_id").cast("string"))
    return c.select(
        "chunk_id", P.page_section(F.col("section"), F.col("page_num")).alias("page_section"), P.high_value(F.col("content")).alias("high_value"),
        P.contextual_text(title, F.col("section"), F.col("page_num"), F.col("content"), 90).alias("contextual"), F.md5(P.reranker_document(F.lit("T"), F.col("section"), F.col("content_type"), F.col("content"), True)).alias("compact"),
    )


@q("tool_risk", "SELECT CASE event_type WHEN 'view' THEN 'LOW' WHEN 'click' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' ELSE 'MEDIUM' END AS risk, count(*) AS n FROM events GROUP BY 1", "events")
def tool_risk(e):
    tool = F.when(F.col("event_type") == "view", "read_paper").when(F.col("event_type") == "click", "delete_paper").when(F.col("event_type") == "purchase", "upload_paper").otherwise("other")
    return e.groupBy(P.tool_risk(tool).alias("risk")).agg(F.count("*").alias("n"))


@q("confidence_level", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'low-confidence' WHEN event_id % 7 = 0 AND NOT event_id % 2 = 0 THEN 'low-confidence' WHEN user_id % 4 > 0 AND event_type <> 'view' THEN 'low-confidence' WHEN event_type = 'click' THEN 'medium-confidence' WHEN value > 50 OR user_id % 4 > 0 OR event_id % 7 = 0 THEN 'medium-confidence' ELSE 'high-confidence' END AS level FROM events""", "events")
def confidence_level(e):
    mode = F.when(F.col("event_type") == "error", "abstain").when(F.col("event_type") == "view", "full").when(F.col("event_type") == "click", "partial").otherwise("other")
    return e.select("event_id", P.confidence_level(mode, F.col("value") > 50, F.col("user_id") % 4, F.col("event_id") % 7 == 0, F.col("event_id") % 2 == 0).alias("level"))


_NAME = M.NAME_WORD.replace("'", "''")


def _dimension_sql(d: str) -> str:
    """``dimension_score`` of one dimension over sentences ``s`` in DuckDB."""
    has = lambda c, p, v=1.0: f"CASE WHEN regexp_matches({c}, '{p}') THEN {v} ELSE 0 END"
    good, bad = M.DIMENSIONS[d]
    hits = " + ".join([has("s", f"(?i){p}") for p in good] + [has("s", p) for n, p in M.FOR_NAMES.items() if n == d])
    if d == M.LOOSE:
        hits = f"CASE WHEN {hits} > 0 THEN {hits} ELSE {' + '.join(has('lower(s)', h) for h in M.SECTION_HINTS[d])} END"
    rest = " + ".join([has("s", f"(?i){p}", -1.1) for p in bad] + [has("s", f"(?i){p}", v) for n, p, v in M.BONUSES if n == d] + [has("lower(section)", "|".join(M.SECTION_HINTS[d]), 0.6)])
    named = f"len(list_filter(regexp_extract_all(s, '{_NAME}'), lambda w: regexp_matches(w, '^[A-Z]') OR lower(w) IN {M.SMALL_WORDS}))"
    names = f"(NOT regexp_matches(s, '{M.SENTENCE_MARK}') AND len(regexp_extract_all(s, '{_NAME}')) >= {M.NAME_WORDS} AND {named} / len(regexp_extract_all(s, '{_NAME}')) >= {M.NAME_SHARE})"
    weak = [M.WEAK[d]] if d in M.WEAK else []
    fit = f"length(s) >= {M.SHORTEST} AND NOT {names} AND NOT (length(s) >= {M.REFERENCE_LENGTH} AND regexp_matches(s, '{M.REFERENCE}'))" + "".join(f" AND NOT regexp_matches(s, '{p}')" for p in [*M.NO_EVIDENCE, *weak]) + ("" if d == M.LOOSE else f" AND {hits} > 0")
    return f"SELECT '{d}' AS dimension, max(CASE WHEN {fit} THEN 1.6 * ({hits}) + {rest} END)::DOUBLE AS score, chunk_id, paper_id FROM s GROUP BY chunk_id, paper_id HAVING score > 0"


DIM = "d AS (" + " UNION ALL ".join(_dimension_sql(d) for d in M.DIMENSIONS) + ")"
SENT = rf"s AS (SELECT paper_id, chunk_id, section, trim(regexp_replace(trim(unnest(string_split(regexp_replace(content, '([.!?;:])\s+', '\1' || chr(10), 'g'), chr(10)))), '{M.PREFIXES}', '')) AS s FROM chunks_v)"


@q("dimension_scores", f"WITH {SENT}, {DIM} SELECT paper_id, chunk_id, dimension, round(score, 6) AS score FROM d", "chunks_v")
def dimension_scores(c):
    return M.dimension_scores(c).select("paper_id", "chunk_id", "dimension", F.round("score", 6).alias("score"))


@q("compare_matrix", f"WITH {SENT}, {DIM}, b AS (SELECT paper_id, dimension, max(score) AS m FROM d WHERE score > 0 GROUP BY ALL), l AS (SELECT paper_id, dimension, CASE WHEN round(m, 9) >= 1.6 THEN 'full' ELSE 'partial' END AS l FROM b) SELECT p.paper_id, {', '.join(f'''coalesce(max(l) FILTER (dimension = '{d}'), 'none') AS \"{d}\"''' for d in M.DIMENSIONS)} FROM (SELECT DISTINCT paper_id FROM chunks_v) p LEFT JOIN l USING (paper_id) GROUP BY p.paper_id", "chunks_v")
def compare_matrix(c):
    return M.compare_matrix(c, c)


CELLS = f"""{DIM}, b AS (SELECT paper_id, dimension, arg_max(chunk_id, (round(score, 9), -chunk_id)) AS chunk_id FROM d WHERE score > 0 GROUP BY ALL), c AS (SELECT user_id AS query_id, p.paper_id, b.dimension, b.chunk_id FROM papers_v p LEFT JOIN b USING (paper_id)),
k AS (SELECT query_id, chunk_id, min(paper_id) AS paper_id, list_sort(list(DISTINCT dimension)) AS dimensions FROM c WHERE chunk_id IS NOT NULL GROUP BY ALL),
l AS (SELECT k.*, CASE WHEN quality >= 0.7 THEN 'supported' WHEN quality >= 0.4 THEN 'partially_supported' ELSE 'unsupported' END AS support_status FROM k LEFT JOIN chunks_v USING (chunk_id))"""


def _contract(p: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    scored = M.dimension_scores(c).where("score > 0").withColumn("score", F.round("score", 9))
    best = scored.groupBy("paper_id", "dimension").agg(F.max_by("chunk_id", F.struct("score", (-F.col("chunk_id")).alias("low"))).alias("chunk_id"))
    cells = p.select(F.col("user_id").alias("query_id"), "paper_id").join(best, "paper_id", "left")
    scores = p.select(F.col("user_id").alias("query_id"), "paper_id").join(c.select("paper_id", "chunk_id", F.col("quality").cast("double").alias("rerank_score")), "paper_id")
    return M.compare_contract(cells, scores)


@q("compare_blocks", f"WITH {SENT}, {CELLS} SELECT query_id, paper_id, chunk_id, array_to_string(dimensions, ',') AS dimensions, support_status FROM l", "papers_v", "chunks_v")
def compare_blocks(p, c):
    return _contract(p, c)[0].withColumn("dimensions", F.array_join("dimensions", ","))


@q("compare_answer_mode", f"WITH {SENT}, {CELLS}, n AS (SELECT query_id, count(*) AS blocks, count(*) FILTER (support_status = 'supported') AS supported FROM l GROUP BY 1) SELECT query_id, coalesce(blocks, 0) AS blocks, coalesce(supported, 0) AS supported, CASE WHEN blocks IS NULL THEN 'abstain' WHEN supported / blocks >= 0.8 THEN 'full' ELSE 'partial' END AS answer_mode FROM (SELECT DISTINCT user_id AS query_id FROM papers_v) LEFT JOIN n USING (query_id)", "papers_v", "chunks_v")
def compare_answer_mode(p, c):
    return _contract(p, c)[1]


@q("cross_paper_insights", f"WITH {SENT}, {DIM}, g AS (SELECT * FROM d WHERE score > 0), w AS (SELECT dimension, count(DISTINCT paper_id) AS papers FROM g GROUP BY 1 HAVING count(DISTINCT paper_id) >= 2) SELECT dimension, papers, row_number() OVER (PARTITION BY dimension ORDER BY round(score, 9) DESC, chunk_id) AS place, chunk_id FROM g JOIN w USING (dimension) QUALIFY place <= 3", "chunks_v")
def cross_paper_insights(c):
    return M.cross_paper_insights(M.dimension_scores(c).withColumn("score", F.round("score", 9)))


TOPICS = "(SELECT unnest(['" + "', '".join(M.TOPICS) + "']) AS dimension, unnest(['" + "', '".join(M.TOPICS.values()) + "']) AS topic)"


@q("compare_queries", f"""WITH p AS (SELECT paper_id, CASE WHEN starred THEN '' ELSE 'How do they rank?' END AS question, title FROM papers_v)
SELECT DISTINCT paper_id, dimension, CASE WHEN question <> '' THEN question || '. Focus on ' || topic || ' for these papers: ' || title || '.' ELSE 'Compare the papers ' || title || '. Retrieve evidence about ' || topic || '.' END AS query FROM p, {TOPICS}
UNION ALL SELECT paper_id, NULL, question FROM p WHERE question <> ''""", "papers_v")
def compare_queries(p):
    return M.compare_queries(p, F.when(F.col("starred"), "").otherwise("How do they rank?"))


query("compare_queries_all", ORACLES["compare_queries"])(QUERIES["compare_queries"])


@q("route_index", f"""WITH f AS (SELECT query_id, CASE p_size % 10 WHEN 0 THEN 'limitation' WHEN 1 THEN 'evolution' WHEN 2 THEN 'other' ELSE {FAMILY} END AS family FROM questions_v),
r(fam, index_type, priority, content_types, section_hint, k_factor) AS (VALUES ('fact', 'local_evidence', 1, '', NULL, 1.0), ('fact', 'structural', 2, '', NULL, 1.0), ('compare', 'structural', 1, '', NULL, 1.5), ('compare', 'local_evidence', 2, '', NULL, 1.0), ('numeric', 'local_evidence', 1, 'table,text', 'Results', 1.0), ('numeric', 'structural', 2, '', NULL, 1.0),
('table', 'local_evidence', 1, 'table', NULL, 1.0), ('table', 'local_evidence', 2, 'text', NULL, 1.0), ('figure', 'local_evidence', 1, 'image', NULL, 1.0), ('figure', 'local_evidence', 2, 'text', NULL, 1.0), ('survey', 'summary', 1, '', NULL, 2.0), ('survey', 'local_evidence', 2, '', NULL, 1.0),
('evolution', 'summary', 1, '', NULL, 2.0), ('evolution', 'structural', 2, '', NULL, 1.0), ('evolution', 'local_evidence', 3, '', NULL, 1.0), ('limitation', 'local_evidence', 1, '', 'Discussion', 1.0), ('limitation', 'structural', 2, '', NULL, 1.0), ('none', 'local_evidence', 1, '', NULL, 1.0))
SELECT query_id, family, index_type, priority, content_types, section_hint, CAST(k_factor AS DOUBLE) AS k_factor, family IN ('fact', 'compare', 'survey', 'evolution', 'limitation') AS citation_hints FROM f JOIN r ON fam = CASE WHEN family IN (SELECT fam FROM r) THEN family ELSE 'none' END""", "questions_v")
def route_index(x):
    family = F.when(F.col("p_size") % 10 == 0, "limitation").when(F.col("p_size") % 10 == 1, "evolution").when(F.col("p_size") % 10 == 2, "other").otherwise(T.infer_query_family(F.col("question")))
    return P.route_index(x.select("query_id", family.alias("family"))).withColumn("content_types", F.array_join("content_types", ","))


@q("route_task", f"""WITH f AS (SELECT query_id, {FAMILY} AS family, p_size % 6 = 0 AS r FROM questions_v), k AS (SELECT *, family IN ('cross_paper', 'survey', 'related_work', 'method_evolution', 'conflicting_evidence', 'hard') AS g FROM f)
SELECT query_id, family, CASE WHEN family IN ('fact', 'numeric') THEN 'single_paper_fact' WHEN family = 'method' THEN 'single_paper_method' WHEN family IN ('table', 'figure') THEN 'single_paper_table_figure' WHEN family = 'method_evolution' THEN 'cross_paper' ELSE family END AS task_family,
CASE WHEN r THEN 'truthfulness_repair' WHEN g THEN 'global_review' WHEN family = 'compare' THEN 'local_compare' ELSE 'local_evidence' END AS execution_mode, CASE WHEN r THEN 'focused' WHEN g THEN 'deep' WHEN family IN ('fact', 'numeric') THEN 'shallow' ELSE 'medium' END AS depth,
CASE WHEN NOT r AND (g OR family = 'compare') THEN 'pro' ELSE 'flash' END AS model_policy, CASE WHEN r THEN 'truthfulness_kernel' WHEN g THEN 'global_kernel' WHEN family = 'compare' THEN 'dual_kernel' ELSE 'local_kernel' END AS kernel_scope, CASE WHEN r THEN 'repair_loop' WHEN g THEN 'storm_lite' WHEN family = 'compare' THEN 'matrix_first' ELSE 'citation_first' END AS review_strategy,
CASE WHEN r THEN 'focused_claim_repair' WHEN family IN ('fact', 'numeric') THEN 'fixed_depth' ELSE 'adaptive_depth' END AS routing_policy, r OR family NOT IN ('table', 'figure') AS truthfulness_required, g AND NOT r AS global_synthesis, 'rarr_cove_scifact_lite' AS verifier FROM k""", "questions_v")
def route_task(x):
    return P.route_task(x.select("query_id", T.infer_query_family(F.col("question")).alias("family"), (F.col("p_size") % 6 == 0).alias("claim_repair")))


@q("family_breakdown", f"""WITH f AS (SELECT query_id, {FAMILY} AS family FROM questions_v), m AS (SELECT query_id, round(avg(score), 6) AS r, round(avg(vector_score), 6) AS n, bool_or(page_num = 1) AS p, bool_or(branch = 'dense') AS c FROM hits_v GROUP BY 1)
SELECT coalesce(family, 'fact') AS family, count(*) AS queries, round(avg(r), 5) AS recall_10, round(avg(n), 5) AS ndcg, round(avg(p::INT), 5) AS paper_hit, round(avg(c::INT), 5) AS chunk_hit FROM m LEFT JOIN f USING (query_id) GROUP BY 1""", "hits_v", "questions_v")
def family_breakdown(h, x):
    from evidencelake.operators.usage import family_breakdown as breakdown

    m = h.groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("recall_10"), F.round(F.avg("vector_score"), 6).alias("ndcg"), F.bool_or(F.col("page_num") == 1).cast("int").alias("paper_hit"), F.bool_or(F.col("branch") == "dense").cast("int").alias("chunk_hit"))
    out = breakdown(m, x.select("query_id", T.infer_query_family(F.col("question")).alias("family")))
    return out.select("family", "queries", *[F.round(c, 5).alias(c) for c in ("recall_10", "ndcg", "paper_hit", "chunk_hit")])


@q("citation_order", "SELECT src, dst, CAST(a.pub_year AS INT) AS src_year, CAST(b.pub_year AS INT) AS dst_year FROM edges_v JOIN papers_v a ON a.paper_id = src JOIN papers_v b ON b.paper_id = dst WHERE a.pub_year < b.pub_year", "edges_v", "papers_v")
def citation_order(e, p):
    return M.citation_order(e, p.select("paper_id", F.col("pub_year").alias("year")))


@q("version_timeline", r"WITH v AS (SELECT query_id AS paper_id, p_size % 3 AS method, 2000 + p_size AS year, CAST(regexp_extract(lower(question), '\bv(\d+)\b', 1) AS INT) AS version FROM questions_v WHERE regexp_matches(lower(question), '\bv\d+\b')) SELECT method, paper_id, year, version, version - lag(version) OVER (PARTITION BY method ORDER BY year, version, paper_id) AS step FROM v", "questions_v")
def version_timeline(x):
    return M.version_timeline(x.select(F.col("query_id").alias("paper_id"), (F.col("p_size") % 3).alias("method"), (F.col("p_size") + 2000).alias("year"), F.col("question").alias("title")))


@q("merge_search_results", None, "documents")
def merge_search_results(d):
    first = d.select(F.concat_ws("/", "source", "lang").alias("scope"), F.col("doc_id").alias("result_id"), F.when(F.col("doc_id") % 3 == 0, "semantic-scholar").otherwise("arxiv").alias("source"), F.md5("text").alias("arxiv_id"), F.substring_index("text", "\n", 1).alias("title"))
    return M.merge_search_results(first)
