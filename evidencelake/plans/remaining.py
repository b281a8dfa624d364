"""Queries of operators that had tests but no query of their own (B, C, D, F, G, H, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.functions import academic as A, planning as P
from evidencelake.operators import chunking as G, filters as B, gates as GA, graph as J, joins as C, models as M, ranking as K, reports as R, verify as H
from evidencelake.plans.relational import q


@q("validate_ids", r"SELECT p_partkey AS id, coalesce(regexp_full_match(p_brand, '[A-Za-z0-9_.:/-]+') AND length(p_brand) <= 128, false) AS as_paper, coalesce(regexp_full_match(p_type || ' ' || p_size, '[\p{L}\p{N}_.:/ -]+'), false) AS as_section, regexp_full_match(p_type || '/' || p_size, '[A-Za-z0-9_.:/-]+') AS as_chunk FROM part", "part")
def validate_ids(p):
    return p.select(F.col("p_partkey").alias("id"), B.valid_id(F.col("p_brand"), "paper").alias("as_paper"), B.valid_id(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")), "section").alias("as_section"), B.valid_id(F.concat_ws("/", "p_type", F.col("p_size").cast("string")), "user").alias("as_chunk"))


@q("normalize_handoff", "SELECT CAST(paper_id AS STRING) AS paper_id, CAST(chunk_id AS STRING) AS source_chunk_id, CASE WHEN page_num = 1 THEN section END AS claim FROM hits_v WHERE branch <> 'graph' OR page_num = 2", "hits_v")
def normalize_handoff(h):
    graph = F.col("branch") == "graph"
    return B.normalize_handoff(h.select(
        F.when(~graph, F.col("paper_id")).alias("paper_id"), F.when(graph & (F.col("page_num") == 2), F.col("paper_id")).alias("paperId"), F.when(F.col("page_num") > 2, F.col("chunk_id")).alias("source_chunk_id"),
        F.lit("").alias("sourceChunkId"), F.col("chunk_id").alias("chunkId"), F.when(F.col("page_num") == 1, F.col("section")).alias("claimText"),
    ))


@q("clean_display_metadata", """WITH p AS (SELECT *, CASE WHEN paper_id % 5 = 0 THEN ' Unknown ' WHEN paper_id % 5 = 1 THEN '' ELSE title || '.PDF' END AS t, CASE WHEN paper_id % 10 = 0 THEN '' ELSE 'file_' || paper_id || '.pdf' END AS f FROM papers_v)
SELECT paper_id, CASE WHEN paper_id % 5 > 1 THEN title WHEN f = '' THEN 'Untitled paper' ELSE 'file ' || paper_id END AS title, author || '|Bo' AS authors, CASE WHEN starred THEN NULL ELSE CAST(pub_year AS INT) END AS year, CASE WHEN venue <> '' THEN venue END AS venue FROM p""", "papers_v")
def clean_display_metadata(p):
    k = F.col("paper_id") % 5
    raw = p.select(
        "paper_id", F.when(k == 0, " Unknown ").when(k == 1, "").otherwise(F.concat("title", F.lit(".PDF"))).alias("title"), F.when(F.col("paper_id") % 10 == 0, "").otherwise(F.concat(F.lit("file_"), F.col("paper_id").cast("string"), F.lit(".pdf"))).alias("filename"),
        F.array(F.col("author"), F.lit("x"), F.lit(" Bo "), F.lit("et al."), F.upper("author"), F.lit("a@b.org")).alias("authors"), F.when(F.col("starred"), 1492).otherwise(F.col("pub_year")).cast("int").alias("year"), "venue",
    )
    return B.clean_display_metadata(raw).select("paper_id", "title", F.array_join("authors", "|").alias("authors"), "year", "venue")


@q("hints_for_family", """WITH k AS (SELECT query_id, CASE branch WHEN 'dense' THEN 'forward' WHEN 'sparse' THEN 'evolution' WHEN 'graph' THEN 'same_method' END AS kind, chunk_id AS paper_id, CASE query_id % 4 WHEN 0 THEN 'compare' WHEN 1 THEN 'fact' WHEN 2 THEN 'survey' ELSE 'other' END AS family FROM hits_v)
SELECT query_id, kind, paper_id, family FROM k WHERE (kind = 'forward' AND family IN ('fact', 'compare')) OR (kind = 'evolution' AND family = 'survey') OR (kind = 'same_method' AND family = 'compare')""", "hits_v")
def hints_for_family(h):
    kind = F.when(F.col("branch") == "dense", "forward").when(F.col("branch") == "sparse", "evolution").otherwise("same_method")
    r = F.col("query_id") % 4
    queries = h.select("query_id").distinct().withColumn("family", F.when(r == 0, "compare").when(r == 1, "fact").when(r == 2, "survey").otherwise("other"))
    return C.hints_for_family(queries, h.select("query_id", kind.alias("kind"), F.col("chunk_id").alias("paper_id"))).select("query_id", "kind", "paper_id", "family")


@q("validation_summary", """WITH r AS (SELECT event_id, event_type <> 'error' AS a, user_id % 3 > 0 AS c FROM events), s AS (SELECT 'search' AS step, a AS passed, true AS consumed, a AND c AS whole FROM r UNION ALL SELECT 'answer', true, c, a AND c FROM r)
SELECT step, count(*) AS runs, count(*) FILTER (passed) AS passed, count(*) FILTER (consumed) AS consumed, count(*) FILTER (whole) AS full_chain FROM s GROUP BY 1""", "events")
def validation_summary(e):
    step = lambda name, ok, used: F.struct(F.lit(name).alias("step"), F.when(ok, "passed").otherwise("failed").alias("status"), used.alias("consumed"))
    runs = e.select(F.col("event_id").alias("run_id"), F.lit("done").alias("state"), F.array(step("search", F.col("event_type") != "error", F.lit(True)), step("answer", F.lit(True), F.col("user_id") % 3 > 0)).alias("steps"))
    return R.validation_summary(runs)


@q("expand_synonyms", r"""WITH w AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(question), '[^a-z0-9_]+')) AS word FROM questions_v), s(word, synonym) AS (VALUES ('compare', 'contrast'), ('compare', 'versus'), ('methods', 'approaches'), ('accuracy', 'precision'), ('limitations', 'weaknesses')),
m AS (SELECT query_id, string_agg(DISTINCT synonym, ' ' ORDER BY synonym) AS more FROM w JOIN s USING (word) GROUP BY 1) SELECT query_id, concat_ws(' ', question, more) AS expanded FROM questions_v LEFT JOIN m USING (query_id)""", "questions_v")
def expand_synonyms(x):
    rows = [("compare", "contrast", 1), ("compare", "versus", 2), ("compare", "third", 3), ("methods", "approaches", 1), ("accuracy", "precision", 1), ("limitations", "weaknesses", 1)]
    table = F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(s).alias("synonym"), F.lit(o).alias("ord")) for w, s, o in rows]))
    return A.expand_synonyms(x, x.sparkSession.range(1).select(table))


@q("paper_ids_in_query", "SELECT query_id, CASE WHEN query_id % 2 = 0 THEN (1000 + query_id % 9000) || '.12345' || CASE WHEN query_id % 3 = 0 THEN 'v2' ELSE '' END ELSE '' END AS ids FROM questions_v", "questions_v")
def paper_ids_in_query(x):
    one = F.concat((F.col("query_id") % 9000 + 1000).cast("string"), F.lit(".12345"), F.when(F.col("query_id") % 3 == 0, "v2").otherwise(""))
    asked = F.when(F.col("query_id") % 2 == 0, F.concat("question", F.lit(" in "), one, F.lit(" and "), one, F.lit("?"))).otherwise(F.col("question"))
    return x.select("query_id", F.array_join(P.paper_ids_in(asked), ",").alias("ids"))


@q("text_marks", r"""SELECT chunk_id, regexp_matches(content, '\$[^$]+\$|[=≈≤≥]\s*[-\d\\]') AS equations, regexp_matches(content, '(?i)^\s*(?:\d+[.)]\s|theorem\b|definition\b)') AS special, nullif(regexp_extract(content, '(?i)\btable\s*(\d+)', 1), '') AS table_no, nullif(regexp_extract(content, '(?i)((?:table|fig(?:ure)?\.?)\s*\d+[:.][^.]*\.?)', 1), '') AS caption, pos * 10 + length(content) AS span_end
FROM (SELECT chunk_id, pos, CASE pos % 3 WHEN 0 THEN 'Theorem 1. ' WHEN 1 THEN 'with n = ' || pos || ' and $x$: ' ELSE '' END || content AS content FROM chunks_v)""", "chunks_v")
def text_marks(c):
    more = F.when(F.col("pos") % 3 == 0, "Theorem 1. ").when(F.col("pos") % 3 == 1, F.concat(F.lit("with n = "), F.col("pos").cast("string"), F.lit(" and $x$: "))).otherwise("")
    t = F.concat(more, F.col("content"))
    m = A.evidence_metadata(t, F.col("pos") * 10)
    return c.select("chunk_id", P.has_equations(t).alias("equations"), P.special_boundary(t).alias("special"), m["table"].alias("table_no"), m["caption"].alias("caption"), m["span_end"].alias("span_end"))


@q("table_rows", """WITH t AS (SELECT l_orderkey AS table_id, l_linenumber AS n, l_quantity::INT AS qty, l_returnflag AS flag FROM lineitem), r AS (SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY n, '| ' || qty || ' | ' || flag || ' |') AS row_no, qty, flag FROM t) SELECT table_id, CAST(row_no AS INT) AS row_no, CAST(qty AS VARCHAR) AS qty, flag FROM r""", "lineitem")
def table_rows(li):
    row = F.concat(F.lit("| "), F.col("l_quantity").cast("int").cast("string"), F.lit(" | "), "l_returnflag", F.lit(" |"))
    body = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x.r)
    tables = li.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.concat(F.lit("| qty | flag |\n|---|---|\n"), F.array_join(body, "\n")).alias("markdown"))
    return G.table_rows(tables).select("table_id", "row_no", F.col("cells")["qty"].alias("qty"), F.col("cells")["flag"].alias("flag"))


@q("figure_contexts", "SELECT chunk_id, CASE WHEN pos % 2 = 0 THEN 'As Figure ' || pos || ' shows, it grows.|See fig. 9!' ELSE '' END AS contexts FROM chunks_v", "chunks_v")
def figure_contexts(c):
    said = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("Before. As Figure "), F.col("pos").cast("string"), F.lit(" shows, it grows. See fig. 9! Then the end.")))
    return c.select("chunk_id", F.array_join(A.figure_contexts(said), "|").alias("contexts"))


@q("clean_compare_text", "SELECT chunk_id, CASE WHEN length(content) <= 40 THEN content ELSE regexp_replace(substr(content, 1, 40), '\\s+\\S*$', '') || '…' END AS cleaned FROM chunks_v", "chunks_v")
def clean_compare_text(c):
    raw = F.concat(F.lit(" 2.1 "), F.concat_ws("  [3, 4] \n", F.substring_index("content", " ", 2), F.expr("substr(content, length(substring_index(content, ' ', 2)) + 2)")))
    return c.select("chunk_id", A.clean_compare_text(raw, 40).alias("cleaned"))


@q("references", """SELECT o_orderkey AS paper_id, i AS ref_no, 1990 + i AS year, 'Title ' || i || ' of ' || o_orderpriority AS title FROM orders, (SELECT unnest([0, 1]) AS i)""", "orders")
def references(o):
    item = lambda i, t: F.concat(F.lit(f"[{i + 1}] A. Author, "), F.lit('"'), t, F.lit(f'", venue {1990 + i}.\n'))
    title = lambda i: F.concat(F.lit(f"Title {i} of "), "o_orderpriority")
    text = F.concat(F.lit("Body text.\nReferences\n"), item(0, title(0)), item(1, title(1)), item(2, F.upper(title(0))))
    return A.references(o.select(F.col("o_orderkey").alias("paper_id"), text.alias("text"))).select("paper_id", "ref_no", "year", "title")


@q("best_title", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), e AS (SELECT doc_id, x[i + 1] AS line, i AS pos FROM l, unnest(range(0, len(x))) AS u(i)), t AS (SELECT *, trim(line, ' ') AS tr FROM e),
s AS (SELECT *, greatest(0, 10 - pos) + CASE WHEN length(tr) BETWEEN 20 AND 150 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(tr, '^[A-Z]') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(tr, '[.!?]$') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(line, '@|https?://') OR regexp_matches(lower(line), 'university|arxiv') THEN 8 ELSE 0 END AS s FROM t)
SELECT doc_id AS paper_id, md5(arg_max(line, s * 1000000 - pos)) AS title FROM s GROUP BY 1""", "documents")
def best_title(d):
    lines = d.where("text is not null").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return A.best_title(lines).select("paper_id", F.md5("title").alias("title"))


@q("chunk_by_section", """WITH p(section, size, overlap) AS (VALUES ('abstract', 400, 50), ('introduction', 1000, 120), ('methods', 800, 150), ('results', 650, 100), ('other', 500, 100)), i AS (SELECT paper_id % 50 AS paper_id, CASE pos % 5 WHEN 0 THEN 'abstract' WHEN 1 THEN 'introduction' WHEN 2 THEN 'methods' WHEN 3 THEN 'results' ELSE 'other' END AS section, paper_id * 10 + pos AS pos, content FROM chunks_v),
w AS (SELECT paper_id, section, string_agg(content, chr(10) ORDER BY pos) AS whole FROM i GROUP BY ALL), c AS (SELECT paper_id, section, whole, size, unnest(range(0, greatest(length(whole) - overlap, 1), size - overlap)) AS start, generate_subscripts(range(0, greatest(length(whole) - overlap, 1), size - overlap), 1) - 1 AS chunk_no FROM w JOIN p USING (section))
SELECT paper_id, section, chunk_no, start, md5(trim(substr(whole, CAST(start + 1 AS BIGINT), size), ' ')) AS content FROM c WHERE trim(substr(whole, CAST(start + 1 AS BIGINT), size), ' ') <> ''""", "chunks_v")
def chunk_by_section(c):
    k = F.col("pos") % 5
    section = F.when(k == 0, "abstract").when(k == 1, "introduction").when(k == 2, "methods").when(k == 3, "results").otherwise("other")
    items = c.select((F.col("paper_id") % 50).alias("paper_id"), section.alias("section"), (F.col("paper_id") * 10 + F.col("pos")).alias("pos"), F.col("content").alias("text"))
    return G.chunk_by_section(items).withColumn("content", F.md5("content"))


@q("citation_support", """WITH c AS (SELECT chunk_id, content_type AS k, CASE WHEN pos % 2 = 0 THEN content END AS t, CASE WHEN pos % 3 = 0 THEN 'Caption' WHEN pos % 3 = 1 THEN 'Cap' END AS cap FROM chunks_v), o AS (SELECT *, CASE k WHEN 'table' THEN coalesce(length(t) > 10, false) OR coalesce(length(cap) > 5, false) WHEN 'figure' THEN coalesce(length(cap) > 5, false) ELSE coalesce(length(t) > 10, false) END AS ok FROM c)
SELECT chunk_id, CASE WHEN ok THEN 'supported' ELSE 'unsupported' END AS status, CASE WHEN ok THEN 'ok' WHEN k = 'table' THEN 'missing_caption_or_table_text' WHEN k = 'figure' THEN 'missing_caption' ELSE 'missing_content' END AS reason FROM o""", "chunks_v")
def citation_support(c):
    s = H.citation_support(F.col("content_type"), F.when(F.col("pos") % 2 == 0, F.col("content")), F.when(F.col("pos") % 3 == 0, "Caption").when(F.col("pos") % 3 == 1, "Cap"), F.lit(None).cast("string"))
    return c.select("chunk_id", s["status"].alias("status"), s["reason"].alias("reason"))


@q("corpus_check", """WITH p AS (SELECT count(DISTINCT doc_id) AS papers, list(DISTINCT lang) AS d FROM documents), x AS (SELECT count(DISTINCT item_id) AS queries, count(*) FILTER (item_id % 5 = 0) AS without_claims FROM benchmark)
SELECT papers, queries, 'survey' AS absent_families, array_to_string(list_sort(list_filter(['en', 'xx'], lambda v: NOT list_contains(d, v))), ',') AS absent_disciplines, without_claims, false AS ok FROM p, x""", "documents", "benchmark")
def corpus_check(d, b):
    family = F.when(F.col("item_id") % 2 == 0, "fact").otherwise("compare")
    out = GA.corpus_check(d.select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("discipline")), b.select(F.col("item_id").alias("query_id"), family.alias("family"), (F.col("item_id") % 5).alias("n_claims")), 100, 10, ["fact", "compare", "survey"], ["en", "xx"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("absent_families", "absent_disciplines")})


@q("annotation_qa", """WITH e AS (SELECT query_id, query_id % 7 = 0 AS blank, query_id % 3 = 0 AS abstain, query_id % 4 AS papers, query_id % 5 AS evidence, query_id % 2 = 0 AS reviewed FROM questions_v)
SELECT query_id, 'no_question' AS rule FROM e WHERE blank UNION ALL SELECT query_id, 'no_papers' FROM e WHERE NOT abstain AND papers = 0 UNION ALL SELECT query_id, 'no_evidence' FROM e WHERE NOT abstain AND evidence = 0 UNION ALL SELECT query_id, 'not_reviewed' FROM e WHERE NOT reviewed""", "questions_v")
def annotation_qa(x):
    i = F.col("query_id")
    return GA.annotation_qa(x.select("query_id", F.when(i % 7 == 0, " ").otherwise(F.col("question")).alias("question"), (i % 3 == 0).alias("must_abstain"), (i % 4).alias("n_papers"), (i % 5).alias("n_evidence"), F.when(i % 2 == 0, True).alias("reviewed")))


@q("validate_runs", """WITH r AS (SELECT o_orderkey // 2 AS run_id, o_orderstatus AS state, o_custkey AS a, o_orderkey AS b FROM orders)
SELECT run_id, 'repeated_run' AS problem, NULL AS detail FROM r GROUP BY run_id HAVING count(*) > 1 UNION ALL SELECT run_id, 'unknown_state', state FROM r WHERE state NOT IN ('F', 'O') UNION ALL
SELECT run_id, 'unknown_sample', CAST(s AS VARCHAR) FROM (SELECT run_id, unnest([a, b]) AS s FROM r) WHERE s NOT IN (SELECT c_custkey FROM customer)""", "orders", "customer")
def validate_runs(o, c):
    runs = o.select(F.floor(F.col("o_orderkey") / 2).alias("run_id"), F.array(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("sample_ids"), F.col("o_orderstatus").alias("state"))
    return GA.validate_runs(runs, c.select(F.col("c_custkey").cast("string").alias("sample_id")), ["F", "O"])


@q("missing_hooks", "SELECT event_id AS case_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'citation_coverage' END, CASE WHEN value < 5 THEN 'total_latency_ms' END) AS missing FROM events", "events")
def missing_hooks(e):
    one = F.lit(1.0)
    runs = e.select(F.col("event_id").alias("case_id"), F.when(F.col("event_type") != "error", one).alias("citation_coverage"), one.alias("unsupported_rate"), F.when(F.col("value") >= 5, F.col("value")).alias("total_latency_ms"), one.alias("cost_estimate"), F.lit("local").alias("execution_mode"))
    return GA.missing_hooks(runs).withColumn("missing", F.array_join("missing", ","))


@q("paragraph_coverage", """WITH p AS (SELECT conv_id AS draft_id, role AS section, turn % 3 AS c, length(text) % 4 AS e FROM conversations), s AS (SELECT DISTINCT draft_id, section FROM p), k AS (SELECT draft_id, section, count(*) AS kept FROM p WHERE c > 0 AND e > 0 GROUP BY ALL)
SELECT draft_id, section, coalesce(kept, 0) AS kept, CASE WHEN kept IS NULL THEN 'no_supported_paragraph' END AS omitted FROM s LEFT JOIN k USING (draft_id, section)""", "conversations")
def paragraph_coverage(m):
    p = m.select(F.col("conv_id").alias("draft_id"), F.col("role").alias("section"), (F.col("turn") % 3).alias("n_citations"), (F.length("text") % 4).alias("n_evidence"))
    return GA.paragraph_coverage(p, p.select("draft_id", "section").distinct())


@q("graph_candidates", """WITH x AS (SELECT c_custkey AS query_id, c_custkey % 50 AS subject, CASE c_custkey % 3 WHEN 0 THEN 'compare' WHEN 1 THEN 'numeric' ELSE 'fact' END AS family FROM customer), r AS (SELECT l_orderkey AS paper_id, l_suppkey % 50 AS subject, CASE WHEN l_linenumber % 2 = 0 THEN 'improves_metric_on_dataset' ELSE 'compares_against_baseline' END AS predicate FROM lineitem),
g AS (SELECT query_id, paper_id, count(*) AS relations, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM x JOIN r USING (subject) WHERE family = 'compare' OR (family = 'numeric' AND predicate = 'improves_metric_on_dataset') GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relations DESC, paper_id) AS rank FROM g QUALIFY rank <= 20""", "customer", "lineitem")
def graph_candidates(c, li):
    r = F.col("c_custkey") % 3
    queries = c.select(F.col("c_custkey").alias("query_id"), F.when(r == 0, "compare").when(r == 1, "numeric").otherwise("fact").alias("family"), (F.col("c_custkey") % 50).alias("subject"))
    relations = li.select(F.col("l_orderkey").alias("paper_id"), (F.col("l_suppkey") % 50).alias("subject"), F.when(F.col("l_linenumber") % 2 == 0, "improves_metric_on_dataset").otherwise("compares_against_baseline").alias("predicate"))
    return J.graph_candidates(queries, relations).withColumn("predicates", F.array_join("predicates", ","))


@q("metadata_filters", """SELECT query_id, CASE k WHEN 0 THEN 2023 WHEN 1 THEN 2019 WHEN 2 THEN 2021 END AS year_from, CASE k WHEN 0 THEN 2023 WHEN 1 THEN 2022 WHEN 2 THEN 2024 END AS year_to, CASE k WHEN 0 THEN '张三' WHEN 1 THEN 'LeCun' WHEN 2 THEN 'Hinton' END AS author, CASE k WHEN 0 THEN '注意力机制' WHEN 2 THEN '最近3年 author: Hinton 图' END AS keywords FROM (SELECT query_id, query_id % 4 AS k FROM questions_v)""", "questions_v")
def metadata_filters(x):
    k = F.col("query_id") % 4
    asked = F.when(k == 0, "2023年张三的关于注意力机制的论文").when(k == 1, "LeCun的论文 2019-2022").when(k == 2, "最近3年 author: Hinton 图相关").otherwise("what is attention")
    return x.select("query_id", P.metadata_filters(asked, 2024).alias("m")).select("query_id", "m.*")


@q("planner_families", """SELECT query_id, CASE WHEN query_id % 3 = 0 OR regexp_matches(lower(question), 'compare|vs|versus|difference|对比|比较') THEN 'compare' WHEN regexp_matches(lower(question), 'evolution|timeline|trend|演化|发展|迭代') THEN 'evolution' WHEN query_id % 3 = 1 OR regexp_matches(lower(question), 'survey|overview|综述|总结|review of') THEN 'survey' ELSE 'rest' END AS family FROM questions_v""", "questions_v")
def planner_families(x):
    from evidencelake.functions.text import planner_family

    f = planner_family(F.col("question"), F.when(F.col("query_id") % 3 == 0, "Compare").when(F.col("query_id") % 3 == 1, "summary"))
    return x.select("query_id", F.when(f.isin("compare", "evolution", "survey"), f).otherwise("rest").alias("family"))


_TOKENS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]{{3,}}'))"


@q("rerank_by_model", f"""WITH h AS (SELECT query_id, chunk_id, min(rank) AS r FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits_v) GROUP BY ALL),
p AS (SELECT h.query_id, h.chunk_id, 1.0 / (60 + r) AS rrf_score, list_intersect({_TOKENS("question")}, {_TOKENS("content")}) AS i, {_TOKENS("question")} AS t, content FROM h LEFT JOIN questions_v USING (query_id) LEFT JOIN chunks_v USING (chunk_id)),
s AS (SELECT *, CASE WHEN content IS NOT NULL AND t IS NOT NULL THEN coalesce(len(i) / nullif(len(t), 0), 0) END AS m, 1 - (row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) - 1) / count(*) OVER (PARTITION BY query_id) AS d FROM p)
SELECT query_id, chunk_id, round(coalesce(m, d), 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY m IS NOT NULL DESC, m DESC, d DESC, chunk_id)::INT AS rerank_rank FROM s""", "hits_v", "questions_v", "chunks_v")
def rerank_by_model(h, x, c):
    """E-12 with the offline scorer behind the model protocol."""
    fused = K.ranked(h.select("query_id", "chunk_id", "score"), ["query_id"], "score", "chunk_id", "r").withColumn("rrf_score", 1.0 / (60 + F.col("r")))
    texts = fused.join(x.select("query_id", "question"), "query_id").join(c.select("chunk_id", "content"), "chunk_id")
    scores = texts.select("query_id", "chunk_id", M.model_score(F.col("question"), F.col("content")).alias("model_score"))
    return K.rerank(fused, scores).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


@q("unified_by_model", rf"""WITH p AS (SELECT answer_id, chunk_id, lower(answer) AS a, lower(content) AS s, {_TOKENS("answer")} AS t, {_TOKENS("content")} AS u, list_distinct(regexp_extract_all(answer, '[0-9]+(?:\.[0-9]+)?')) AS n, list_distinct(regexp_extract_all(content, '[0-9]+(?:\.[0-9]+)?')) AS m FROM answers_v JOIN chunks_v ON paper_id = answer_id),
x AS (SELECT *, coalesce(len(list_intersect(t, u)) / nullif(len(t), 0), 0) AS e, coalesce(len(list_intersect(n, m)) / nullif(len(n), 0), 0) AS num, '\b(?:not|no|never|without|fails?)\b' AS neg FROM p)
SELECT answer_id, chunk_id, round(e, 6) AS entail, round(greatest(0, least(1, 0.4 * 0.5 + 0.3 * e + 0.2 * 0.5 + 0.1 * num - 0.3 * CASE WHEN e >= 0.3 AND regexp_matches(a, neg) <> regexp_matches(s, neg) THEN 1 ELSE 0 END)), 6) AS unified FROM x""", "answers_v", "chunks_v")
def unified_by_model(a, c):
    """H-7 with the offline entailment behind the model protocol, each answer against the chunks of its paper."""
    pairs = a.select("answer_id", "answer").join(c.select(F.col("paper_id").alias("answer_id"), "chunk_id", "content"), "answer_id")
    judged = pairs.withColumn("e", M.entailment(F.col("answer"), F.col("content")))
    half = F.lit(0.5)
    unified = H.unified_score(half, half, F.col("e.entail"), M.numeric_share(F.col("answer"), F.col("content")), F.col("e.contradiction"))
    return judged.select("answer_id", "chunk_id", F.round("e.entail", 6).alias("entail"), F.round(unified, 6).alias("unified"))
