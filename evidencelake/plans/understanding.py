"""Queries over questions, answers and claims (F, H) and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.functions import text as T
from evidencelake.operators import gates as G, verify as H
from evidencelake.plans.relational import q

CASE = lambda col, rules, other: "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({col}, '{w}')''' for w in words)} THEN '{name}'" for words, name in rules) + f" ELSE '{other}' END"
FAMILY = "CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches(lower(question), '{p}')" for p in ps) + f" THEN '{f}'" for ps, f in T.FAMILY_RULES) + " ELSE 'fact' END"


@q("query_families", f"SELECT query_id, {FAMILY} AS family, {CASE('lower(question)', T.PLANNER_RULES, 'fact')} AS planner, {CASE('lower(question)', T.DECOMPOSER_RULES, 'fact')} AS decomposer FROM questions_v", "questions_v")
def query_families(x):
    c = F.col("question")
    return x.select("query_id", T.infer_query_family(c).alias("family"), T.planner_family(c).alias("planner"), T.decomposer_family(c).alias("decomposer"))


@q("year_range", r"""SELECT query_id, CASE WHEN regexp_matches(question, '\d{4} to \d{4}') THEN 2019 WHEN contains(question, 'after 2018') THEN 2018 END AS year_from, CASE WHEN regexp_matches(question, '\d{4} to \d{4}') THEN 2021 END AS year_to FROM questions_v""", "questions_v")
def year_range(x):
    r = T.year_range(F.col("question"))
    return x.select("query_id", r["year_from"].alias("year_from"), r["year_to"].alias("year_to"))


#: Sentences in DuckDB: a line feed after each final mark before white space, then a split.
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim(answer), '([。！？.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"
CITED = r"\[[^\[\],]+,\s*[^\[\]]+\]"
CLAIMS = rf"""s AS (SELECT answer_id, unnest({SENTENCES}) AS sentence, generate_subscripts({SENTENCES}, 1) AS claim_no FROM answers_v),
c AS (SELECT answer_id, claim_no, trim(regexp_replace(sentence, '{CITED}', '', 'g')) AS claim, len(regexp_extract_all(sentence, '{CITED}')) AS n_citations FROM s WHERE length(sentence) >= 20),
claims AS (SELECT *, {CASE('lower(claim)', T.CLAIM_RULES, 'factual')} AS claim_type FROM c WHERE claim <> '')"""


@q("extract_claims", f"WITH {CLAIMS} SELECT answer_id, claim_no, claim, n_citations, claim_type FROM claims", "answers_v")
def extract_claims(a):
    return H.extract_claims(a)


@q("citation_measures", rf"SELECT answer_id, len(regexp_extract_all(answer, '{CITED}')) AS citations, round(len(regexp_extract_all(answer, '{CITED}')) / len(regexp_split_to_array(trim(answer), '\s+')), 6) AS density, round(len(list_filter({SENTENCES}, lambda s: NOT regexp_matches(s, '{CITED}'))) / len({SENTENCES}), 6) AS unsupported FROM answers_v", "answers_v")
def citation_measures(a):
    c = F.col("answer")
    return a.select("answer_id", F.size(T.citations(c)).alias("citations"), F.round(T.citation_density(c), 6).alias("density"), F.round(T.unsupported_rate(c), 6).alias("unsupported"))


def sources(c):
    """Chunks as the sources of the answer of the same paper."""
    return c.select(F.col("paper_id").alias("answer_id"), F.col("chunk_id").alias("source_id"), F.col("content").alias("text"))


def verified(a, c):
    """The claims of answers against their sources; answers are dealt by id before they are taken apart, so that tasks do not go by the bytes of files and claims need no shuffle."""
    return H.verify_claims(H.extract_claims(a.repartition("answer_id")), sources(c))


TOK = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9_]{{3,}}'))"
NUM = lambda x: f"list_distinct(regexp_extract_all({x}, '{T.NUMBER}'))"
NEG = "['" + "', '".join(H.NEGATIONS) + "']"
CS = SENTENCES.replace("answer", "content")
VERIFY = rf"""WITH {CLAIMS}, ct AS (SELECT *, {TOK('claim')} AS ct, {NUM('claim')} AS cn FROM claims),
st AS (SELECT paper_id AS answer_id, chunk_id AS source_id, {TOK('content')} AS st, {NUM('content')} AS sn, list_transform({CS}, lambda s: {TOK('s')}) AS ss FROM chunks_v),
p AS (SELECT ct.*, source_id, len(list_intersect(ct, st)) / len(ct) AS lex, len(list_intersect(ct, st)) / least(len(ct), len(st)) AS cov, list_max(list_transform(ss, lambda x: len(list_intersect(ct, x)) / len(ct))) AS sen, CASE WHEN len(cn) > 0 AND len(sn) > 0 THEN len(list_intersect(cn, sn)) / len(cn) ELSE 0 END AS num, list_has_any(ct, {NEG}) <> list_has_any(st, {NEG}) AS flip FROM ct LEFT JOIN st USING (answer_id)),
sc AS (SELECT answer_id, claim_no, claim_type, source_id, CASE WHEN source_id IS NULL THEN 0 ELSE greatest(0, least(1, lex * 0.4 + cov * 0.25 + sen * 0.2 + num * CASE WHEN claim_type = 'numeric' THEN 0.25 ELSE 0.05 END - CASE WHEN flip AND lex >= 0.2 THEN 0.18 ELSE 0 END)) END AS score FROM p),
b AS (SELECT answer_id, claim_no, claim_type, max(score) AS score, array_to_string(list(source_id ORDER BY score DESC, source_id) FILTER (score > 0.12)[1:3], ',') AS evidence FROM sc GROUP BY ALL)"""
LEVEL = "CASE WHEN score >= 0.72 THEN 'supported' WHEN score >= 0.5 THEN 'weakly_supported' WHEN score >= 0.28 THEN 'partially_supported' ELSE 'unsupported' END"


@q("verify_claims", f"{VERIFY} SELECT answer_id, claim_no, round(score, 5) AS score, {LEVEL} AS support_level, coalesce(evidence, '') AS evidence FROM b", "answers_v", "chunks_v")
def verify_claims(a, c):
    out = verified(a, c)
    return out.select("answer_id", "claim_no", F.round("score", 5).alias("score"), "support_level", F.array_join(F.col("evidence_ids").cast("array<string>"), ",").alias("evidence"))


@q("claim_report", f"{VERIFY}, l AS (SELECT answer_id, {LEVEL} AS l FROM b) SELECT answer_id, count(*) AS claims, count(*) FILTER (l = 'supported') AS supported, count(*) FILTER (l = 'weakly_supported') AS weakly_supported, count(*) FILTER (l = 'partially_supported') AS partially_supported, count(*) FILTER (l = 'unsupported') AS unsupported, round(count(*) FILTER (l = 'unsupported') / count(*), 6) AS unsupported_rate FROM l GROUP BY answer_id", "answers_v", "chunks_v")
def claim_report(a, c):
    return H.claim_report(verified(a, c)).withColumn("unsupported_rate", F.round("unsupported_rate", 6))


@q("verify_citations", rf"""WITH a AS (SELECT answer_id, list_distinct(regexp_extract_all(answer, '{CITED}')) AS cited, len(list_filter({SENTENCES}, lambda s: regexp_matches(s, '{CITED}'))) / len({SENTENCES}) AS surface FROM answers_v),
m AS (SELECT *, len(list_intersect(cited, CASE WHEN answer_id % 3 = 0 THEN ['[Paper A, Results]'] ELSE ['[Paper B, F]', '[Paper A, Results]'] END)) AS valid FROM a)
SELECT answer_id, valid, len(cited) - valid AS invalid, round(CASE WHEN len(cited) > 0 THEN valid / len(cited) ELSE 0 END, 6) AS coverage, round(surface, 6) AS surface, surface < 0.45 AS low_coverage FROM m""", "answers_v")
def verify_citations(a):
    one = a.select("answer_id", F.lit("[Paper A, Results]").alias("citation"))
    known = one.unionByName(a.where("answer_id % 3 <> 0").select("answer_id", F.lit("[Paper B, F]").alias("citation")))
    out = H.verify_citations(a, known)
    return out.withColumns({"coverage": F.round("coverage", 6), "surface": F.round("surface", 6)})


@q("abstention", "SELECT query_id, chunk_id, CASE WHEN score >= 0.6 OR vector_score < 0.2 THEN 'abstain' WHEN score > 0.3 OR page_num / 7 < 0.45 OR vector_score < 0.4 THEN 'partial' ELSE 'full' END AS answer_mode, round(greatest(0, least(1, 0.4 * score + 0.6 * vector_score)), 6) AS unified FROM hits_v", "hits_v")
def abstention(h):
    mode = H.abstention(F.col("score"), F.col("page_num") / 7, F.col("vector_score"))
    return h.select("query_id", "chunk_id", mode.alias("answer_mode"), F.round(H.unified_score(F.col("score"), F.col("vector_score")), 6).alias("unified"))


@q("answer_consistency", f"""WITH b AS (SELECT paper_id AS answer_id, content FROM chunks_v QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY quality DESC, chunk_id) <= 5), s AS (SELECT DISTINCT answer_id, unnest({TOK('content')}) AS token FROM b), a AS (SELECT answer_id, unnest({TOK('answer')}) AS token FROM answers_v)
SELECT a.answer_id, round(count(s.token) / count(*), 6) AS consistency FROM a LEFT JOIN s ON s.answer_id = a.answer_id AND s.token = a.token GROUP BY 1""", "answers_v", "chunks_v")
def answer_consistency(a, c):
    s = c.select(F.col("paper_id").alias("answer_id"), F.col("chunk_id").alias("source_id"), F.col("content").alias("text"), F.col("quality").alias("score"))
    return H.answer_consistency(a, s).withColumn("consistency", F.round("consistency", 6))


PACK = "p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits_v)"


def pack(h):
    from evidencelake.operators.ranking import ranked

    return ranked(h, ["query_id"], "score", "chunk_id")


@q("answer_contract", f"WITH {PACK}, n AS (SELECT query_id, count(*) FILTER (vector_score >= 0.7) AS supported, count(*) FILTER (vector_score >= 0.4 AND vector_score < 0.7) AS partial, count(*) AS candidates FROM p WHERE rank <= 10 GROUP BY 1) SELECT *, CASE WHEN supported > 0 THEN CASE WHEN supported >= candidates * 0.5 THEN 'full' ELSE 'partial' END WHEN partial > 0 THEN 'partial' ELSE 'abstain' END AS answer_mode FROM n", "hits_v")
def answer_contract(h):
    return H.answer_contract(pack(h).withColumn("rerank_score", F.col("vector_score")))


@q("pack_quality", f"""WITH {PACK}, s AS (SELECT query_id, count(DISTINCT paper_id) AS papers, count(DISTINCT section) AS sections, count(DISTINCT content_type) AS types, avg(score) FILTER (rank <= 10) AS mean_top, avg(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) AS support FROM p GROUP BY 1),
t AS (SELECT query_id, round(0.25 * least(papers / 12, 1) + 0.2 * least(sections / 5, 1) + 0.2 * least(types / 3, 1) + 0.25 * mean_top + 0.1 * support, 9) AS quality FROM s) SELECT query_id, round(quality, 5) AS quality, CASE WHEN quality >= 0.75 THEN 'answerable' WHEN quality >= 0.45 THEN 'partial' ELSE 'insufficient' END AS answerability FROM t""", "hits_v")
def pack_quality(h):
    want = h.select("query_id").distinct().withColumns({"n_papers": F.lit(12), "n_sections": F.lit(5), "n_types": F.lit(3)})
    return H.pack_quality(pack(h), want).select("query_id", T.rounded(F.col("quality"), 5).alias("quality"), "answerability")


@q("retrieval_weakness", """WITH b AS (SELECT query_id, paper_id, count(*) AS n, sum(score) AS s FROM hits_v WHERE query_id % 3 > 0 OR paper_id % 20 = 0 GROUP BY ALL), m AS (SELECT query_id, sum(n) AS hits, round(sum(s) / sum(n), 9) AS mean_score, max(n) / sum(n) AS conc, count(*) AS papers FROM b GROUP BY 1)
SELECT query_id, concat_ws(',', CASE WHEN mean_score < 0.5 THEN 'low_score' END, CASE WHEN conc > 0.6 THEN 'single_paper' END, CASE WHEN papers < 2 THEN 'few_papers' END, CASE WHEN hits < 3 THEN 'few_hits' END) AS reasons FROM m""", "hits_v")
def retrieval_weakness(h):
    return H.retrieval_weakness(h.where("query_id % 3 > 0 or paper_id % 20 = 0")).select("query_id", F.array_join("reasons", ",").alias("reasons"))


@q("converged", "SELECT query_id, count(*) FILTER (branch <> 'dense') = 0 AS converged FROM hits_v WHERE score > 0.8 GROUP BY query_id", "hits_v")
def converged(h):
    return H.converged(h.where("branch = 'dense'"), h.where("score > 0.8"))


@q("answer_confidence", """WITH b AS (SELECT * FROM hits_v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5), s AS (SELECT query_id, avg(least(1, score)) AS m, count(DISTINCT paper_id) / count(*) AS d, least(count(*) / 5, 1) AS v FROM b GROUP BY 1),
j AS (SELECT answer_id, coalesce(m, 0) AS m, coalesce(d, 0) AS d, coalesce(v, 0) AS v, least(length(answer) / 400, 1) AS l FROM answers_v LEFT JOIN s ON query_id = answer_id WHERE answer_id < 400)
SELECT answer_id, round(0.55 * m + 0.25 * d + 0.2 * (0.6 * v + 0.4 * l), 6) AS confidence FROM j""", "hits_v", "answers_v")
def answer_confidence(h, a):
    s = h.select(F.col("query_id").alias("answer_id"), F.col("chunk_id").alias("source_id"), "paper_id", "score")
    return H.confidence(s, a.where("answer_id < 400")).select("answer_id", F.round("confidence", 6).alias("confidence"))


RUNS = """SELECT user_id AS run_id, round(avg(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END), 4) AS recall_at_5, round(avg(least(value / 20, 1)), 4) AS citation_coverage, round(avg(CASE WHEN value < 3 THEN 1 ELSE 0 END), 4) AS unsupported_rate, CASE WHEN user_id % 5 > 0 THEN 0.7 END AS consistency, round(max(value) / 20, 4) AS latency_p95 FROM events GROUP BY user_id"""


def runs(e):
    """Run metrics from events, one run for each user."""
    return e.groupBy(F.col("user_id").alias("run_id")).agg(
        F.round(F.avg(F.when(F.col("event_type") == "error", 0).otherwise(1)), 4).alias("recall_at_5"), F.round(F.avg(F.least(F.col("value") / 20, F.lit(1.0))), 4).alias("citation_coverage"),
        F.round(F.avg(F.when(F.col("value") < 3, 1).otherwise(0)), 4).alias("unsupported_rate"), F.round(F.max("value") / 20, 4).alias("latency_p95"),
    ).withColumn("consistency", F.when(F.col("run_id") % 5 > 0, 0.7))


BROKEN = ", ".join(f"CASE WHEN coalesce({m} {'<' if k == 'min' else '>'} {v}, true) THEN '{m} {k} {v}' END" for m, k, v in G.THRESHOLDS)


@q("release_gate", f"WITH r AS ({RUNS}), b AS (SELECT run_id, concat_ws(',', {BROKEN}) AS reasons FROM r) SELECT run_id, CASE WHEN reasons = '' THEN 'pass' ELSE 'blocked' END AS verdict, reasons FROM b", "events")
def release_gate(e):
    return G.gate(runs(e)).withColumn("reasons", F.array_join("reasons", ","))


@q("metric_diff", f"""WITH a AS ({RUNS.replace("FROM events", "FROM events WHERE event_id % 2 = 0")}), b AS ({RUNS.replace("FROM events", "FROM events WHERE event_id % 2 = 1")}),
u AS (SELECT a.run_id, 'recall_at_5' AS metric, b.recall_at_5 - a.recall_at_5 AS d, 1 AS s FROM a JOIN b USING (run_id) UNION ALL SELECT a.run_id, 'unsupported_rate', b.unsupported_rate - a.unsupported_rate, -1 FROM a JOIN b USING (run_id))
SELECT run_id, metric, round(d, 4) AS delta, CASE WHEN d * s > 1e-9 THEN 'improved' WHEN d * s < -1e-9 THEN 'regressed' ELSE 'same' END AS status FROM u""", "events")
def metric_diff(e):
    out = G.metric_diff(runs(e.where("event_id % 2 = 0")), runs(e.where("event_id % 2 = 1")), ["recall_at_5"], ["unsupported_rate"], ["run_id"])
    return out.select("run_id", "metric", F.round("delta", 4).alias("delta"), "status")


@q("hit_eval", f"""WITH {PACK}, g AS (SELECT query_id, paper_id, section, chunk_id FROM hits_v WHERE branch = 'graph' AND page_num = 3),
j AS (SELECT g.query_id, p.rank, p.paper_id = g.paper_id AS pp, p.section = g.section AS ss, p.chunk_id = g.chunk_id AS cc FROM g LEFT JOIN p USING (query_id)),
h AS (SELECT query_id, bool_or(rank <= 10 AND pp) AS paper_hit, bool_or(rank <= 10 AND pp AND ss) AS section_hit, bool_or(rank <= 10 AND cc) AS exact_hit, bool_or(rank <= 100 AND cc) AS oracle_hit FROM j GROUP BY 1)
SELECT *, CASE WHEN NOT paper_hit THEN 'paper_miss' WHEN NOT section_hit THEN 'section_miss' WHEN NOT oracle_hit THEN 'candidate_pool_miss' WHEN NOT exact_hit THEN 'exact_miss' ELSE 'pass' END AS bucket FROM h""", "hits_v")
def hit_eval(h):
    out = G.hit_eval(pack(h), h.where("branch = 'graph' and page_num = 3").select("query_id", "paper_id", "section", "chunk_id"))
    return out.withColumn("bucket", G.failure_bucket(F.col("paper_hit"), F.col("section_hit"), F.col("oracle_hit"), F.col("exact_hit")))


@q("chunk_qa", """WITH c AS (SELECT paper_id, chunk_id, content_type, CASE WHEN pos = 6 THEN '' ELSE section END AS section FROM chunks_v), o AS (SELECT paper_id, chunk_id, count(*) AS n, count(*) FILTER (section = '') AS m, count(*) FILTER (content_type NOT IN ('text', 'table')) AS b FROM c GROUP BY ALL)
SELECT paper_id, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(m) AS BIGINT) AS missing, CAST(sum(b) AS BIGINT) AS bad_type, CAST(sum(n - 1) AS BIGINT) AS repeated, CASE WHEN sum(m) + sum(b) + sum(n - 1) = 0 THEN 'PASS' ELSE 'BLOCKED' END AS status FROM o GROUP BY 1""", "chunks_v")
def chunk_qa(c):
    return G.chunk_qa(c.withColumn("section", F.when(F.col("pos") == 6, "").otherwise(F.col("section"))), ["content", "section"], ["text", "table"])


@q("required_missing", "SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang = 'fr'", "documents", "labels")
def required_missing(d, labels):
    return G.required_missing(d.where("lang = 'fr'").join(labels.where("toxic = 1"), "doc_id"), d, ["source"])


@q("page_lines", r"""WITH l AS (SELECT doc_id, i, trim(regexp_replace(string_split(text, chr(10))[i], '\s+', ' ', 'g')) AS x FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) AS u(i)),
g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM l WHERE length(x) > 2 AND NOT regexp_matches(x, '^[\d.\s]+$') AND NOT regexp_matches(lower(x), '^arxiv:'))
SELECT doc_id, coalesce(md5(string_agg(x, chr(10) ORDER BY i) FILTER (n <= 3)), md5('')) AS cleaned FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id""", "documents")
def page_lines(d):
    return d.select("doc_id", F.md5(T.page_lines(F.col("text"))).alias("cleaned"))


@q("source_type", "SELECT CASE WHEN regexp_matches(url, '^https?://') THEN CASE WHEN regexp_matches(url, '\\.pdf') THEN 'pdf_url' ELSE 'url' END ELSE 'unknown' END AS kind, count(*) AS n FROM pages GROUP BY 1", "pages")
def source_type(p):
    return p.groupBy(T.source_type(F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


ONCE = lambda x: f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


@q("evidence_hints", rf"""WITH f AS (SELECT chunk_id, list_transform(regexp_extract_all(content, '{T.METRIC_NAME}'), lambda x: lower(x)) AS m, list_filter(regexp_extract_all(content, '{T.DATASET_NAME}'), lambda x: length(x) >= 3) AS d, list_filter(regexp_extract_all(content, '{T.METHOD_NAME}'), lambda x: length(x) >= 4) AS me,
regexp_extract_all(content, '{T.TABLE_NUMBER}', 1) AS t FROM chunks_v) SELECT chunk_id, array_to_string({ONCE("m")}[1:3], ',') AS metrics, array_to_string({ONCE("d")}[1:3], ',') AS datasets, array_to_string({ONCE("me")}[1:3], ',') AS methods, array_to_string(list_transform(t[1:2], lambda x: 'Table ' || x), ',') AS tables FROM f""", "chunks_v")
def evidence_hints(c):
    h = T.hints(F.col("content"))
    return c.select("chunk_id", *[F.array_join(h[n], ",").alias(n) for n in ("metrics", "datasets", "methods", "tables")])


@q("claim_row_summary", f"""{VERIFY}, l AS (SELECT answer_id, {LEVEL} AS l FROM b), n AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (l = 'supported') AS supported, count(*) FILTER (l = 'unsupported') AS unsupported FROM l GROUP BY 1)
SELECT answer_id, claims, supported, unsupported, CASE WHEN unsupported > 0 OR supported = 0 THEN 'abstain' WHEN supported = claims THEN 'full' ELSE 'partial' END AS answer_mode FROM n""", "answers_v", "chunks_v")
def claim_row_summary(a, c):
    return H.claim_row_summary(verified(a, c)).select("answer_id", "claims", "supported", "unsupported", "answer_mode")


#: Answers of which some have no claim: the first sentence alone where it is short.
LOOSE_ANSWERS = "SELECT answer_id, CASE answer_id % 5 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'Insufficient evidence' WHEN 2 THEN ' ' ELSE answer END AS answer FROM answers_v"


@q("truthfulness_report", f"""{VERIFY.replace("FROM answers_v", f"FROM ({LOOSE_ANSWERS}) answers_v")}, l AS (SELECT answer_id, {LEVEL} AS l FROM b), n AS (SELECT answer_id, count(*) AS claims, count(*) FILTER (l = 'supported') AS s, count(*) FILTER (l = 'weakly_supported') AS w, count(*) FILTER (l = 'partially_supported') AS p, count(*) FILTER (l = 'unsupported') AS u FROM l GROUP BY 1),
a AS (SELECT answer_id, lower(trim(answer)) AS t, answer_id IN (SELECT paper_id FROM chunks_v WHERE paper_id % 2 = 0) AS backed FROM ({LOOSE_ANSWERS}) x), j AS (SELECT a.*, n.* EXCLUDE (answer_id), CASE WHEN claims > 0 OR t = '' THEN 'lexical_overlap' WHEN NOT backed THEN 'no_claims_without_evidence' WHEN contains(t, 'insufficient evidence') THEN 'lexical_abstain_guard' ELSE 'fallback_unstructured_answer' END AS backend FROM a LEFT JOIN n USING (answer_id))
SELECT answer_id, coalesce(claims, CASE WHEN backend IN ('lexical_abstain_guard', 'fallback_unstructured_answer') THEN 1 ELSE 0 END) AS claims, coalesce(s, 0) AS supported, coalesce(w, CASE WHEN backend = 'fallback_unstructured_answer' THEN 1 ELSE 0 END) AS weakly_supported, coalesce(p, 0) AS partially_supported, coalesce(u, CASE WHEN backend = 'lexical_abstain_guard' THEN 1 ELSE 0 END) AS unsupported,
round(coalesce(u / claims, CASE WHEN backend IN ('lexical_abstain_guard', 'no_claims_without_evidence') THEN 1 ELSE 0 END), 6) AS unsupported_rate, backend, CASE WHEN backend = 'fallback_unstructured_answer' THEN 'partial' WHEN claims > 0 AND u = 0 AND s > 0 THEN CASE WHEN s = claims THEN 'full' ELSE 'partial' END ELSE 'abstain' END AS answer_mode FROM j""", "answers_v", "chunks_v")
def truthfulness_report(a, c):
    k = F.col("answer_id") % 5
    loose = a.withColumn("answer", F.when(k == 0, "Yes.").when(k == 1, "Insufficient evidence").when(k == 2, " ").otherwise(F.col("answer")))
    out = H.truthfulness_report(loose, verified(loose, c), sources(c.where("paper_id % 2 = 0")))
    return out.withColumn("unsupported_rate", F.round("unsupported_rate", 6))


@q("repair_hints", f"""{VERIFY}, l AS (SELECT answer_id, claim_no, {LEVEL} AS l, coalesce(array_to_string((string_split(evidence, ','))[1:2], ', '), '') AS e FROM b)
SELECT answer_id, claim_no, l <> 'supported' AS repairable, CASE WHEN l <> 'supported' THEN CASE WHEN e <> '' THEN 'Relink claim to stronger evidence ' || e || ' and rewrite for ' || l || ' support.' ELSE 'Retrieve stronger evidence or narrow the claim before rewriting.' END END AS repair_hint FROM l""", "answers_v", "chunks_v")
def repair_hints(a, c):
    return H.repair_hints(verified(a, c))


@q("benchmark_summary", """WITH r AS (SELECT user_id AS run_id, event_id % 11 > 0 AS ok, user_id % 9 = 0 AS synthetic, CASE WHEN value < 15 THEN 1.0 ELSE 0.9003 END AS cov, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS uns, least(1, 0.6 + user_id % 4 * 0.05) AS con, CASE WHEN user_id % 7 = 0 THEN 0.5 ELSE 1.0 END AS jump, value AS lat FROM events),
s AS (SELECT run_id, count(*) AS total, count(*) FILTER (ok) AS ok, round(avg(cov), 4) AS citation_coverage, round(avg(uns), 4) AS unsupported_claim_rate, round(avg(con), 4) AS consistency, round(avg(jump), 4) AS jump_validity, bool_or(synthetic) AS synthetic, round(list_sort(list(lat))[greatest(CAST(floor(count(*) * 0.95) AS INT), 1)], 4) AS p95_latency_s FROM r GROUP BY 1),
f AS (SELECT *, jump_validity >= 0.9 AND p95_latency_s < 60 AS flows, citation_coverage >= 0.85 AND unsupported_claim_rate <= 0.1 AND consistency >= 0.65 AS good FROM s)
SELECT run_id, total, ok, citation_coverage, unsupported_claim_rate, consistency, jump_validity, p95_latency_s, CASE WHEN synthetic THEN 'SMOKE' WHEN NOT flows THEN 'PIPELINE_ERROR' WHEN NOT good THEN 'QUALITY_BLOCKED' ELSE 'QUALITY_PASS' END AS eval_status, CASE WHEN synthetic THEN 'SMOKE_ONLY' WHEN flows AND good THEN 'PASS' ELSE 'BLOCKED' END AS gate_status FROM f""", "events")
def benchmark_summary(e):
    r = e.select(
        F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 11 > 0, "ok").otherwise("failed").alias("status"), (F.col("user_id") % 9 == 0).alias("synthetic"), F.when(F.col("value") < 15, 1.0).otherwise(0.9003).alias("citation_coverage"),
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("unsupported_claim"), F.least(F.lit(1.0), 0.6 + F.col("user_id") % 4 * 0.05).alias("consistency"), F.when(F.col("user_id") % 7 == 0, 0.5).otherwise(1.0).alias("jump_valid"), F.col("value").alias("latency_s"), F.lit(0).alias("hard_error"),
    )
    return G.benchmark_summary(r).drop("synthetic", "hard_errors")


@q("stratified_sample", "WITH h AS (SELECT event_id, event_type, md5('7|' || event_id) AS h FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) > 1 AS f FROM h) SELECT event_id, event_type FROM f ORDER BY f, h, event_id LIMIT 50", "events")
def stratified_sample(e):
    return G.stratified_sample(e, "event_type", "event_id", 50).select("event_id", "event_type")
