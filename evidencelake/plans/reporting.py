"""Queries over reports and corpus builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencelake.operators import gates as G, reports as R
from evidencelake.plans.relational import q

CASES = "SELECT user_id AS run_id, value / 100 AS coverage, CASE WHEN value < 5 THEN 0.2 ELSE 0 END AS unsupported, value * 10 AS latency, value / 1000 AS cost, event_type = 'error' AS degraded, event_type <> 'error' AS succeeded, 'v' || event_id % 3 AS version FROM events"


@q("run_summary", f"SELECT run_id, count(*) AS cases, round(avg(coverage), 6) AS coverage, round(avg(latency), 4) AS latency, round(count(*) FILTER (degraded) / count(*), 6) AS degraded_rate, array_to_string(list_sort(list(DISTINCT version)), ',') AS versions FROM ({CASES}) GROUP BY run_id", "events")
def run_summary(e):
    c = e.select(
        F.col("user_id").alias("run_id"), (F.col("value") / 100).alias("coverage"), F.when(F.col("value") < 5, 0.2).otherwise(0.0).alias("unsupported"), (F.col("value") * 10).alias("latency"), (F.col("value") / 1000).alias("cost"),
        (F.col("event_type") == "error").alias("degraded"), (F.col("event_type") != "error").alias("succeeded"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("version"),
    )
    return R.run_summary(c).select("run_id", "cases", F.round("coverage", 6).alias("coverage"), F.round("latency", 4).alias("latency"), F.round("degraded_rate", 6).alias("degraded_rate"), F.array_join("versions", ",").alias("versions"))


@q("bucket_rollup", "SELECT event_type || '::' || user_id % 4 AS bucket, count(*) AS n, round(avg(value - 10), 5) AS mean_delta FROM events GROUP BY 1", "events")
def bucket_rollup(e):
    d = e.select(F.col("event_type").alias("source"), (F.col("user_id") % 4).cast("string").alias("family"), (F.col("value") - 10).alias("delta"))
    return R.bucket_rollup(d).withColumn("mean_delta", F.round("mean_delta", 5))


@q("evidence_quality_summary", """SELECT round(avg(value / 100), 6) AS coverage, round(sum(event_id % 2) / sum(event_id % 5 + 1), 6) AS unsupported_rate, round(count(*) FILTER (event_type = 'error' AND user_id % 2 = 0) / count(*) FILTER (event_type = 'error'), 6) AS abstain_precision, count(*) FILTER (event_type = 'view') AS "full", count(*) FILTER (event_type = 'error') AS abstain FROM events""", "events")
def evidence_quality_summary(e):
    mode = F.when(F.col("event_type") == "error", "abstain").when(F.col("event_type") == "view", "full").otherwise("partial")
    a = e.select((F.col("value") / 100).alias("coverage"), (F.col("event_id") % 2).alias("unsupported"), (F.col("event_id") % 5 + 1).alias("claims"), F.lit(1.0).alias("consistency"), mode.alias("mode"), (F.col("user_id") % 2 == 0).alias("should_abstain"))
    return R.evidence_quality_summary(a).select(*[F.round(c, 6).alias(c) for c in ("coverage", "unsupported_rate", "abstain_precision")], "full", "abstain")


@q("group_by_paper", "SELECT query_id, paper_id, max(score) AS score, count(*) AS hits, array_to_string(list(chunk_id ORDER BY score DESC, chunk_id)[1:3], ',') AS key_points FROM hits_v GROUP BY query_id, paper_id", "hits_v")
def group_by_paper(h):
    return R.group_by_paper(h).withColumn("key_points", F.array_join(F.col("key_points").cast("array<string>"), ","))


@q("answer_audit", "SELECT event_type AS family, round(count(*) FILTER (value >= 8 AND event_id % 3 = 0) / count(*), 6) AS pass_rate, round(count(*) FILTER (user_id % 5 > 0) / count(*), 6) AS jump_rate, round(sum(event_id % 3) / sum(event_id % 4 + 2), 6) AS unsupported_rate FROM events GROUP BY 1", "events")
def answer_audit(e):
    a = e.select(F.col("event_type").alias("family"), F.when(F.col("value") >= 8, 0.9).otherwise(0.1).alias("coverage"), (F.col("event_id") % 3).alias("unsupported"), (F.col("event_id") % 4 + 2).alias("claims"), (F.col("user_id") % 5 > 0).alias("jump_valid"))
    return R.answer_audit(a).select("family", *[F.round(c, 6).alias(c) for c in ("pass_rate", "jump_rate", "unsupported_rate")])


@q("runs_overview", "SELECT event_type AS mode, event_id AS run_id, count(*) OVER (PARTITION BY event_type) AS runs, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events QUALIFY rank <= 5", "events")
def runs_overview(e):
    return R.overview(e.select(F.col("event_type").alias("mode"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"))).select("mode", "run_id", "runs", "rank")


@q("case_summary", """WITH c AS (SELECT user_id AS batch, event_type IN ('purchase', 'view') AS success, value AS seconds, CASE WHEN event_type = 'click' THEN 'waiting' ELSE 'done' END AS status, event_type || event_id % 2 AS reason FROM events), w AS (SELECT batch, reason, count(*) AS n FROM c WHERE NOT success GROUP BY ALL), t AS (SELECT batch, reason AS top_failure FROM w QUALIFY row_number() OVER (PARTITION BY batch ORDER BY n DESC, reason) = 1)
SELECT c.batch, round(count(*) FILTER (success) / count(*), 6) AS success_rate, round(avg(seconds) FILTER (success), 5) AS mean_ready, round(count(*) FILTER (status = 'waiting') / count(*), 6) AS waiting_rate, any_value(top_failure) AS top_failure FROM c LEFT JOIN t USING (batch) GROUP BY c.batch""", "events")
def case_summary(e):
    c = e.select(F.col("user_id").alias("batch"), F.col("event_type").isin("purchase", "view").alias("success"), F.col("value").alias("seconds"), F.when(F.col("event_type") == "click", "waiting").otherwise("done").alias("status"), F.concat("event_type", (F.col("event_id") % 2).cast("string")).alias("reason"))
    return R.case_summary(c).select("batch", F.round("success_rate", 6).alias("success_rate"), F.round("mean_ready", 5).alias("mean_ready"), F.round("waiting_rate", 6).alias("waiting_rate"), "top_failure")


@q("answer_case_eval", r"""WITH c AS (SELECT paper_id AS case_id, paper_id % 2 = 0 AS must_cite, paper_id % 5 = 0 AS must_abstain FROM papers_v), a AS (SELECT answer_id AS case_id, CASE WHEN answer_id % 4 = 0 THEN 'plain' ELSE answer END AS answer, CASE WHEN answer_id % 10 = 0 THEN 'abstain' ELSE 'full' END AS mode FROM answers_v WHERE answer_id % 7 > 0),
j AS (SELECT case_id, concat_ws(',', CASE WHEN answer IS NULL THEN 'no_answer' END, CASE WHEN answer IS NOT NULL AND must_cite AND NOT regexp_matches(answer, '\[[^\[\],]+,\s*[^\[\]]+\]') THEN 'citation_missing' END, CASE WHEN answer IS NOT NULL AND must_abstain AND mode <> 'abstain' THEN 'should_abstain' END) AS reasons FROM c LEFT JOIN a USING (case_id)) SELECT case_id, reasons = '' AS passed, reasons FROM j""", "papers_v", "answers_v")
def answer_case_eval(p, a):
    cases = p.select(F.col("paper_id").alias("case_id"), (F.col("paper_id") % 2 == 0).alias("must_cite"), (F.col("paper_id") % 5 == 0).alias("must_abstain"))
    answers = a.where("answer_id % 7 > 0").select(F.col("answer_id").alias("case_id"), F.when(F.col("answer_id") % 4 == 0, "plain").otherwise(F.col("answer")).alias("answer"), F.when(F.col("answer_id") % 10 == 0, "abstain").otherwise("full").alias("mode"))
    return R.answer_case_eval(cases, answers).withColumn("reasons", F.array_join("reasons", ","))


@q("numeric_exact_match", "WITH g AS (SELECT DISTINCT query_id, paper_id, section, content_type, page_num FROM hits_v WHERE branch = 'dense'), f AS (SELECT DISTINCT query_id, paper_id, section, content_type, page_num FROM hits_v WHERE branch <> 'dense' OR score > 0.7) SELECT g.query_id, round(count(f.query_id) / count(*), 6) AS match FROM g LEFT JOIN f USING (query_id, paper_id, section, content_type, page_num) GROUP BY g.query_id", "hits_v")
def numeric_exact_match(h):
    rows = lambda w: h.where(w).select("query_id", F.col("paper_id").alias("method"), F.col("section").alias("dataset"), F.col("content_type").alias("metric"), F.col("page_num").alias("value"))
    return R.numeric_exact_match(rows("branch <> 'dense' or score > 0.7"), rows("branch = 'dense'")).withColumn("match", F.round("match", 6))


@q("comparative_verdict", "SELECT query_id, chunk_id, CASE WHEN page_num = 7 THEN 'fail' WHEN score - 0.6 < -0.02 OR vector_score - 0.5 > 0.02 THEN 'fail' WHEN page_num * 200 > 1000 THEN 'experiment_only' WHEN score - 0.6 < 0 OR vector_score - 0.5 > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM hits_v", "hits_v")
def comparative_verdict(h):
    v = G.comparative_verdict(F.col("score") - 0.6, F.col("vector_score") - 0.5, F.col("page_num") * 200, F.when(F.col("page_num") == 7, 1).otherwise(0))
    return h.select("query_id", "chunk_id", v.alias("verdict"))


@q("golden_consistency", "SELECT lang AS family, count(DISTINCT documents.doc_id) AS papers, count(DISTINCT documents.doc_id) FILTER (quality IS NULL) AS missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1", "documents", "labels")
def golden_consistency(d, labels):
    return R.golden_consistency(d.select(F.col("lang").alias("family"), F.col("doc_id").alias("paper_id")), labels.select(F.col("doc_id").alias("paper_id")))


@q("replace_claims", "SELECT query_id AS answer_id, chunk_id AS claim_no, CASE WHEN score > 0.9 THEN 'repaired' ELSE 'old' END AS status FROM hits_v", "hits_v")
def replace_claims(h):
    rows = h.select(F.col("query_id").alias("answer_id"), F.col("chunk_id").alias("claim_no"), "score")
    return R.replace_claims(rows.select("answer_id", "claim_no", F.lit("old").alias("status")), rows.where("score > 0.9").select("answer_id", "claim_no", F.lit("repaired").alias("status")))


@q("memory_search", "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS memory_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 25 = 0 AND b.vec_id % 25 <> 0) SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, memory_id) AS rank FROM s QUALIFY rank <= 4", "embeddings")
def memory_search(e):
    queries = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("user_id"), "embedding")
    memories = e.where("vec_id % 25 <> 0").select(F.col("label").alias("user_id"), F.col("vec_id").alias("memory_id"), F.lit("text").alias("memory"), "embedding")
    return R.memory_search(queries, memories, 4).select("query_id", "memory_id", "rank")


@q("summary_candidates", "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.label % 2 = 0) SELECT query_id, vec_id, round(greatest(s, 0.75), 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 5", "embeddings")
def summary_candidates(e):
    family = F.when(F.col("label") % 2 == 0, "survey").otherwise("fact")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", family.alias("family"))
    return R.summary_candidates(queries, e, 5).select("query_id", "vec_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@q("paper_summary", """WITH k AS (SELECT *, CASE WHEN regexp_matches(lower(section), 'abstract|introduction') THEN 'overview' WHEN regexp_matches(lower(section), 'method') THEN 'method' WHEN regexp_matches(lower(section), 'result|experiment') THEN 'experiment' END AS kind FROM chunks_v),
t AS (SELECT paper_id, kind, substr(array_to_string(list(content ORDER BY pos, content)[1:2], ' '), 1, 300) AS t FROM k WHERE kind IS NOT NULL GROUP BY ALL) SELECT c.paper_id, c.captions, max(t) FILTER (kind = 'overview') AS overview, max(t) FILTER (kind = 'method') AS method, max(t) FILTER (kind = 'experiment') AS experiment FROM (SELECT paper_id, count(*) FILTER (content_type IN ('table', 'figure')) AS captions FROM chunks_v GROUP BY 1) c LEFT JOIN t USING (paper_id) GROUP BY ALL""", "chunks_v")
def paper_summary(c):
    return R.paper_summary(c)


#: Chunks with sentences that name tasks, datasets, baselines and limitations.
NAMED = "SELECT chunk_id, content || CASE chunk_id % 4 WHEN 0 THEN ' RankNet and method B-2 help translation and QA on SQuAD, COCO and MNIST over BERT.' WHEN 1 THEN ' Accuracy and recall of the svm on imagenet; one failure.' WHEN 2 THEN ' The limitation: baseline ResNet-50 wins at detection.' ELSE '' END AS content FROM chunks_v"
MENTIONS = ", ".join(f"list_transform(regexp_extract_all(content, '{p}', 1), lambda x: lower(trim(x)))[1:8] AS {k}" for k, p in R.ONTOLOGY.items())


@q("ontology_relations", f"""WITH f AS (SELECT chunk_id, regexp_matches(lower(content), '{R.LIMITATION_MARK}') AS lim, {MENTIONS} FROM ({NAMED}) x), m AS (SELECT *, unnest(list_distinct(method[1:3])) AS subject FROM f)
SELECT chunk_id, subject, 'has_limitation' AS predicate, 'reported limitation' AS object FROM m WHERE lim UNION ALL SELECT chunk_id, subject, 'applies_to_task', unnest(list_distinct(task[1:2])) FROM m UNION ALL SELECT chunk_id, subject, 'evaluated_on_dataset', unnest(list_distinct(dataset[1:2])) FROM m
UNION ALL SELECT chunk_id, subject, 'compares_against_baseline', unnest(list_distinct(baseline[1:2])) FROM m UNION ALL SELECT chunk_id, method[1], 'improves_metric_on_dataset', dataset[1] FROM f WHERE len(method) > 0 AND len(metric) > 0 AND len(dataset) > 0""", "chunks_v")
def ontology_relations(c):
    k = F.col("chunk_id") % 4
    said = F.when(k == 0, " RankNet and method B-2 help translation and QA on SQuAD, COCO and MNIST over BERT.").when(k == 1, " Accuracy and recall of the svm on imagenet; one failure.").when(k == 2, " The limitation: baseline ResNet-50 wins at detection.").otherwise("")
    return R.ontology_slice(c.select("chunk_id", F.concat("content", said).alias("content")))[1]


@q("golden_generator", """WITH p AS (SELECT paper_id, title, venue, md5('11|' || paper_id) AS h, CAST(ceil(count(*) OVER (PARTITION BY venue) / 10000) AS BIGINT) AS parts FROM papers_v), d AS (SELECT *, CAST('0x' || substr(h, 1, 7) AS BIGINT) % parts AS part FROM p),
n AS (SELECT paper_id, title, lead(paper_id) OVER w AS other, lead(title) OVER w AS other_title FROM d WINDOW w AS (PARTITION BY venue, part ORDER BY h, paper_id))
SELECT 't' || paper_id AS golden_id, 'What is the topic of ' || title || '?' AS query, CAST(paper_id AS STRING) AS paper_ids FROM p UNION ALL SELECT 'c' || paper_id, 'Compare ' || title || ' and ' || other_title, paper_id || ',' || other FROM n WHERE other IS NOT NULL""", "papers_v")
def golden_generator(p):
    return R.golden_generator(p).withColumn("paper_ids", F.array_join(F.col("paper_ids").cast("array<string>"), ","))


@q("corpus_split", "WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 5 THEN 'dev' WHEN n <= 13 THEN 'blind' ELSE 'train' END AS split, CASE WHEN n <= 5 OR n > 13 THEN lang END AS gold FROM n", "documents")
def corpus_split(d):
    out = R.corpus_split(d.select("doc_id", "lang", F.col("lang").alias("gold")), {"dev": 5, "blind": 8}, "lang", [F.md5(F.col("doc_id").cast("string")), "doc_id"])
    return out.select("doc_id", "split", "gold")
