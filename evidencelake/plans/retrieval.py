"""Queries over chunks, lexical and vector search, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidencelake.functions import text as T
from evidencelake.operators import lexical as L, ranking as R, vectors as V
from evidencelake.plans.registry import query
from evidencelake.plans.views import frame, spark_sql, with_views
from evidencelake.scratch import is_small, materialize
from evidencelake.sources.tables import read_table

#: Up to this many questions are broadcast whole (a few MB) to find the chunks that hold them.
MAX_PASSAGE_QUESTIONS = 10_000

CHUNKS = r"""
starts AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 200, 1), 1200)) AS s FROM documents WHERE length(text) > 0),
cut AS (SELECT doc_id, CAST(s AS INT) AS start, trim(substr(text, s + 1, 1400)) AS content FROM starts),
chunks AS (SELECT doc_id, 'chunk_' || substr(sha1(doc_id || '|1||' || start || '|' || (start + length(content))), 1, 24) AS chunk_id, start, content FROM cut WHERE content <> '')"""
SPARSE = r"""
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_\-]+|[\x{4e00}-\x{9fff}]+')) AS token FROM benchmark),
q AS (SELECT query_id, token, count(*) AS q_tf FROM qt GROUP BY ALL),
cw AS (SELECT chunk_id, regexp_extract_all(lower(content), '[a-z0-9_\-]+|[\x{4e00}-\x{9fff}]+') AS w FROM chunks),
c AS (SELECT chunk_id, n, token, count(*) AS tf FROM (SELECT chunk_id, len(w) AS n, unnest(w) AS token FROM cw) GROUP BY ALL),
sraw AS (SELECT query_id, chunk_id, sum((ln(1 + 1 / (1 + length(token) * 0.25)) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * n / 200.0)) * q_tf) AS raw FROM q JOIN c USING (token) GROUP BY ALL),
sparse AS (SELECT query_id, chunk_id, raw / (raw + 5) AS score FROM sraw)"""
TFIDF = r"""
qt3 AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]{3,}'))) AS token FROM benchmark),
cw3 AS (SELECT chunk_id, list_filter(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]{3,}')) AS w FROM chunks),
c3 AS (SELECT chunk_id, n, token, count(*) AS tf FROM (SELECT chunk_id, len(w) AS n, unnest(w) AS token FROM cw3) GROUP BY ALL),
tfidf AS (SELECT query_id, chunk_id, sum(tf / n * ln(2)) AS score FROM qt3 JOIN c3 USING (token) GROUP BY ALL)"""


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as questions."""
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-1 over all documents."""
    return L.chunk_fixed(read_table(spark, sf_dir, "documents"))


@query("chunk_fixed", f"WITH {CHUNKS} SELECT * FROM chunks")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_chunks(spark, sf_dir)


@query("sparse_top_k", f"WITH {CHUNKS}, {SPARSE} SELECT query_id, chunk_id, round(round(score, 9), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sparse QUALIFY rank <= 18")
def sparse_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lexical_top_k(benchmark_questions(spark, sf_dir), document_chunks(spark, sf_dir), 18).withColumn("score", F.round("score", 6))


@query("tfidf_top_k", f"WITH {CHUNKS}, {TFIDF} SELECT query_id, chunk_id, round(round(score, 9), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM tfidf QUALIFY rank <= 10")
def tfidf_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lexical_top_k(benchmark_questions(spark, sf_dir), document_chunks(spark, sf_dir), 10, "tfidf").withColumn("score", F.round("score", 6))


FLAGSHIP = f"""WITH {CHUNKS}, {SPARSE}, {TFIDF},
b1 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM sparse QUALIFY r <= 18),
b2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM tfidf QUALIFY r <= 18),
f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS s FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) GROUP BY ALL),
k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM f),
rel AS (SELECT item_id AS query_id, chunk_id FROM benchmark JOIN chunks ON contains(content, benchmark.text)),
g AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY ALL),
h AS (SELECT query_id, rank FROM k JOIN rel USING (query_id, chunk_id)),
m AS (SELECT query_id, n_relevant, count(rank) FILTER (rank <= 5) / n_relevant AS recall_5, count(rank) FILTER (rank <= 10) / n_relevant AS recall_10, coalesce(1 / min(rank), 0) AS mrr,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM g LEFT JOIN h USING (query_id) GROUP BY query_id, n_relevant)
SELECT query_id, n_relevant, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m"""


@query("flagship_retrieval", FLAGSHIP)
def flagship_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, two lexical branches, RRF, and recall against the chunks that hold the question's passage."""
    questions, chunks = benchmark_questions(spark, sf_dir), document_chunks(spark, sf_dir)
    fused = R.rrf_fuse(L.lexical_branches(questions, chunks, 18)).withColumn("rrf_score", F.round("rrf_score", 9)).drop("pre_rerank_rank")
    results = R.ranked(fused, ["query_id"], "rrf_score", "chunk_id")
    return L.retrieval_metrics(results, passages(questions, chunks)).select("query_id", "n_relevant", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg")])


def passages(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, chunk_id`` where the chunk contains the question's text; candidates share its second to fourth words between blanks.

    These words have blanks on both sides, so a chunk that contains the question has them whole, whatever precedes its first and follows
    its last word. Questions of fewer than five words are looked for in every chunk. While the questions are few by count, a chunk's runs that are in no
    question are left out before they become rows.
    """
    own = F.split("question", " ")
    joined = lambda a, b: F.concat_ws(" ", a, b)
    asked = questions.where("question is not null").withColumns({"n": F.size(own), "key": F.xxhash64(F.array_join(F.slice(own, 2, 3), " "))})
    few, asked = asked.where("n < 5").select("query_id", "question"), asked.where("n >= 5").drop("n")
    words = F.split("content", " ")
    runs = F.zip_with(F.zip_with(words, F.slice(words, 2, F.size(words)), joined), F.slice(words, 3, F.size(words)), joined)
    keys = F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))
    small, kept = is_small(asked, MAX_PASSAGE_QUESTIONS), chunks
    if small:
        kept = chunks.crossJoin(F.broadcast(asked.agg(F.collect_set("key").alias("known"))))  # one row
        keys = F.array_intersect(keys, "known")
    marked = kept.select("chunk_id", "content", F.explode(keys).alias("key"))
    found = marked.join(F.broadcast(asked) if small else asked, "key").where(F.col("content").contains(F.col("question"))).select("query_id", "chunk_id")
    if not few.isEmpty():
        found = found.union(chunks.join(few, F.col("content").contains(F.col("question"))).select("query_id", "chunk_id"))
    return found.distinct()


KNN = """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(qe::DOUBLE[], embedding::DOUBLE[]) AS s FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""


def vector_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set (every 50th vector) and all vectors."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e


@query("knn_join", KNN)
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = vector_queries(spark, sf_dir)
    return V.knn_join(q, e, 10, drop_same=True).select("query_id", "vec_id", "rank")


@query("ann_join")
def ann_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = vector_queries(spark, sf_dir)
    return V.ann_join(q, e, 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("knn_label_metrics", KNN.replace("SELECT query_id, vec_id, row_number", ", k AS (SELECT query_id, vec_id, row_number").replace("QUALIFY rank <= 10", "QUALIFY rank <= 10)") + """,
rel AS (SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), g AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY ALL),
h AS (SELECT query_id, rank FROM k JOIN rel USING (query_id, vec_id))
SELECT query_id, n_relevant, round(count(rank) FILTER (rank <= 5) / n_relevant, 6) AS recall_5, round(count(rank) / n_relevant, 6) AS recall_10, round(coalesce(1 / min(rank), 0), 6) AS mrr,
round(coalesce(sum(1 / log2(rank + 1)), 0) / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM g LEFT JOIN h USING (query_id) GROUP BY query_id, n_relevant""")
def knn_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = vector_queries(spark, sf_dir)
    found = materialize(V.knn_join(q, e, 10, drop_same=True), "found")
    label = e.select("vec_id", "label").distinct()
    mine = label.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    counts = mine.join(label.groupBy("label").agg((F.count("*") - 1).alias("n_relevant")), "label").where("n_relevant > 0").select("query_id", "n_relevant")
    relevant = found.select("query_id", "vec_id").join(mine, "query_id").join(label, ["vec_id", "label"]).select("query_id", "vec_id")
    return L.retrieval_metrics(found, relevant, "vec_id", counts=counts).select("query_id", "n_relevant", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg")])


@query("valid_vectors", "SELECT label, count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda v: v <> 0)) > 0) AS kept, count(*) FILTER (NOT (len(embedding) = 64 AND len(list_filter(embedding, lambda v: v <> 0)) > 0)) AS skipped FROM embeddings GROUP BY label")
def valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = V.valid_vectors(read_table(spark, sf_dir, "embeddings"), 64)
    return read_table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("skipped"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "hits_v")


def rank_query(name: str, oracle: str):
    """Registers a query over the hits view."""

    def put(f):
        return query(name, with_views(oracle))(lambda spark, sf_dir: f(hits(spark, sf_dir)))

    return put


R1 = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY score DESC, chunk_id) AS r FROM hits_v)"
FUSED = f"{R1}, f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 12) AS rrf_score, list_sort(list(DISTINCT branch)) AS sources FROM r GROUP BY ALL)"


@rank_query("rrf_fuse", f"WITH {FUSED} SELECT query_id, chunk_id, round(rrf_score, 9) AS rrf_score, array_to_string(sources, ',') AS sources, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS pre_rerank_rank FROM f")
def rrf_fuse(h: DataFrame) -> DataFrame:
    return R.rrf_fuse(h).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.array_join("sources", ",").alias("sources"), "pre_rerank_rank")


@rank_query("weighted_rrf", f"WITH {R1}, f AS (SELECT query_id, paper_id, page_num, chunk_id, sum(CASE branch WHEN 'dense' THEN 0.55 ELSE 0.25 END / (60 + r)) AS s, list_sort(list(branch || ':' || r)) AS b FROM r WHERE branch <> 'graph' GROUP BY ALL) SELECT query_id, paper_id, page_num, chunk_id, round(s, 9) AS rrf_score, array_to_string(b, ',') AS branch_ranks, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS fused_rank FROM f")
def weighted_rrf(h: DataFrame) -> DataFrame:
    out = R.weighted_rrf(h, {"dense": 0.55, "sparse": 0.25, "graph": 0.0}, key=["paper_id", "page_num", "chunk_id"])
    ranks = F.array_join(F.transform(F.map_entries("branch_ranks"), lambda e: F.concat_ws(":", e.key, e.value)), ",")
    return out.select("query_id", "paper_id", "page_num", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), ranks.alias("branch_ranks"), "fused_rank")


@rank_query("hybrid_score", "SELECT query_id, chunk_id, round(greatest(0, least(1, 0.75 * greatest(0, least(1, vector_score)) + 0.25 * greatest(0, least(1, score)))), 6) AS hybrid FROM hits_v")
def hybrid_score(h: DataFrame) -> DataFrame:
    return h.select("query_id", "chunk_id", F.round(R.hybrid_score(F.col("vector_score"), F.col("score")), 6).alias("hybrid"))


@rank_query("balance", f"""WITH {FUSED}, k AS (SELECT f.query_id, f.chunk_id, h.paper_id, CASE WHEN f.query_id % 2 = 0 THEN 'compare' ELSE 'fact' END AS family, row_number() OVER (PARTITION BY f.query_id ORDER BY rrf_score DESC, f.chunk_id) AS p FROM f JOIN hits_v h USING (query_id, chunk_id)),
m AS (SELECT *, family = 'compare' AND row_number() OVER (PARTITION BY query_id, paper_id ORDER BY p) <= 2 AS first FROM k)
SELECT query_id, chunk_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, CASE WHEN first THEN paper_id END, p) AS balanced_rank FROM m QUALIFY balanced_rank <= 30""")
def balance(h: DataFrame) -> DataFrame:
    family = F.when(F.col("query_id") % 2 == 0, "compare").otherwise("fact")
    cands = R.rrf_fuse(h).join(h.select("query_id", "chunk_id", "paper_id"), ["query_id", "chunk_id"]).withColumn("family", family)
    return R.balance(cands, most=30).select("query_id", "chunk_id", "paper_id", "balanced_rank")


@rank_query("candidate_pool", """WITH l AS (SELECT query_id, CASE branch WHEN 'dense' THEN 1 WHEN 'sparse' THEN 2 ELSE 3 END AS list_no, page_num AS pos, chunk_id FROM hits_v UNION ALL SELECT query_id, 4, page_num, chunk_id FROM hits_v WHERE score > 0.5),
f AS (SELECT query_id, chunk_id, min(list_no * 100 + pos) AS a FROM l GROUP BY ALL) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY a, chunk_id) AS pool_rank FROM f QUALIFY pool_rank <= 25""")
def candidate_pool(h: DataFrame) -> DataFrame:
    no = F.when(F.col("branch") == "dense", 1).when(F.col("branch") == "sparse", 2).otherwise(3)
    places = F.array_compact(F.array(F.struct(no.alias("list_no"), F.col("page_num").alias("pos")), F.when(F.col("score") > 0.5, F.struct(F.lit(4).alias("list_no"), F.col("page_num").alias("pos")))))
    return R.candidate_pool(h.select("query_id", "chunk_id", F.explode(places).alias("at")).select("query_id", "at.*", "chunk_id"), 25)


DEDUPE = "WITH d AS (SELECT * FROM hits_v QUALIFY row_number() OVER (PARTITION BY query_id, {key} ORDER BY score DESC, chunk_id) = 1) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d QUALIFY rank <= 20"


@rank_query("dedupe_hits", DEDUPE.format(key="paper_id, content_type, page_num"))
def dedupe_hits(h: DataFrame) -> DataFrame:
    return R.dedupe_hits(h, ["paper_id", "content_type", "page_num"]).select("query_id", "chunk_id", "rank")


@rank_query("bundle_dedupe", DEDUPE.format(key="CASE WHEN content_type = 'text' THEN paper_id || ':' || chunk_id ELSE paper_id || ':' || content_type END"))
def bundle_dedupe(h: DataFrame) -> DataFrame:
    ref = F.when(F.col("content_type") == "text", F.col("chunk_id").cast("string")).otherwise(F.col("content_type"))
    return R.dedupe_hits(h, [F.concat_ws(":", "paper_id", ref)]).select("query_id", "chunk_id", "rank")


@rank_query("section_topk", """WITH s AS (SELECT query_id, paper_id, section, max(score) AS m, list(chunk_id ORDER BY score DESC, chunk_id)[1:3] AS c FROM hits_v GROUP BY ALL)
SELECT query_id, paper_id, section, array_to_string(c, ',') AS chunk_ids, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY m DESC, section) AS rank FROM s QUALIFY rank <= 2""")
def section_topk(h: DataFrame) -> DataFrame:
    return R.section_topk(h, 2).select("query_id", "paper_id", "section", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"), "rank")


@rank_query("paper_topk", "WITH p AS (SELECT query_id, paper_id, sum(score) AS s FROM hits_v GROUP BY ALL) SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, paper_id) AS rank FROM p QUALIFY rank <= 5")
def paper_topk(h: DataFrame) -> DataFrame:
    return R.top_k(h.groupBy("query_id", "paper_id").agg(F.round(F.sum("score"), 9).alias("s")), ["query_id"], "s", "paper_id", 5).drop("s")


@rank_query("deterministic_rerank", f"""WITH {FUSED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS p, count(*) OVER (PARTITION BY query_id) AS n FROM f),
m AS (SELECT k.*, CASE WHEN chunk_id % 3 = 0 THEN vector_score END AS ms, 1 - (p - 1) / n AS d FROM k JOIN hits_v USING (query_id, chunk_id)),
o AS (SELECT query_id, chunk_id, p, coalesce(ms, d) AS s, row_number() OVER (PARTITION BY query_id ORDER BY ms IS NOT NULL DESC, ms DESC NULLS LAST, d DESC, chunk_id) AS rerank_rank FROM m)
SELECT query_id, chunk_id, round(s, 6) AS rerank_score, rerank_rank, p - rerank_rank AS rerank_gain FROM o""")
def deterministic_rerank(h: DataFrame) -> DataFrame:
    scores = h.where("chunk_id % 3 = 0").select("query_id", "chunk_id", F.col("vector_score").alias("model_score"))
    out = R.rerank_gain(R.rerank(R.rrf_fuse(h), scores))
    return out.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank", "rerank_gain")


@rank_query("per_paper_budget", """WITH k AS (SELECT * FROM hits_v QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, chunk_id) <= 2),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5) SELECT query_id, paper_id FROM (SELECT DISTINCT query_id, paper_id FROM hits_v) s ANTI JOIN f USING (query_id, paper_id)""")
def per_paper_budget(h: DataFrame) -> DataFrame:
    return R.per_paper_budget(h, h.select("query_id", "paper_id").distinct(), 2, 5)[1]


HYBRID = """s AS (SELECT DISTINCT query_id, paper_id, -paper_id AS ord FROM hits_v WHERE paper_id % 3 < 2), d AS (SELECT query_id, paper_id, chunk_id, ord, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, chunk_id) AS n FROM hits_v JOIN s USING (query_id, paper_id) WHERE branch <> 'sparse' QUALIFY n <= 3),
l AS (SELECT query_id, chunk_id, paper_id, 'dense' AS branch, row_number() OVER (PARTITION BY query_id ORDER BY ord, paper_id, n) AS r FROM d UNION ALL SELECT query_id, chunk_id, paper_id, 'sparse', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM hits_v WHERE page_num < 5),
u AS (SELECT query_id, chunk_id, min(paper_id) AS paper_id, round(sum(1.0 / (60 + r)), 12) AS rrf FROM l GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS pre FROM u QUALIFY pre <= 12), f AS (SELECT * FROM p WHERE pre <= 4)"""


def _hybrid(h: DataFrame) -> tuple[DataFrame, DataFrame]:
    h = materialize(h.select("query_id", "paper_id", "chunk_id", "branch", "page_num", "score"), "hits")
    scope = h.where("paper_id % 3 < 2").select("query_id", "paper_id", (-F.col("paper_id")).alias("ord")).distinct()
    return R.hybrid_retrieval(h.where("branch <> 'sparse'").select("query_id", "paper_id", "chunk_id", "score"), h.where("page_num < 5"), scope, 3, 4)


@rank_query("hybrid_retrieval", f"WITH {HYBRID} SELECT query_id, chunk_id, paper_id, pre AS rank FROM f")
def hybrid_retrieval(h: DataFrame) -> DataFrame:
    return _hybrid(h)[0].select("query_id", "chunk_id", "paper_id", F.col("rerank_rank").alias("rank"))


@rank_query("hybrid_report", f"""WITH {HYBRID}, c AS (SELECT query_id, count(f.paper_id) AS paper_coverage, array_to_string(list_sort(list(s.paper_id) FILTER (f.paper_id IS NULL)), ',') AS missing FROM s LEFT JOIN (SELECT DISTINCT query_id, paper_id FROM f) f USING (query_id, paper_id) GROUP BY 1)
SELECT query_id, paper_coverage, coalesce(missing, '') AS missing, coalesce(dc, 0) AS dense_candidates, coalesce(fc, 0) AS fused_before_rerank FROM c LEFT JOIN (SELECT query_id, count(*) AS dc FROM d GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS fc FROM p GROUP BY 1) USING (query_id)""")
def hybrid_report(h: DataFrame) -> DataFrame:
    out = _hybrid(h)[1]
    return out.select("query_id", "paper_coverage", F.array_join(F.col("missing_papers").cast("array<string>"), ",").alias("missing"), "dense_candidates", "fused_before_rerank")


@rank_query("forced_coverage", """WITH f AS (SELECT query_id, paper_id, chunk_id, score FROM hits_v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5),
m AS (SELECT query_id, paper_id, chunk_id, 0.5 AS score FROM hits_v ANTI JOIN f USING (query_id, paper_id) QUALIFY row_number() OVER (PARTITION BY query_id, paper_id ORDER BY hits_v.score DESC, chunk_id) = 1)
SELECT query_id, paper_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM m) QUALIFY rank <= 8""")
def forced_coverage(h: DataFrame) -> DataFrame:
    slim = h.select("query_id", "paper_id", "chunk_id", "score")
    final = R.top_k(slim, ["query_id"], "score", "chunk_id", 5)
    return R.forced_coverage(final, slim, slim.select("query_id", "paper_id").distinct(), 8).select("query_id", "paper_id", "chunk_id", "rank")


@rank_query("select_display", """WITH t AS (SELECT *, CASE WHEN page_num <> 1 AND content_type <> 'text' THEN 1 WHEN page_num <> 1 THEN 2 WHEN content_type <> 'text' THEN 3 ELSE 4 END AS tier FROM hits_v), b AS (SELECT * FROM t QUALIFY tier = min(tier) OVER (PARTITION BY query_id))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b QUALIFY rank <= 4""")
def select_display(h: DataFrame) -> DataFrame:
    return R.select_display(h.withColumns({"is_summary": F.col("page_num") == 1, "high_signal": F.col("content_type") != "text"}), 4).select("query_id", "chunk_id", "rank")


@rank_query("graph_preferred", "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY paper_id % 4 = 0 DESC, score DESC, chunk_id) AS graph_rank FROM hits_v")
def graph_preferred(h: DataFrame) -> DataFrame:
    return R.graph_preferred(h, h.where("paper_id % 4 = 0")).select("query_id", "chunk_id", "graph_rank")


@rank_query("weak_first_pass", "SELECT query_id, max(score) < 0.52 OR count(*) < 3 AS weak FROM hits_v GROUP BY query_id")
def weak_first_pass(h: DataFrame) -> DataFrame:
    from evidencelake.operators.filters import weak_first_pass as weak

    return weak(h)


@rank_query("merge_packs", "SELECT paper_id, chunk_id, max(score) AS score, min(page_num) FILTER (page_num > 0) AS rank, array_to_string(list_sort(list(DISTINCT 'dimension:' || content_type)), ',') AS sources FROM hits_v GROUP BY ALL")
def merge_packs(h: DataFrame) -> DataFrame:
    out = R.merge_packs(h.withColumns({"dimension": F.col("content_type"), "rank": F.col("page_num")}))
    return out.withColumn("sources", F.array_join("sources", ","))


@rank_query("best_cell", """WITH b AS (SELECT paper_id, content_type AS dimension, chunk_id FROM hits_v WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY paper_id, content_type ORDER BY score DESC, chunk_id) = 1)
SELECT p.paper_id, d.dimension, b.chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'not_enough_evidence' ELSE 'supported' END AS status FROM (SELECT DISTINCT paper_id FROM hits_v) p CROSS JOIN (SELECT unnest(['table', 'figure', 'text', 'caption']) AS dimension) d LEFT JOIN b ON b.paper_id = p.paper_id AND b.dimension = d.dimension""")
def best_cell(h: DataFrame) -> DataFrame:
    dims = h.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("table", "figure", "text", "caption")])).alias("dimension"))
    scored = h.select("paper_id", F.col("content_type").alias("dimension"), "chunk_id", "score")
    return R.best_cell(scored, h, dims).select("paper_id", "dimension", "chunk_id", "status")


@rank_query("evidence_blocks", """WITH a AS (SELECT *, 0 AS part FROM hits_v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 3),
s AS (SELECT *, 1 AS part FROM hits_v QUALIFY row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, chunk_id) <= 2), u AS (SELECT * FROM a UNION ALL SELECT * FROM s ANTI JOIN a USING (query_id, chunk_id))
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY part, score DESC, chunk_id) AS block FROM u QUALIFY block <= 5""")
def evidence_blocks(h: DataFrame) -> DataFrame:
    from evidencelake.operators.usage import evidence_blocks as blocks

    return blocks(h).select("query_id", "chunk_id", "block")


C = "SELECT {} FROM chunks_v"


def chunk_query(name: str, oracle: str):
    """Registers a query over the chunks view."""

    def put(f):
        return query(name, with_views(oracle))(lambda spark, sf_dir: f(frame(spark, sf_dir, "chunks_v")))

    return put


@chunk_query("neighbour_context", "SELECT chunk_id, concat_ws(' … ', substr(lag(content) OVER w, 1, 300), substr(lead(content) OVER w, 1, 300)) AS context FROM chunks_v WINDOW w AS (PARTITION BY paper_id, page_num ORDER BY pos)")
def neighbour_context(c: DataFrame) -> DataFrame:
    return R.neighbour_context(c).select("chunk_id", "context")


@chunk_query("overlap_prefix", "SELECT chunk_id, concat_ws(' ', array_to_string((string_split(lag(content) OVER w, ' '))[-5:], ' '), content) AS content FROM chunks_v WINDOW w AS (PARTITION BY paper_id ORDER BY pos)")
def overlap_prefix(c: DataFrame) -> DataFrame:
    return R.overlap_prefix(c, 5).select("chunk_id", "content")


@chunk_query("next_chunk_edges", "SELECT * FROM (SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY paper_id ORDER BY pos) AS dst FROM chunks_v) WHERE dst IS NOT NULL")
def next_chunk_edges(c: DataFrame) -> DataFrame:
    return R.next_chunk_edges(c)


@chunk_query("stable_chunk_id", "SELECT chunk_id, 'chunk_' || substr(sha1(paper_id || '|' || page_num || '|' || lower(section) || '|' || pos || '|' || (pos + length(content))), 1, 24) AS stable_id, '/read/' || paper_id || '?page=' || page_num || '&source=evidence&source_id=' || chunk_id AS url FROM chunks_v")
def stable_chunk_id(c: DataFrame) -> DataFrame:
    sid = T.stable_chunk_id(F.col("paper_id"), F.col("page_num"), F.lower("section"), F.col("pos"), F.col("pos") + F.length("content"))
    return c.select("chunk_id", sid.alias("stable_id"), T.citation_jump_url(F.col("paper_id"), F.col("chunk_id"), F.col("page_num")).alias("url"))


@chunk_query("evidence_predicate", "SELECT chunk_id FROM chunks_v WHERE (starts_with(section, '4') OR starts_with(section, '1')) AND page_num BETWEEN 1 AND 3 AND content_type IN ('text', 'table')")
def evidence_predicate(c: DataFrame) -> DataFrame:
    from evidencelake.operators.filters import evidence_predicate as pred

    return c.where(pred(section_prefixes=["4", "1"], page_from=1, page_to=3, content_types=["text", "table"])).select("chunk_id")


@chunk_query("canonical_section", """SELECT section, CASE section WHEN 'Abstract' THEN 'abstract' WHEN '1. Introduction' THEN 'introduction' WHEN '2 Methodology' THEN 'method' WHEN '3. Experimental Setup' THEN 'experiment' WHEN '4 Results' THEN 'result' WHEN 'Future Work' THEN 'limitation' ELSE 'appendix' END AS canonical, count(*) AS n FROM chunks_v GROUP BY ALL""")
def canonical_section(c: DataFrame) -> DataFrame:
    return c.groupBy("section").agg(F.count("*").alias("n")).select("section", T.canonical_section(F.col("section")).alias("canonical"), "n")


@chunk_query("chunk_counts", "SELECT paper_id, count(*) AS n_chunks FROM chunks_v GROUP BY paper_id")
def chunk_counts(c: DataFrame) -> DataFrame:
    return c.groupBy("paper_id").agg(F.count("*").alias("n_chunks"))


@query("candidate_union_check", with_views("SELECT query_id, count(DISTINCT paper_id) AS papers, count(*) AS hits, max(score) AS top FROM hits_v GROUP BY query_id"))
def candidate_union_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, "SELECT query_id, count(DISTINCT paper_id) AS papers, count(*) AS hits, max(score) AS top FROM hits_v GROUP BY query_id")
