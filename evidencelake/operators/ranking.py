"""E: fusion, balancing, deduplication and top-k, for all queries at once.

Every order ends in a unique id, so ranks do not depend on input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidencelake.operators.filters import clamp
from evidencelake.scratch import broadcast_if_small

MAX_DIMENSIONS = 10_000

#: Families whose candidates are balanced over papers (fixed values).
BALANCED = ("compare", "cross_paper", "survey", "related_work", "method_evolution", "conflicting_evidence")


def ranked(df: DataFrame, by: list[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    """Adds ``name``: 1, 2, ... within ``by``, best score first, then the lower id."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def top_k(df: DataFrame, by: list[str], score: str, tie: str, k: int, name: str = "rank") -> DataFrame:
    """The k best rows of each group; Spark cuts to k before the shuffle where it can."""
    return ranked(df, by, score, tie, name).where(F.col(name) <= k)


def rrf_fuse(branches: DataFrame, k: int = 60) -> DataFrame:
    """E-1: ``query_id, chunk_id, rrf_score, sources, pre_rerank_rank`` from ``query_id, branch, chunk_id, score``."""
    one = ranked(branches, ["query_id", "branch"], "score", "chunk_id")
    fused = one.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.sort_array(F.collect_set("branch")).alias("sources"))
    return ranked(fused, ["query_id"], "rrf_score", "chunk_id", "pre_rerank_rank")


def weighted_rrf(branches: DataFrame, weights: dict[str, float], k: int = 60, key: list[str] | None = None) -> DataFrame:
    """E-2, E-3: weighted fusion over ``branch``; branches of weight 0 or less are left out; ``branch_ranks`` maps branch to rank."""
    key = key or ["chunk_id"]
    w = F.create_map(*[F.lit(x) for b, v in weights.items() if v > 0 for x in (b, float(v))])
    known = branches.withColumn("weight", w[F.col("branch")]).where("weight is not null")
    one = ranked(known, ["query_id", "branch"], "score", "chunk_id")
    fused = one.groupBy("query_id", *key).agg(
        F.sum(F.col("weight") / (k + F.col("rank"))).alias("rrf_score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("branch", "rank")))).alias("branch_ranks")
    )
    return ranked(fused, ["query_id"], "rrf_score", key[-1], "fused_rank")


def hybrid_score(vector: Column, sparse: Column, weight: float = 0.75) -> Column:
    """E-4: weighted sum of two clamped scores."""
    return clamp(weight * clamp(vector) + (1 - weight) * clamp(sparse))


def balance(cands: DataFrame, quota: int = 2, most: int = 180) -> DataFrame:
    """E-5: for balanced families the first ``quota`` of each paper (papers by id), then the rest in order; else the head.

    ``cands``: ``query_id, family, paper_id, chunk_id, pre_rerank_rank``; adds ``balanced_rank``.
    """
    in_paper = F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy("pre_rerank_rank"))
    marked = cands.withColumn("__first", F.col("family").isin(*BALANCED) & (in_paper <= quota))
    order = [F.desc("__first"), F.when(F.col("__first"), F.col("paper_id")), "pre_rerank_rank"]
    out = marked.withColumn("balanced_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out.where(F.col("balanced_rank") <= most).drop("__first")


def candidate_pool(lists: DataFrame, most: int = 180) -> DataFrame:
    """E-6: ``query_id, list_no, pos, chunk_id`` joined in order, first sight of each chunk."""
    first = lists.groupBy("query_id", "chunk_id").agg(F.min(F.struct("list_no", "pos")).alias("at"))
    out = first.withColumn("pool_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "chunk_id")))
    return out.where(F.col("pool_rank") <= most).select("query_id", "chunk_id", "pool_rank")


def dedupe_hits(hits: DataFrame, key: list, most: int = 20) -> DataFrame:
    """E-7, E-8: the best hit of each key, then the ``most`` best of each query."""
    named = hits.withColumns({f"__k{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(key)})
    names = [f"__k{i}" for i in range(len(key))]
    best = top_k(named, ["query_id", *names], "score", "chunk_id", 1, "__n").drop("__n", *names)
    return top_k(best, ["query_id"], "score", "chunk_id", most)


def section_topk(hits: DataFrame, k: int = 5, chunks: int = 3) -> DataFrame:
    """E-9: the k best sections of each query and paper by their best chunk, with up to ``chunks`` chunk ids."""
    sections = hits.groupBy("query_id", "paper_id", "section").agg(F.max("score").alias("score"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id"))), 1, chunks).alias("best"))
    out = top_k(sections, ["query_id", "paper_id"], "score", "section", k)
    return out.withColumn("chunk_ids", F.transform("best", lambda x: x.chunk_id)).drop("best")


def deterministic_rerank(cands: DataFrame) -> DataFrame:
    """E-11: ``rerank_score`` = 1 - (rank - 1) / n by fused score."""
    out = ranked(cands, ["query_id"], "rrf_score", "chunk_id", "rerank_rank")
    return out.withColumn("rerank_score", 1 - (F.col("rerank_rank") - 1) / F.count("*").over(Window.partitionBy("query_id")))


def rerank(cands: DataFrame, scores: DataFrame) -> DataFrame:
    """E-12: scores of a model where it gave one, else below them all in fused order."""
    both = deterministic_rerank(cands).drop("rerank_rank").join(scores.select("query_id", "chunk_id", F.col("model_score")), ["query_id", "chunk_id"], "left")
    order = [F.desc(F.col("model_score").isNotNull()), F.desc("model_score"), F.desc("rerank_score"), "chunk_id"]
    out = both.withColumn("rerank_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out.withColumn("rerank_score", F.coalesce("model_score", "rerank_score"))


def rerank_gain(df: DataFrame) -> DataFrame:
    """E-13: ranks gained where both ranks are positive, else 0."""
    gain = F.when((F.col("pre_rerank_rank") > 0) & (F.col("rerank_rank") > 0), F.col("pre_rerank_rank") - F.col("rerank_rank")).otherwise(0)
    return df.withColumn("rerank_gain", gain)


def per_paper_budget(hits: DataFrame, scope: DataFrame, budget: int = 8, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """E-14: the best ``budget`` chunks of each paper, then k of the query; and the scoped papers left without one."""
    kept = top_k(hits, ["query_id", "paper_id"], "score", "chunk_id", budget, "paper_rank")
    final = top_k(kept, ["query_id"], "score", "chunk_id", k)
    return final, scope.join(final.select("query_id", "paper_id"), ["query_id", "paper_id"], "left_anti")


def hybrid_retrieval(dense: DataFrame, sparse: DataFrame, scope: DataFrame, budget: int = 8, k: int = 10, scores: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """E-14: the final candidates ``query_id, chunk_id, paper_id, rrf_score, pre_rerank_rank, rerank_rank, rerank_score, rerank_gain`` and a report of each query.

    Each paper of a query's ``scope(query_id, paper_id, ord)`` gives its best ``budget`` dense hits (``query_id, paper_id, chunk_id, score``), one paper after another by ``ord``; that list and the sparse one
    are fused by rank, cut to 3 k, reranked (by ``scores(query_id, chunk_id, model_score)`` if there are any) and cut to ``k``. The report: ``dense_candidates, fused_before_rerank, paper_coverage,
    missing_papers`` (ids of the scope that no final candidate has).
    """
    kept = top_k(dense.join(scope, ["query_id", "paper_id"]), ["query_id", "paper_id"], "score", "chunk_id", budget, "__n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "paper_id", "__n"))
    lists = kept.select("query_id", "chunk_id", "paper_id", F.lit("dense").alias("branch"), (-place).alias("score")).unionByName(sparse.select("query_id", "chunk_id", "paper_id", F.lit("sparse").alias("branch"), "score"))
    papers = lists.groupBy("query_id", "chunk_id").agg(F.min("paper_id").alias("paper_id"))
    pre = rrf_fuse(lists).where(F.col("pre_rerank_rank") <= 3 * k)
    reranked = rerank(pre, scores) if scores is not None else deterministic_rerank(pre)
    final = rerank_gain(reranked).where(F.col("rerank_rank") <= k).join(papers, ["query_id", "chunk_id"])
    final = final.select("query_id", "chunk_id", "paper_id", "rrf_score", "pre_rerank_rank", "rerank_rank", "rerank_score", "rerank_gain")
    missing = scope.join(final.select("query_id", "paper_id").distinct().withColumn("__in", F.lit(1)), ["query_id", "paper_id"], "left")
    per = missing.groupBy("query_id").agg(F.count("__in").alias("paper_coverage"), F.sort_array(F.collect_set(F.when(F.col("__in").isNull(), F.col("paper_id")))).alias("missing_papers"))
    counts = kept.groupBy("query_id").agg(F.count("*").alias("dense_candidates")).join(pre.groupBy("query_id").agg(F.count("*").alias("fused_before_rerank")), "query_id", "full")
    return final, per.join(counts, "query_id", "left").na.fill(0, ["dense_candidates", "fused_before_rerank"])


def forced_coverage(final: DataFrame, hits: DataFrame, scope: DataFrame, k: int) -> DataFrame:
    """E-15: scoped papers absent from ``final`` give their best chunk at score 0.5; trimmed to k with these kept first in line by score."""
    missing = scope.join(final.select("query_id", "paper_id"), ["query_id", "paper_id"], "left_anti")
    best = top_k(hits.join(missing, ["query_id", "paper_id"], "left_semi"), ["query_id", "paper_id"], "score", "chunk_id", 1, "__n").drop("__n")
    forced = best.withColumns({"score": F.lit(0.5), "forced": F.lit(True)})
    return top_k(final.drop("rank").withColumn("forced", F.lit(False)).unionByName(forced, allowMissingColumns=True), ["query_id"], "score", "chunk_id", k)


def select_display(hits: DataFrame, k: int) -> DataFrame:
    """E-16: of four tiers (signal without summary, without summary, signal, all) the first that has hits in each query."""
    tier = F.when(~F.col("is_summary") & F.col("high_signal"), 1).when(~F.col("is_summary"), 2).when(F.col("high_signal"), 3).otherwise(4)
    marked = hits.withColumn("__tier", tier).withColumn("__best", F.min("__tier").over(Window.partitionBy("query_id")))
    return top_k(marked.where("__tier = __best").drop("__tier", "__best"), ["query_id"], "score", "chunk_id", k)


def graph_preferred(hits: DataFrame, graph_papers: DataFrame) -> DataFrame:
    """E-17: hits of papers in the graph set first, each part in its order."""
    marked = hits.join(graph_papers.select("query_id", "paper_id").distinct().withColumn("in_graph", F.lit(True)), ["query_id", "paper_id"], "left")
    marked = marked.withColumn("in_graph", F.coalesce("in_graph", F.lit(False)))
    return marked.withColumn("graph_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("in_graph"), F.desc("score"), "chunk_id")))


def latest_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """E-18: the last row of each key by a total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def neighbour_context(chunks: DataFrame, most: int = 300) -> DataFrame:
    """E-19: texts of the chunks before and after on the same page, cut and joined by " … "."""
    w = Window.partitionBy("paper_id", "page_num").orderBy("pos")
    around = [F.substring(f("content").over(w), 1, most) for f in (F.lag, F.lead)]
    return chunks.withColumn("context", F.concat_ws(" … ", *around))


def overlap_prefix(chunks: DataFrame, words: int = 100) -> DataFrame:
    """E-20: each chunk with the last ``words`` words of the one before it in front."""
    before = F.split(F.lag("content").over(Window.partitionBy("paper_id").orderBy("pos")), " ")
    return chunks.withColumn("content", F.concat_ws(" ", F.array_join(F.slice(before, F.greatest(F.size(before) - words + 1, F.lit(1)), words), " "), "content"))


def next_chunk_edges(chunks: DataFrame) -> DataFrame:
    """E-21: ``src, dst`` of chunks that follow each other in a paper."""
    out = chunks.select(F.col("chunk_id").alias("src"), F.lead("chunk_id").over(Window.partitionBy("paper_id").orderBy("pos")).alias("dst"))
    return out.where("dst is not null")


def best_cell(scored: DataFrame, papers: DataFrame, dimensions: DataFrame) -> DataFrame:
    """E-22: for each paper and dimension the best candidate of positive score, else ``not_enough_evidence``; the dimensions go to all tasks if few by count."""
    best = top_k(scored.where("score > 0"), ["paper_id", "dimension"], "score", "chunk_id", 1).drop("rank")
    grid = papers.select("paper_id").distinct().crossJoin(broadcast_if_small(dimensions.select("dimension").distinct(), MAX_DIMENSIONS))
    out = grid.join(best, ["paper_id", "dimension"], "left")
    return out.withColumn("status", F.when(F.col("chunk_id").isNull(), "not_enough_evidence").otherwise("supported"))


def merge_packs(packs: DataFrame) -> DataFrame:
    """E-23: one row for each paper and chunk: highest scores, lowest positive rank, all dimensions as sources."""
    return packs.groupBy("paper_id", "chunk_id").agg(
        F.max("score").alias("score"), F.min(F.when(F.col("rank") > 0, F.col("rank"))).alias("rank"), F.sort_array(F.collect_set(F.concat(F.lit("dimension:"), "dimension"))).alias("sources")
    )


def unique_title(papers: DataFrame) -> DataFrame:
    """E-25: repeated titles of a user get " (v2)", " (v3)", ... in order of id."""
    n = F.row_number().over(Window.partitionBy("user_id", "title").orderBy("paper_id"))
    return papers.withColumn("unique_title", F.when(n > 1, F.concat("title", F.lit(" (v"), n.cast("string"), F.lit(")"))).otherwise(F.col("title")))


def paper_rank_score(citations: Column, age: Column, relevance: Column) -> Column:
    """E-26: 0.5 min(log10(c + 1) / 5, 1) + 0.3 exp(-age / 10) + 0.2 relevance."""
    return 0.5 * F.least(F.log10(citations + 1) / 5, F.lit(1.0)) + 0.3 * F.exp(-age / 10) + 0.2 * relevance


def session_context(messages: DataFrame, window: int = 20, budget: int = 4000) -> DataFrame:
    """E-27: of each session's last messages: how many matter (user or system), the rest, the token estimate and whether it is over budget."""
    last = messages.withColumn("__n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("__n") <= window)
    important = F.col("role").isin("user", "system") | F.coalesce(F.lower("text").rlike("decid|decision|\\[[^\\[\\],]+,"), F.lit(False))
    tokens = F.sum(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4))
    return last.groupBy("conv_id").agg(F.count_if(important).alias("important"), F.count_if(~important).alias("secondary"), tokens.alias("tokens"), (tokens > budget).alias("over_budget"))
