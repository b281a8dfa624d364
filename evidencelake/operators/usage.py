"""D: counts, trends, costs and reports over many users and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidencelake.operators.ranking import top_k
from evidencelake.scratch import broadcast_if_small, materialize

#: Accuracy of approximate percentiles, groups that are broadcast, and rows up to which a group is ranked whole.
ACCURACY, MAX_GROUPS, SMALL_GROUP = 10_000, 1_000_000, 50_000


def user_stats(papers: DataFrame, usage: DataFrame) -> DataFrame:
    """D-1: papers (all, starred, by status) and tokens of each user in one pass over each source."""
    p = papers.groupBy("user_id").agg(F.count("*").alias("papers"), F.count_if("starred").alias("starred"), F.count_if(F.col("status") == "P").alias("processing"), F.count_if(F.col("status") == "F").alias("completed"))
    u = usage.groupBy("user_id").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return p.join(u, "user_id", "full").na.fill(0)


def daily_trend(events: DataFrame, now: str, days: int = 7) -> DataFrame:
    """D-2: events on each of the last days up to ``now``; days without any are 0."""
    end = F.to_date(F.lit(now))
    calendar = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    n = events.where(F.to_date("ts").between(F.date_sub(end, days - 1), end)).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def reading_stats(progress: DataFrame) -> DataFrame:
    """D-3: papers with progress, pages read, completed, and the mean of the rounded, capped percentages."""
    percent = F.least(F.lit(100), F.bround(F.col("current_page") / F.col("total_pages") * 100).cast("int"))
    share = F.when(F.col("total_pages") > 0, percent)
    return progress.groupBy("user_id").agg(F.count("*").alias("papers"), F.sum("current_page").alias("pages"), F.count_if((F.col("total_pages") > 0) & (F.col("current_page") >= F.col("total_pages"))).alias("completed"), F.avg(share).alias("mean_percent"))


def recent_papers(progress: DataFrame, papers: DataFrame, n: int = 5) -> DataFrame:
    """D-4: each user's n last-read papers with titles."""
    last = top_k(progress, ["user_id"], "last_read_at", "paper_id", n)
    return last.join(papers.select("paper_id", "title"), "paper_id")


def usage_cost(usage: DataFrame, prices: dict[str, float]) -> DataFrame:
    """D-5: cost of each request in decimals; an unknown model costs 0."""
    table = F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, str(p))])
    price = F.coalesce(table[F.col("model")].cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    return usage.withColumn("cost", (F.col("tokens").cast("decimal(18,0)") * price / 1000000).cast("decimal(18,6)"))


def monthly_usage(costs: DataFrame) -> DataFrame:
    """D-6: tokens of each day and, with a null day, each month of a user."""
    keyed = costs.select("user_id", F.date_format("ts", "yyyy-MM").alias("month"), F.to_date("ts").alias("day"), "tokens")
    return keyed.rollup("user_id", "month", "day").agg(F.sum("tokens").alias("tokens"), F.grouping_id().alias("g")).where("g < 3").select("user_id", "month", "day", "tokens")


def over_budget(costs: DataFrame, most: float) -> DataFrame:
    """D-7: users and days whose cost reaches ``most``."""
    return costs.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("cost").alias("cost")).where(F.col("cost") >= most)


def count_levels(df: DataFrame, level: Column, levels: list[str]) -> DataFrame:
    """D-8: rows of each level; levels without rows are 0."""
    return df.agg(*[F.count_if(level == v).alias(v) for v in levels])


def percentile_nearest(df: DataFrame, by: list[str], value: str, p: float = 0.95) -> DataFrame:
    """D-16: the value at index max(int(p n) - 1, 0) of the sorted values of each group, exactly, without sorting a group.

    In a group of SMALL_GROUP rows or more an approximate percentile bounds the place from both sides with room for its error; values below
    are counted, and only the few between, pre-aggregated to distinct values, are ranked. Rows with a null value or group do not count.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    near = [max(0.0, p - 3 / ACCURACY), min(1.0, p + 3 / ACCURACY)]
    bounds = known.groupBy(*by).agg(F.percentile_approx("__v", near, ACCURACY).alias("__b"), F.count("*").alias("__n"))
    end = lambda i: F.when(F.col("__n") >= SMALL_GROUP, F.get("__b", F.lit(i)))
    bounds = bounds.select(*by, end(0).alias("__lo"), end(1).alias("__hi"), F.greatest(F.floor(F.col("__n") * p), F.lit(1)).alias("__at"))
    at = materialize(bounds, "percentile-bounds")
    met = known.join(broadcast_if_small(at, MAX_GROUPS), by) if by else known.crossJoin(F.broadcast(at))  # one row
    inside = met.where("(__lo is null or __v >= __lo) and (__hi is null or __v <= __hi)").groupBy(*by, "__v").agg(F.count("*").alias("__c"), F.first("__at").alias("__at"))
    below = met.where("__v < __lo").groupBy(*by).agg(F.count("*").alias("__below"))
    both = inside.join(below, by, "left") if by else inside.crossJoin(F.broadcast(below))
    up_to = F.coalesce("__below", F.lit(0)) + F.sum("__c").over(Window.partitionBy(*by).orderBy("__v"))
    return both.withColumn("__r", up_to).where("__r >= __at and __r - __c < __at").select(*by, F.col("__v").alias("p_value"))


def suite_report(cases: DataFrame, exact: bool = True) -> DataFrame:
    """D-17, D-18: cases, success rate and interpolated latency percentiles of each family; without ``exact`` approximate ones, in bounded memory."""
    percentile = F.percentile if exact else lambda c, q: F.percentile_approx(c, q, ACCURACY)
    return cases.groupBy("family").agg(
        F.count("*").alias("n"), F.count_if("passed").alias("passed"), (F.count_if("passed") / F.count("*")).alias("success_rate"),
        percentile("latency_ms", 0.5).alias("p50"), percentile("latency_ms", 0.95).alias("p95"), F.avg("latency_ms").alias("mean_latency"),
    )


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each metric: ``keys, metric, value``."""
    return df.unpivot(keys, metrics, "metric", "value")


def metric_means(df: DataFrame, metrics: list[str]) -> DataFrame:
    """D-22: means with missing values as 0."""
    return df.agg(*[F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(m) for m in metrics])


def stack_matrix(runs: DataFrame) -> DataFrame:
    """D-24: mean score of each dataset and stack with and without reranker, and the gain."""
    out = runs.groupBy("dataset", "stack").pivot("reranker", ["off", "on"]).agg(F.avg("score"))
    return out.withColumn("gain", F.col("on") - F.col("off"))


def title_themes(papers: DataFrame, by: str, n: int = 6, stop: tuple[str, ...] = ("with", "from", "that", "this", "study", "using")) -> DataFrame:
    """D-25: the most frequent title tokens of four letters or more in each group, first seen first on ties."""
    each = papers.select(by, "paper_id", F.posexplode(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{4,})"), 1)).alias("pos", "token")).where(~F.col("token").isin(*stop))
    count = each.groupBy(by, "token").agg(F.count("*").alias("n"), F.min(F.struct("paper_id", "pos")).alias("first"))
    return top_k(count, [by], "n", "first", n).select(by, "token", "n", "rank")


def batch_status(jobs: DataFrame) -> DataFrame:
    """D-12, D-30: counts by status and the batch's own status."""
    n = lambda s: F.count_if(F.col("status") == s)
    c = jobs.groupBy("batch_id").agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), n("cancelled").alias("cancelled"))
    state = F.when(F.col("completed") == F.col("total"), "completed").when(F.col("failed") == F.col("total"), "failed").when(F.col("cancelled") == F.col("total"), "cancelled")
    state = state.when(F.col("completed") + F.col("failed") + F.col("cancelled") == F.col("total"), "partial").otherwise("running")
    return c.withColumn("batch_status", state)


def evidence_blocks(hits: DataFrame, blocks: int = 5) -> DataFrame:
    """D-27: the three best of each query, then the two best of each section, up to ``blocks`` in all."""
    best = top_k(hits, ["query_id"], "score", "chunk_id", 3).select("query_id", "chunk_id", "section", "score", F.lit(0).alias("part"))
    by_section = top_k(hits, ["query_id", "section"], "score", "chunk_id", 2).select("query_id", "chunk_id", "section", "score", F.lit(1).alias("part"))
    one = best.unionByName(by_section.join(best.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"))
    w = Window.partitionBy("query_id").orderBy("part", F.desc("score"), "chunk_id")
    return one.withColumn("block", F.row_number().over(w)).where(F.col("block") <= blocks)


def all_of(parts: list[Column]) -> Column:
    """AND of conditions."""
    return reduce(lambda a, b: a & b, parts)


def family_breakdown(metrics: DataFrame, families: DataFrame) -> DataFrame:
    """D-15: for each query family the queries and the means of recall at 10, NDCG at 10, paper and chunk hits; a query without family counts as ``fact``."""
    both = metrics.join(families.select("query_id", "family"), "query_id", "left").withColumn("family", F.coalesce("family", F.lit("fact")))
    return both.groupBy("family").agg(F.count("*").alias("queries"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("recall_10", "ndcg", "paper_hit", "chunk_hit")])
