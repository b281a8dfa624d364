"""H-14 to H-32: run gates, diffs, annotation and chunk checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidencelake.operators.usage import long_metrics, percentile_nearest
from evidencelake.scratch import broadcast_if_small

MAX_FAMILIES = 1_000_000

#: Release limits: metric, at least or at most, value (fixed values).
THRESHOLDS = [("recall_at_5", "min", 0.75), ("citation_coverage", "min", 0.85), ("unsupported_rate", "max", 0.1), ("consistency", "min", 0.65), ("latency_p95", "max", 8.0)]


def gate(runs: DataFrame, thresholds: list[tuple[str, str, float]] = THRESHOLDS) -> DataFrame:
    """H-20: ``run_id, verdict, reasons``: every limit that a run breaks; a missing metric breaks its limit."""
    limits = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("kind"), F.lit(float(v)).alias("limit")) for m, k, v in thresholds])
    values = F.create_map(*[x for m, _, _ in thresholds for x in (F.lit(m), F.col(m).cast("double"))])
    broken = F.filter(limits, lambda t: F.coalesce(F.when(t.kind == "min", F.element_at(values, t.metric) < t.limit).otherwise(F.element_at(values, t.metric) > t.limit), F.lit(True)))
    reasons = F.transform(broken, lambda t: F.concat_ws(" ", t.metric, t.kind, t.limit.cast("string")))
    return runs.select("run_id", F.when(F.size(broken) == 0, "pass").otherwise("blocked").alias("verdict"), reasons.alias("reasons"))


def metric_diff(base: DataFrame, cand: DataFrame, higher_is_better: list[str], lower_is_better: list[str], keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """H-21: delta and status of each metric, by its direction."""
    metrics = higher_is_better + lower_is_better
    b = long_metrics(base, keys, metrics).withColumnRenamed("value", "base")
    both = b.join(long_metrics(cand, keys, metrics), [*keys, "metric"]).withColumn("delta", F.col("value") - F.col("base"))
    gain = F.when(F.col("metric").isin(higher_is_better), F.col("delta")).otherwise(-F.col("delta"))
    return both.withColumn("status", F.when(gain > tolerance, "improved").when(gain < -tolerance, "regressed").otherwise("same"))


def comparative_verdict(delta_coverage: Column, delta_unsupported: Column, delta_latency: Column, mismatched: Column) -> Column:
    """H-22: fail, experiment_only, warn or pass."""
    return F.when(mismatched > 0, "fail").when((delta_coverage < -0.02) | (delta_unsupported > 0.02), "fail").when(delta_latency > 1000, "experiment_only").when((delta_coverage < 0) | (delta_unsupported > 0), "warn").otherwise("pass")


def failure_bucket(paper_hit: Column, section_hit: Column, oracle_hit: Column, exact_hit: Column) -> Column:
    """H-19: where a recall run failed first."""
    return F.when(~paper_hit, "paper_miss").when(~section_hit, "section_miss").when(~oracle_hit, "candidate_pool_miss").when(~exact_hit, "exact_miss").otherwise("pass")


def retrieval_failure(n_results: Column, expects: Column, paper_hit: Column, section_hit: Column, chunk_hit: Column) -> Column:
    """H-19: where retrieval failed first; empty where it did not. Hits are true where nothing of the kind was expected; ``expects``: anything was."""
    return F.when(n_results == 0, "retrieval_miss").when(~expects, "evaluation_mapping_error").when(~paper_hit, "retrieval_miss").when(~section_hit, "paper_hit_but_section_miss").when(~chunk_hit, "section_hit_but_chunk_miss").otherwise("")


#: Measures of an answered query in the order they are looked at: name, fails at most (le), below (lt) or above (gt), limit, bucket (fixed values).
RECORD_LIMITS = [
    ("paper_hit_rate", "le", 0.0, "paper_miss"), ("section_hit_rate", "le", 0.0, "section_miss"), ("oracle_recall_100", "lt", 0.6, "candidate_pool_miss"), ("rerank_loss", "gt", 0.05, "reranker_miss"),
    ("consistency", "lt", 0.55, "answer_verification_miss"), ("content_type_match", "lt", 0.5, "content_type_miss"), ("numeric_hit_20", "lt", 0.6, "numeric_miss"), ("cross_paper_coverage", "lt", 0.7, "graph_miss"), ("citation_coverage", "lt", 0.75, "citation_miss"),
]


def record_failure(columns: list[str]) -> Column:
    """H-19: the first limit that a record breaks; measures that it lacks or that are null count as 0."""
    out = None
    for name, kind, limit, bucket in RECORD_LIMITS:
        v = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in columns else F.lit(0.0)
        broken = {"le": v <= limit, "lt": v < limit, "gt": v > limit}[kind]
        out = F.when(broken, bucket) if out is None else out.when(broken, bucket)
    return out.otherwise("candidate_pool_miss")


def hit_eval(results: DataFrame, gold: DataFrame, k: int = 10, deep: int = 100) -> DataFrame:
    """H-15, H-18: paper, section and exact hits in the first k, exact hits in the first ``deep``."""
    r = results.select("query_id", "rank", F.col("paper_id").alias("rp"), F.col("section").alias("rs"), F.col("chunk_id").alias("rc"))
    both = gold.join(r, "query_id", "left")
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    top = F.col("rank") <= k
    same = F.col("rp") == F.col("paper_id")
    return both.groupBy("query_id").agg(
        hit(top & same).alias("paper_hit"), hit(top & same & (F.col("rs") == F.col("section"))).alias("section_hit"),
        hit(top & (F.col("rc") == F.col("chunk_id"))).alias("exact_hit"), hit((F.col("rank") <= deep) & (F.col("rc") == F.col("chunk_id"))).alias("oracle_hit"),
    )


def chunk_qa(chunks: DataFrame, required: list[str], types: list[str]) -> DataFrame:
    """H-32: missing fields, types not allowed and repeated ids of each paper, and PASS or BLOCKED."""
    missing = F.greatest(*[(F.col(c).isNull() | (F.col(c).cast("string") == "")).cast("int") for c in required])
    one = chunks.groupBy("paper_id", "chunk_id").agg(F.count("*").alias("n"), F.sum(missing).alias("missing"), F.sum((~F.col("content_type").isin(types)).cast("int")).alias("bad_type"))
    out = one.groupBy("paper_id").agg(F.sum("n").alias("chunks"), F.sum("missing").alias("missing"), F.sum("bad_type").alias("bad_type"), F.sum(F.col("n") - 1).alias("repeated"))
    return out.withColumn("status", F.when(F.col("missing") + F.col("bad_type") + F.col("repeated") == 0, "PASS").otherwise("BLOCKED"))


def required_missing(have: DataFrame, want: DataFrame, on: list[str]) -> DataFrame:
    """H-23, I-2: what is required and absent."""
    return want.select(*on).distinct().join(have.select(*on).distinct(), on, "left_anti")


def stratified_sample(df: DataFrame, family: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """G-14: one row of each family, then others, in the order of a seeded hash, n in all. A family sends its least rows only."""
    h = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(key).cast("string")))
    rows = df.withColumn("__h", h)
    first = rows.groupBy(family).agg(F.min(F.struct("__h", key)).alias("__m")).select(F.col(f"__m.{key}").alias("__k"))
    marked = rows.join(broadcast_if_small(first, MAX_FAMILIES), F.col(key) == F.col("__k"), "left").withColumn("__f", F.col("__k").isNull())
    return marked.orderBy("__f", "__h", key).limit(n).drop("__f", "__h", "__k")


def corpus_check(papers: DataFrame, queries: DataFrame, min_papers: int, min_queries: int, families: list[str], disciplines: list[str]) -> DataFrame:
    """H-23: one row: counts, required families and disciplines that are absent, queries without claims, and whether all is well."""
    p = papers.agg(F.count_distinct("paper_id").alias("papers"), F.collect_set("discipline").alias("d"))
    q = queries.agg(F.count_distinct("query_id").alias("queries"), F.collect_set("family").alias("f"), F.count_if(F.coalesce("n_claims", F.lit(0)) == 0).alias("without_claims"))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    both = p.crossJoin(q).withColumns({"absent_families": F.array_sort(F.array_except(lit(families), "f")), "absent_disciplines": F.array_sort(F.array_except(lit(disciplines), "d"))})
    ok = (F.col("papers") >= min_papers) & (F.col("queries") >= min_queries) & (F.size("absent_families") == 0) & (F.size("absent_disciplines") == 0) & (F.col("without_claims") == 0)
    return both.select("papers", "queries", "absent_families", "absent_disciplines", "without_claims", ok.alias("ok"))


def annotation_qa(queries: DataFrame) -> DataFrame:
    """H-24: one row for each broken rule of each query: no question, no expected paper, no evidence (unless it must abstain), not reviewed."""
    broken = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "no_question"), F.when(~F.col("must_abstain") & (F.coalesce("n_papers", F.lit(0)) == 0), "no_papers"),
        F.when(~F.col("must_abstain") & (F.coalesce("n_evidence", F.lit(0)) == 0), "no_evidence"), F.when(~F.coalesce("reviewed", F.lit(False)), "not_reviewed"),
    ))
    return queries.select("query_id", F.explode(broken).alias("rule"))


def validate_runs(runs: DataFrame, samples: DataFrame, states: list[str]) -> DataFrame:
    """H-26: problems of nested run rows ``run_id, sample_ids, state``: repeated ids, unknown states, unknown samples."""
    repeated = runs.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 1").select("run_id", F.lit("repeated_run").alias("problem"), F.lit(None).cast("string").alias("detail"))
    state = runs.where(~F.col("state").isin(states) | F.col("state").isNull()).select("run_id", F.lit("unknown_state").alias("problem"), F.col("state").alias("detail"))
    named = runs.select("run_id", F.explode("sample_ids").alias("sample_id")).join(samples.select("sample_id"), "sample_id", "left_anti")
    return repeated.unionByName(state).unionByName(named.select("run_id", F.lit("unknown_sample").alias("problem"), F.col("sample_id").alias("detail")))


def paragraph_coverage(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """H-30: sections with their paragraphs that have citations and evidence; a section without any is omitted with a reason."""
    kept = paragraphs.where("n_citations > 0 and n_evidence > 0").groupBy("draft_id", "section").agg(F.count("*").alias("kept"))
    out = sections.join(kept, ["draft_id", "section"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return out.withColumn("omitted", F.when(F.col("kept") == 0, "no_supported_paragraph"))


#: Fields that a release check needs from every run (fixed values).
HOOKS = ("citation_coverage", "unsupported_rate", "total_latency_ms", "cost_estimate", "execution_mode")


def missing_hooks(runs: DataFrame, hooks: tuple[str, ...] = HOOKS) -> DataFrame:
    """H-27: the fields that each case of a run lacks."""
    return runs.select("case_id", F.array_compact(F.array(*[F.when(F.col(h).isNull(), h) for h in hooks])).alias("missing"))


def benchmark_summary(results: DataFrame) -> DataFrame:
    """H-28: one row for each run of ``run_id, status, synthetic, citation_coverage, unsupported_claim, consistency, jump_valid, latency_s, hard_error``, and its gate.

    Means to four places and the nearest-rank 95th percentile. PIPELINE_ERROR for jumps below 0.9, latency of 60 s or more or a hard
    error; QUALITY_BLOCKED for coverage below 0.85, an unsupported rate above 0.1 or consistency below 0.65; synthetic runs are smoke only.
    """
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    one = results.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), mean("citation_coverage").alias("citation_coverage"), mean("unsupported_claim").alias("unsupported_claim_rate"), mean("consistency").alias("consistency"),
        mean("jump_valid").alias("jump_validity"), F.sum(F.coalesce("hard_error", F.lit(0))).alias("hard_errors"), F.coalesce(F.bool_or("synthetic"), F.lit(False)).alias("synthetic"),
    )
    both = one.join(percentile_nearest(results, ["run_id"], "latency_s").withColumnRenamed("p_value", "p95_latency_s"), "run_id", "left").withColumn("p95_latency_s", F.round(F.coalesce("p95_latency_s", F.lit(0.0)), 4))
    flows = (F.col("jump_validity") >= 0.9) & (F.col("p95_latency_s") < 60) & (F.col("hard_errors") == 0)
    good = (F.col("citation_coverage") >= 0.85) & (F.col("unsupported_claim_rate") <= 0.1) & (F.col("consistency") >= 0.65)
    state = F.when(F.col("synthetic"), "SMOKE").when(~flows, "PIPELINE_ERROR").when(~good, "QUALITY_BLOCKED").otherwise("QUALITY_PASS")
    gate_state = F.when(F.col("synthetic"), "SMOKE_ONLY").when(flows & good, "PASS").otherwise("BLOCKED")
    return both.withColumns({"eval_status": state, "gate_status": gate_state})
