"""Operator 2: quality rules with risk-controlled thresholds.

Each rule rejects a text whose statistic exceeds a cutoff. Cutoffs come from labelled texts:
for every stratum and rule, each grid cutoff is tested against "it rejects more than
EPSILON / rules of the stratum's good texts" with the exact binomial tail. A rule's grid is
tested from the loosest cutoff down (a fixed sequence, which needs no correction, and the
tail only grows on the way); strata and rules share DELTA by Bonferroni. So with
probability 1 - DELTA no stratum loses more than EPSILON of its good texts to all rules
together. Of the certified cutoffs the one that rejects most bad less good labelled texts is
used, the loosest on ties; a rule without gain stays off in that stratum.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencelake.llm.text_stats import FIELDS, stats_column
from evidencelake.scratch import broadcast_if_small, materialize

EPSILON, DELTA, GRID = 0.1, 0.05, 50
MAX_STRATA = 10_000
#: Statistic of each rule, from 0 to 1.
RULES = {
    "symbol": ("n_symbols", "word_chars"),
    "dup_line": ("n_dup_lines", "n_lines"),
    "repeat": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "bang": ("n_bangs", "word_chars"),
}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exact up to rounding; 1.0 at or above the mean, where no test can pass."""
    if k >= n * p:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = math.exp(log_term)
    for i in range(k, 0, -1):  # terms fall from here on
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total)


def _tail(k: Column, n: Column, p: Column) -> Column:
    """``binomial_tail`` over the small table of tests."""

    @F.pandas_udf("double")
    def run(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(*x) for x in zip(k, n, p)], dtype="float64")

    return run(k, n, p)


def with_steps(df: DataFrame) -> DataFrame:
    """Adds ``step_<rule>``: the statistic in grid steps, rounded up; a cutoff of ``g`` steps rejects steps above ``g``."""
    ratios = {f"step_{r}": F.coalesce(F.ceil(F.col(a) / F.expr(f"nullif({b}, 0)") * GRID), F.lit(0)).cast("int") for r, (a, b) in RULES.items()}
    return df.withColumns(ratios)


def calibrate(labelled: DataFrame, epsilon: float = EPSILON, delta: float = DELTA) -> DataFrame:
    """Cutoffs from ``labelled(stratum, quality, step_*)``: ``stratum, cut_<rule>`` in grid steps (null: rule off).

    Rows whose quality is neither 0 nor 1 are ignored. A histogram of GRID + 1 bins for each
    stratum and rule is all that is shuffled. An empty table gives no rows: every rule off.
    """
    long = labelled.where("quality in (0, 1)").select("stratum", "quality", F.expr(f"stack({len(RULES)}, " + ", ".join(f"'{r}', step_{r}" for r in RULES) + ") as (rule, step)"))
    bins = long.groupBy("stratum", "rule", "step").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    totals = bins.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.collect_list(F.struct("step", "good", "bad")).alias("bins"))
    strata = totals.agg(F.count_distinct("stratum").alias("n_strata"))
    tests = totals.crossJoin(F.broadcast(strata)).withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(GRID - 1))))
    over = lambda f: F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + F.when(b.step > F.col("cut"), b[f]).otherwise(0))
    tests = tests.withColumns({"good_lost": over("good"), "bad_caught": over("bad")})
    passed = tests.where("bad_caught > good_lost").where(_tail(F.col("good_lost"), F.col("n_good"), F.lit(epsilon / len(RULES))) <= F.lit(delta / len(RULES)) / F.col("n_strata"))
    best = passed.groupBy("stratum", "rule").agg(F.max_by("cut", F.struct(F.col("bad_caught") - F.col("good_lost"), F.col("cut"))).alias("cut"))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cut")).withColumnsRenamed({r: f"cut_{r}" for r in RULES})


def verdict(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to rows with ``stratum``, counts and steps; few strata are broadcast, many joined."""
    joined = stats.join(broadcast_if_small(cutoffs, MAX_STRATA), "stratum", "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    caught = F.greatest(*[F.coalesce(F.col(f"step_{r}") > F.col(f"cut_{r}"), F.lit(False)) for r in RULES])
    return joined.withColumns({"base_failed": base, "kept": ~base & ~caught})


def stratum_column() -> Column:
    """Texts are stratified by language; those without one are a stratum."""
    return F.coalesce(F.col("lang"), F.lit("none"))


def document_stats(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum``, counts and steps of every text (null: no words), without the texts."""
    stats = docs.select("doc_id", stratum_column().alias("stratum"), stats_column(F.col("text")).alias("s"))
    return with_steps(stats.select("doc_id", "stratum", *[F.col(f"s.{f}").alias(f) for f in FIELDS]))


def fit_cutoffs(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Cutoffs from the labelled rows of ``stats``; a document's repeated labels each count."""
    return materialize(calibrate(stats.join(labels.select("doc_id", "quality").where("quality is not null"), "doc_id")), "cutoffs")


def apply_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's counts and verdict: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    Null and empty texts have no words and fail. Repeated rows are judged each. Null ids are
    kept as rows (they have no label). Extra columns are not read.
    """
    stats = materialize(document_stats(docs), "quality-stats")
    out = verdict(stats, fit_cutoffs(stats, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. Texts are not shuffled: counts are made again where the texts are."""
    cutoffs = fit_cutoffs(materialize(document_stats(docs), "quality-stats"), labels)
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), stratum_column().alias("stratum"), stats_column(F.col("text")).alias("s"))
    judged = verdict(with_steps(inside.select("__row", "stratum", *[F.col(f"s.{f}").alias(f) for f in FIELDS])), cutoffs)
    return judged.where("kept").select("__row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with cutoffs from all labels."""
    return apply_quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_RULE_SQL = " UNION ALL ".join(f"SELECT stratum, quality, '{r}' AS rule, CAST(coalesce(ceil({a} / nullif({b}, 0) * {GRID}), 0) AS INT) AS step FROM stats JOIN labels USING (doc_id) WHERE quality IN (0, 1)" for r, (a, b) in RULES.items())
ORACLE = rf"""
WITH cut AS (
  SELECT doc_id, coalesce(lang, 'none') AS stratum, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT doc_id, i, w[i:i+2] AS g FROM cut, unnest(range(1, len(w) - 1)) AS u(i)),
twice AS (SELECT doc_id, g FROM tri GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM tri JOIN twice USING (doc_id, g), unnest([0, 1, 2]) AS u(j) GROUP BY doc_id),
stats AS (
  SELECT doc_id, stratum, coalesce(len(w), 0) AS n_words, coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')), 0) AS word_chars,
    coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols, coalesce(len(lines) - len(list_distinct(lines)), 0) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, coalesce(len(lines), 0) AS n_lines, coalesce(length(regexp_replace(text, '[^A-Z]', '', 'g')), 0) AS n_upper,
    coalesce(length(regexp_replace(text, '[^!]', '', 'g')), 0) AS n_bangs
  FROM cut LEFT JOIN rep USING (doc_id)),
long AS ({_RULE_SQL}),
totals AS (SELECT stratum, rule, sum(quality) AS n_good FROM long GROUP BY ALL),
m AS (SELECT count(DISTINCT stratum) AS n_strata FROM totals),
tests AS (SELECT stratum, rule, cut, n_good, count(*) FILTER (quality = 1 AND step > cut) AS good_lost, count(*) FILTER (quality = 0 AND step > cut) AS bad_caught
  FROM long JOIN totals USING (stratum, rule), range(1, {GRID}) AS r(cut) GROUP BY ALL),
passed AS (SELECT stratum, rule, cut, bad_caught - good_lost AS gain FROM tests, m WHERE bad_caught > good_lost AND good_lost < n_good * {EPSILON / len(RULES)}
  AND list_sum(list_transform(range(0, good_lost + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)
      + i * ln({EPSILON / len(RULES)}) + (n_good - i) * ln(1 - {EPSILON / len(RULES)})))) <= {DELTA / len(RULES)} / n_strata),
best AS (SELECT stratum, rule, cut FROM passed QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cut DESC) = 1),
cuts AS (SELECT stratum, {", ".join(f"max(cut) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)} FROM best GROUP BY stratum),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats LEFT JOIN cuts USING (stratum))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"coalesce(ceil({a} / nullif({b}, 0) * {GRID}), 0) > coalesce(cut_{r}, {GRID + 1})" for r, (a, b) in RULES.items())}) AS kept
FROM base
"""
