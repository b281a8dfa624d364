"""Operator 5: a sparse rule ensemble for text quality.

Shallow random-forest trees over text statistics give candidate rules (every path from a
root is a conjunction of bounds); a lasso logistic regression over the 0/1 rules keeps few of
them; the kept rules and weights become one Spark Column expression.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencelake.llm.text_stats import FIELDS, stats_column
from evidencelake.scratch import materialize

#: At most about this many labelled rows are fitted, chosen by a hash of the id.
MAX_TRAIN = 40_000
TREES, DEPTH, LASSO = 12, 3, 0.001
#: Statistics a rule may bound; none depends on label, language, source or id.
FEATURES = {
    "symbol": "n_symbols / greatest(word_chars, 1)",
    "pipe": "n_pipes / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digit": "n_digits / greatest(word_chars, 1)",
    "stop": "n_stops / greatest(n_words, 1)",
    "bang": "n_bangs / greatest(n_words, 1)",
    "non_ascii": "n_non_ascii / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "dup_line": "n_dup_lines / greatest(n_lines, 1)",
    "repeat": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "top_word": "n_top_word / greatest(n_words, 1)",
    "log_words": "ln(1 + n_words)",
    "line_words": "n_words / greatest(n_lines, 1)",
}
Rule = tuple[tuple[str, str, float], ...]


def tree_rules(debug: str, names: list[str]) -> set[Rule]:
    """All paths of one tree's printed form, as conjunctions with one bound for each feature and direction."""
    found, path = set(), []
    for line in debug.split("\n"):
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            path = [x for x in path if x[0] < depth] + [(depth, names[int(m[2])], m[3], float(m[4]))]
            bounds: dict[tuple[str, str], float] = {}
            for _, name, op, value in path:
                old = bounds.get((name, op), value)
                bounds[name, op] = min(old, value) if op == "<=" else max(old, value)
            found.add(tuple(sorted((n, o, v) for (n, o), v in bounds.items())))
    return found


def rule_column(rule: Rule) -> Column:
    """A rule over feature columns."""
    out = F.lit(True)
    for name, op, value in rule:
        out = out & (F.col(f"f_{name}") <= value if op == "<=" else F.col(f"f_{name}") > value)
    return out


class RuleEnsemble:
    """Intercept and weighted rules; ``score()`` is their Column over ``f_*``."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def features(stats: DataFrame) -> DataFrame:
    """Adds ``f_<feature>`` from the counts."""
    return stats.withColumns({f"f_{n}": F.expr(f"double({e})") for n, e in FEATURES.items()})


def document_features(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out`` and the features of every text (null: no words)."""
    stats = docs.select("doc_id", stats_column(F.col("text")).alias("s"))
    rows = features(stats.select("doc_id", *[F.col(f"s.{f}").alias(f) for f in FIELDS]))
    return rows.select("doc_id", held_out().alias("held_out"), *[f"f_{n}" for n in FEATURES])


def held_out() -> Column:
    """Whether crc32 of the id's text leaves 1 on division by 3; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(train: DataFrame) -> RuleEnsemble:
    """A model from ``train(doc_id, quality, f_*)``; rows of one class only, or none, give a constant."""
    n, good = train.agg(F.count("*"), F.sum("quality")).first()
    if not n or not 0 < good < n:
        p = (good + 1) / (n + 2) if n else 0.5
        return RuleEnsemble(math.log(p / (1 - p)), [])
    names = list(FEATURES)
    share = min(1.0, MAX_TRAIN / n)
    chosen = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < round(share * 1_000_000)).repartition(6, "doc_id").sortWithinPartitions("doc_id")
    rows = materialize(chosen, "rule-train").withColumn("label", F.col("quality").cast("double"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, featureSubsetStrategy="onethird", minInstancesPerNode=5, maxBins=64)
    trees = forest.fit(rows.select("label", array_to_vector(F.array(*[f"f_{n}" for n in names])).alias("features"))).trees
    rules = sorted(set().union(*(tree_rules(t.toDebugString, names) for t in trees)))
    if not rules:
        return RuleEnsemble(math.log(good / (n - good)), [])
    fired = rows.select("label", array_to_vector(F.array(*[rule_column(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(fired)
    return RuleEnsemble(lasso.intercept, [(r, w) for r, w in zip(rules, lasso.coefficients.toArray().tolist()) if abs(w) > 1e-9])


def fit_from(rows: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """A model from the labelled rows of ``document_features`` that are not held out."""
    return fit(rows.where(~F.col("held_out")).join(labels.select("doc_id", "quality").where("quality in (0, 1)"), "doc_id"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Null and empty texts are scored as texts without words. Repeated rows are scored each;
    extra columns are not read; an empty table gives no rows.
    """
    rows = materialize(document_features(docs), "rule-features")
    out = rows.select("doc_id", "held_out", fit_from(rows, labels).score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted good, with their columns; texts are not shuffled."""
    model = fit_from(materialize(document_features(docs), "rule-features"), labels)
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), stats_column(F.col("text")).alias("s"))
    scored = features(inside.select("__row", *[F.col(f"s.{f}").alias(f) for f in FIELDS]))
    return scored.where(model.score() >= 0.5).select("__row.*")


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with all labels that may be learned from."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
