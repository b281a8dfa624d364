"""A corpus pipeline of the llm operators: STAGES in order, each written as Parquet and read again.

Every stage keeps the columns of its input (the last one gives digests instead) and takes any table with ``doc_id`` and ``text``:
an empty table stays empty, rows that repeat are judged each, extra columns stay. What becomes of null and empty texts and null ids
is stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidencelake.llm.chosen_path import keep_first
from evidencelake.llm.decontamination import drop_leaked
from evidencelake.llm.prefix_bpe import bpe_round_trip
from evidencelake.llm.quality_rules import keep_good as keep_by_rules
from evidencelake.llm.rule_ensemble import keep_good as keep_by_score
from evidencelake.scratch import drop_table, new_path

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(spark: SparkSession) -> None:
    """Arrow batches of at most 1024 rows from here on, since rows hold whole texts: Python workers and the buffers that feed them stay small. ``run`` puts the setting back."""
    spark.conf.set(ARROW_ROWS, str(min(1024, int(spark.conf.get(ARROW_ROWS)))))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs. Null and empty texts have no words and go."""
    whole_texts(spark)
    return keep_by_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on what is left, predicts good; null texts are scored as empty ones. Without labels of both kinds every row has one score."""
    whole_texts(spark)
    return keep_by_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The lowest id of each group of near copies. Texts without words are copies of none and stay, and so do rows with a null id."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Null and empty texts leak none; rows with a null id stay."""
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded text of every document left; a null text counts as empty."""
    import public_tokenizers

    whole_texts(spark)
    out = bpe_round_trip(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), digests_only=True, keep=False, cache_bytes=24 << 20)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The classifier's fit cannot be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is removed when the next one's is written."""
    docs, before, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(ARROW_ROWS), None
    try:
        for name, stage in STAGES:
            path = new_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            if held is not None:
                drop_table(held)
            docs = held = spark.read.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return docs
