"""A-2 to A-8: JSON artifacts, golden sets, run folders, indexes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from evidencelake.functions.text import citation_jump_url, infer_query_family
from evidencelake.operators.filters import truthy

CHUNK_FIELDS = "paper_id string, source_chunk_id string, parse_id string, page_num int, section_path string, content_type string, content_data string, anchor_text string"
STAGES = ("raw", "rule", "llm")


def read_chunk_artifacts(spark: SparkSession, root: str, stage: str = "rule") -> DataFrame:
    """A-2: chunks of ``papers/*/chunks_{stage}.json``, a paper without that file by its ``chunks_raw.json``.

    A file holds a list of chunks or an object with ``chunks``. Unreadable files give nothing;
    ``paper_id`` falls back to the folder's name and ``content_type`` to ``text``.
    """
    item = f"array<struct<{CHUNK_FIELDS.replace(' string', ':string').replace(' int', ':int')}>>"
    files = spark.read.text(f"{root}/papers/*/chunks_*.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    named = files.select("value", F.regexp_extract("path", r"papers/([^/]+)/", 1).alias("folder"), F.regexp_extract("path", r"chunks_(\w+)\.json$", 1).alias("stage")).where(F.col("stage").isin(stage, "raw"))
    w = Window.partitionBy("folder").orderBy(F.desc(F.col("stage") == stage))
    best = named.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    bare = F.from_json("value", item)
    wrapped = F.from_json("value", f"struct<chunks:{item}>")["chunks"]
    rows = best.select("folder", "stage", F.explode(F.when(F.trim("value").startswith("["), bare).otherwise(wrapped)).alias("c")).select("folder", "stage", "c.*")
    return rows.withColumns({"paper_id": F.coalesce(truthy(F.col("paper_id")), "folder"), "content_type": F.coalesce(truthy(F.col("content_type")), F.lit("text"))}).drop("folder")


GOLDEN = T.StructType([
    T.StructField("papers", T.ArrayType(T.StructType([T.StructField("paper_id", T.StringType()), T.StructField("queries", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("expected_chunks", T.ArrayType(T.StringType())), T.StructField("expected_sections", T.ArrayType(T.StringType())), T.StructField("query_type", T.StringType())])))]))),
    T.StructField("cross_paper_queries", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("paper_ids", T.ArrayType(T.StringType())), T.StructField("expected_paper_ids", T.ArrayType(T.StringType()))]))),
    T.StructField("multimodal_queries", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("expected_content_type", T.ArrayType(T.StringType()))]))),
])


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A-3: all queries of golden files as one table with their family; blank queries are dropped."""
    g = spark.read.json(path, schema=GOLDEN, multiLine=True)
    one = g.select(F.explode("papers").alias("p")).select(F.col("p.paper_id").alias("paper_id"), F.explode("p.queries").alias("q"))
    single = one.select(F.lit("paper").alias("kind"), "q.id", "q.query", F.array("paper_id").alias("paper_ids"), "q.expected_chunks", "q.expected_sections", "q.query_type")
    cross = g.select(F.explode("cross_paper_queries").alias("q")).select(F.lit("cross_paper").alias("kind"), "q.id", "q.query", F.coalesce("q.expected_paper_ids", "q.paper_ids").alias("paper_ids"))
    modal = g.select(F.explode("multimodal_queries").alias("q")).select(F.lit("multimodal").alias("kind"), "q.id", "q.query", "q.expected_content_type")
    every = single.unionByName(cross, allowMissingColumns=True).unionByName(modal, allowMissingColumns=True).where("trim(query) <> ''")
    return every.withColumn("family", F.coalesce(truthy(F.col("query_type")), infer_query_family(F.col("query"))))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """A-4: one row for each run folder: manifest, then summary metrics, detail metrics where the summary has none or 0."""
    name = lambda df: df.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\.json$", 1))
    read = lambda f, schema: name(spark.read.json(f"{root}/*/{f}", schema=schema, multiLine=True).select("*", "_metadata"))
    meta = read("meta.json", "mode string, runtime_truth string").select("run_id", "mode", "runtime_truth")
    summary = read("dashboard_summary.json", "retrieval_hit_rate double, top_k_recall struct<recall_at_5: double, recall_at_10: double>, citation_coverage double")
    detail = read("retrieval.json", "recall_at_5 double, recall_at_10 double, hit_rate double").select("run_id", F.col("recall_at_5").alias("d5"), F.col("recall_at_10").alias("d10"), "hit_rate")
    both = meta.join(summary.drop("_metadata"), "run_id", "left").join(detail, "run_id", "left")
    some = lambda a, b: F.coalesce(F.when(a != 0, a), b)
    return both.select("run_id", "mode", "runtime_truth", some(F.col("top_k_recall.recall_at_5"), F.col("d5")).alias("recall_at_5"), some(F.col("top_k_recall.recall_at_10"), F.col("d10")).alias("recall_at_10"), some(F.col("retrieval_hit_rate"), F.col("hit_rate")).alias("hit_rate"), "citation_coverage")


def chunk_source_index(stages: DataFrame) -> DataFrame:
    """A-8: one row for each chunk over all stages, the later stage winning, with anchor, quote and jump URL."""
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    w = Window.partitionBy("source_chunk_id").orderBy(F.desc(order))
    last = stages.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    text = F.coalesce("content_data", F.lit(""))
    anchor = F.coalesce(truthy(F.col("anchor_text")), text)
    return last.select("source_chunk_id", "paper_id", "page_num", "stage", F.substring(anchor, 1, 300).alias("anchor"), F.substring(text, 1, 600).alias("quote"), citation_jump_url(F.col("paper_id"), F.col("source_chunk_id"), F.col("page_num")).alias("url"))


def write_report(summary: DataFrame, path: str, title: str, most: int = 100) -> str:
    """A-6: a summary as JSON files below ``path`` and as a Markdown table (returned). More than ``most`` rows are no summary: an error."""
    rows = summary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: aggregate before reporting")
    summary.write.mode("overwrite").json(path)
    show = lambda v: f"{v:.4g}" if isinstance(v, float) else str(v)
    head = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + "-|" * len(summary.columns)]
    return "\n".join(head + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"
