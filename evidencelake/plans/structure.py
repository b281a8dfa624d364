"""Queries over document structure (G), sessions and streams (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidencelake.operators import chunking as G, reports as R
from evidencelake.plans.relational import q
from evidencelake.plans.registry import ORACLES, query
from evidencelake.plans.views import with_views
from evidencelake.scratch import new_path
from evidencelake.sources.tables import read_table
from evidencelake.streaming import events as K


@q("chunk_quality", r"""WITH w AS (SELECT paper_id, CASE WHEN pos % 2 = 0 THEN 'introduction' ELSE 'other' END AS section, len(list_filter(regexp_split_to_array(CASE WHEN pos % 3 = 0 THEN 'Theorem 1. ' ELSE '' END || content, '\s+'), lambda x: x <> '')) AS w, pos % 3 = 0 AS special FROM chunks_v),
p AS (SELECT paper_id, section, count(*) AS n, avg(w) AS m, CASE section WHEN 'introduction' THEN 19 ELSE 15 END AS own FROM w GROUP BY ALL), k AS (SELECT paper_id, count(*) FILTER (n > 1 AND abs(m - own) / own < 0.2) AS near FROM p GROUP BY 1),
s AS (SELECT paper_id, avg(w) AS mean, var_pop(w) AS variance, greatest(0, 1 - 0.1 * count(*) FILTER (special AND w > 16 * 1.2)) AS boundary FROM w GROUP BY 1)
SELECT paper_id, round(boundary, 6) AS boundary, round(least(1, 0.8 + 0.05 * near), 6) AS coherence, round(0.3 * greatest(0, 1 - abs(mean - 15) / 15) + 0.2 * CASE WHEN variance < 100 THEN 1 WHEN variance < 300 THEN 0.7 WHEN variance < 500 THEN 0.4 ELSE 0.1 END + 0.25 * boundary + 0.25 * least(1, 0.8 + 0.05 * near), 6) AS quality FROM s JOIN k USING (paper_id)""", "chunks_v")
def chunk_quality(c):
    text = F.concat(F.when(F.col("pos") % 3 == 0, "Theorem 1. ").otherwise(""), "content")
    out = G.chunk_quality(c.select("paper_id", F.when(F.col("pos") % 2 == 0, "introduction").otherwise("other").alias("section"), text.alias("content")), 15, 16)
    return out.select("paper_id", *[F.round(n, 6).alias(n) for n in ("boundary", "coherence", "quality")])


@q("chunk_semantic", None, "chunks_v")
def chunk_semantic(c):
    return G.chunk_semantic(c.select("paper_id", "pos", "page_num", F.lower("section").alias("section"), F.col("content").alias("text")), 40, 6)


@q("section_summaries", """WITH o AS (SELECT paper_id, section, substr(content, 1, 60) AS h, min(pos) AS pos, min(chunk_id) AS chunk_id FROM chunks_v GROUP BY ALL) SELECT paper_id, section, array_to_string(list(h ORDER BY pos, h)[1:3], ' ') AS summary, array_to_string(list(chunk_id ORDER BY pos, h), ',') AS chunk_ids FROM o GROUP BY ALL""", "chunks_v")
def section_summaries(c):
    return G.section_summaries(c, 3, 60).withColumn("chunk_ids", F.array_join(F.col("chunk_ids").cast("array<string>"), ","))


@q("reading_card", """WITH m AS (SELECT paper_id, chunk_id, page_num, length(content) AS n, CASE WHEN regexp_matches(lower(section), 'method') THEN 'method' WHEN regexp_matches(lower(section), 'result|experiment') THEN 'result' WHEN regexp_matches(lower(section), 'future') THEN 'limitation' END AS slot FROM chunks_v)
SELECT paper_id, slot, chunk_id FROM m WHERE slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id, slot ORDER BY page_num, n DESC, chunk_id) = 1""", "chunks_v")
def reading_card(c):
    return G.reading_card(c, {"method": "method", "result": "result|experiment", "limitation": "future"})


@q("imrad", """WITH h AS (SELECT paper_id, pos, page_num, section, CASE pos % 7 WHEN 0 THEN 'abstract' WHEN 1 THEN 'introduction' WHEN 2 THEN 'methods' WHEN 3 THEN 'results' WHEN 4 THEN 'results' WHEN 5 THEN 'conclusion' END AS head FROM chunks_v),
r AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'front') AS run, bool_or(head IS NOT NULL) OVER (PARTITION BY paper_id) AS a, count(*) OVER (PARTITION BY paper_id) AS n, row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1 AS i FROM h),
s AS (SELECT *, CASE WHEN a THEN run WHEN i < greatest(1, n // 4) THEN 'introduction' WHEN i < n // 2 THEN 'methods' WHEN i < n * 3 // 4 THEN 'results' ELSE 'conclusion' END AS sec FROM r)
SELECT paper_id, sec AS section, CAST(sum(len(string_split(section, ' '))) AS BIGINT) AS words, min(page_num) AS page_start, max(page_num) AS page_end, max(CASE WHEN a THEN 0.9 ELSE 0.3 END)::DOUBLE AS confidence FROM s GROUP BY ALL""", "chunks_v")
def imrad(c):
    return G.imrad(c.select("paper_id", "pos", "page_num", F.col("section").alias("text")))


@q("fold_chunks", None, "documents")
def fold_chunks(d):
    return G.fold_documents(d)


_PART = lambda name, n, most: f"substr(coalesce(array_to_string((list(t ORDER BY pos) FILTER (part = '{name}'))[1:{n}], ' '), ''), 1, {most})"


@q("paper_summary_index", f"""WITH c AS (SELECT paper_id, pos, chunk_id, page_num, content_type, content, lower(CASE WHEN pos = 5 THEN 'Ablation' ELSE section END) AS sec, CASE WHEN pos % 2 = 0 THEN substr(content, 1, 30) ELSE '' END AS anchor FROM chunks_v),
p AS (SELECT *, CASE WHEN contains(sec, 'abstract') THEN 'abstract' WHEN contains(sec, 'introduction') THEN 'introduction' WHEN regexp_matches(sec, 'method|approach|model|architecture|system') THEN 'method' WHEN regexp_matches(sec, 'experiment|evaluation|result|benchmark') THEN 'experiment' WHEN contains(sec, 'ablation') THEN 'result' WHEN regexp_matches(sec, 'limitation|future') THEN 'limitation' END AS part, CASE WHEN anchor <> '' THEN anchor ELSE substr(content, 1, 300) END AS t,
  CASE WHEN (page_num = 1 OR sec IN ('', 'abstract', 'introduction')) AND length(trim(content)) BETWEEN 11 AND 199 THEN trim(content) END AS line FROM c)
SELECT paper_id, coalesce(arg_min(line, pos) FILTER (line IS NOT NULL), '') AS title, {_PART("abstract", 2, 1000)} AS abstract, CASE WHEN {_PART("abstract", 3, 1500)} <> '' THEN {_PART("abstract", 3, 1500)} ELSE {_PART("introduction", 2, 1500)} END AS paper_summary, {_PART("method", 3, 1000)} AS method_summary, {_PART("experiment", 3, 1000)} AS experiment_summary, {_PART("result", 2, 800)} AS result_summary, {_PART("limitation", 2, 800)} AS limitation_summary,
array_to_string(list_sort(list(DISTINCT content_type))[1:20], ',') AS datasets, coalesce(array_to_string((list(anchor ORDER BY pos) FILTER (content_type = 'table' AND anchor <> ''))[1:10], '#'), '') AS table_captions, coalesce(array_to_string((list(anchor ORDER BY pos) FILTER (content_type = 'figure' AND anchor <> ''))[1:10], '#'), '') AS figure_captions, coalesce(array_to_string((list(chunk_id ORDER BY pos) FILTER (part = 'abstract'))[1:5], ','), '') AS representative_ids FROM p GROUP BY paper_id""", "chunks_v")
def paper_summary_index(c):
    marked = c.withColumns({"section": F.when(F.col("pos") == 5, "Ablation").otherwise(F.col("section")), "anchor": F.when(F.col("pos") % 2 == 0, F.substring("content", 1, 30)).otherwise(""), "datasets": F.array("content_type")})
    out = R.paper_summary_index(marked).drop("metrics", "methods")
    lists = {"datasets": ",", "table_captions": "#", "figure_captions": "#", "representative_ids": ","}
    return out.withColumns({n: F.array_join(F.col(n).cast("array<string>"), mark) for n, mark in lists.items()})


_PATTERN = lambda text, at_start: " ".join(f"WHEN regexp_matches({text}, '{'^(?:' if at_start else ''}{'|'.join(f'(?:{p})' for p in ps)}{')' if at_start else ''}') THEN '{s}'" for s, ps in G.SECTION_PATTERNS.items())
#: Texts of chunks as headings, with anchors, or with a pattern at their beginning, by position.
SECTION_TEXT = "CASE pos % 4 WHEN 0 THEN section WHEN 1 THEN section || ' ' || content ELSE content END"


@q("assign_sections", rf"""WITH c AS (SELECT paper_id, chunk_id, page_num, {SECTION_TEXT} AS text, lower({SECTION_TEXT}) AS low FROM chunks_v),
sp AS (SELECT DISTINCT paper_id, page_num AS ord, 'part' || page_num AS section, page_num AS a, page_num AS b, CASE WHEN page_num % 2 = 0 THEN 0.9 ELSE 0.5 END AS sure, 'line' || paper_id % 5 AS a1, 'recall on brand#' || paper_id % 6 AS a2 FROM chunks_v WHERE page_num < 4),
h AS (SELECT *, lower(trim(text)) AS t, regexp_extract(lower(trim(text)), '^[0-9]+[.\s]*([a-z]+)', 1) AS word FROM c),
x AS (SELECT h.*, CASE WHEN length(t) <= 50 THEN coalesce(CASE WHEN word = '' THEN NULL {_PATTERN("word", False)} END, CASE {_PATTERN("t", True)} END) END AS heading,
  (SELECT min_by(section, ord) FROM sp WHERE sp.paper_id = h.paper_id AND page_num BETWEEN a AND b AND sure >= 0.7 AND page_num <> 0) AS page, (SELECT min_by(section, ord) FROM sp WHERE sp.paper_id = h.paper_id AND (contains(low, a1) OR contains(low, a2))) AS anchor, CASE {_PATTERN("substr(low, 1, 100)", False)} END AS pattern FROM h)
SELECT paper_id, chunk_id, coalesce(heading, page, anchor, pattern, '') AS section, CASE WHEN heading IS NOT NULL THEN 'heading' WHEN page IS NOT NULL THEN 'page' WHEN anchor IS NOT NULL THEN 'anchor' WHEN pattern IS NOT NULL THEN 'pattern' ELSE 'none' END AS by FROM x""", "chunks_v")
def assign_sections(c):
    anchors = F.array(F.concat(F.lit("Line"), (F.col("paper_id") % 5).cast("string")), F.concat(F.lit("recall on Brand#"), (F.col("paper_id") % 6).cast("string")))
    spans = c.where("page_num < 4").select("paper_id", F.col("page_num").alias("ord"), F.concat(F.lit("part"), F.col("page_num").cast("string")).alias("section"), F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"), F.when(F.col("page_num") % 2 == 0, 0.9).otherwise(0.5).alias("confidence"), anchors.alias("anchors")).distinct()
    return G.assign_sections(c.select("paper_id", "chunk_id", "page_num", F.expr(SECTION_TEXT).alias("text")), spans).select("paper_id", "chunk_id", "section", "by")


@q("chunk_paragraphs", """WITH RECURSIVE i AS (SELECT paper_id, pos, page_num, trim(content) AS t, content_type = 'text' AS is_text, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS n FROM chunks_v),
r AS (SELECT paper_id, n, pos, page_num, t, is_text, CASE WHEN is_text THEN 0 ELSE -1 END AS chunk_no, CASE WHEN is_text THEN length(t) ELSE 0 END AS len FROM i WHERE n = 1
  UNION ALL SELECT i.paper_id, i.n, i.pos, i.page_num, i.t, i.is_text, CASE WHEN i.is_text AND (r.chunk_no < 0 OR r.len > 150) THEN r.chunk_no + 1 ELSE r.chunk_no END, CASE WHEN NOT i.is_text THEN r.len WHEN r.chunk_no < 0 OR r.len > 150 THEN length(i.t) ELSE r.len + 2 + length(i.t) END FROM r JOIN i ON i.paper_id = r.paper_id AND i.n = r.n + 1)
SELECT paper_id, greatest(chunk_no, 0)::INT AS chunk_no, array_to_string(list(t ORDER BY pos) FILTER (is_text), chr(10) || chr(10)) AS text, min(pos) FILTER (is_text) AS first_pos, max(pos) FILTER (is_text) AS last_pos, min(page_num) FILTER (is_text) AS page_start, max(page_num) FILTER (is_text) AS page_end, coalesce(array_to_string(list(t ORDER BY pos) FILTER (NOT is_text), '#'), '') AS media
FROM r GROUP BY paper_id, greatest(chunk_no, 0) HAVING bool_or(is_text)""", "chunks_v")
def chunk_paragraphs(c):
    kind = F.when(F.col("content_type") == "text", "text").otherwise("table")
    out = G.fold_chunks(c.select("paper_id", F.col("pos").cast("long").alias("pos"), F.col("content").alias("text"), kind.alias("type"), F.col("page_num").alias("page"), "section"), 150)
    return out.select("paper_id", "chunk_no", "text", "first_pos", "last_pos", "page_start", "page_end", F.array_join(F.transform("media", lambda m: m["text"]), "#").alias("media"))


@q("page_clusters", None, "embeddings")
def page_clusters(e):
    return G.page_clusters(e.withColumn("group_id", F.floor(F.col("vec_id") / 40)), "group_id", 0.8)


@q("raptor_tree", None, "embeddings")
def raptor_tree(e):
    tree = G.raptor_tree(e.select(F.floor(F.col("vec_id") / 40).alias("paper_id"), "vec_id", "embedding"), 0.9, clear=0.0)  # the given vectors hardly cluster
    return tree.select("paper_id", "level", "node", "parent")


@q("evict_log", "WITH f AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 864000 SECOND) SELECT user_id, event_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20", "events")
def evict_log(e):
    return K.evict(e, "user_id", "2024-01-20 12:00:00", 20, 864000).select("user_id", "event_id")


STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"


@q("check_transitions", f"""WITH s AS (SELECT user_id AS job_id, event_id, ts, {STATUS} AS status FROM events), b AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id), 'created') AS before FROM s)
SELECT job_id, event_id, before, status, before || '>' || status IN ('created>queued', 'created>cancelled', 'queued>running', 'queued>cancelled', 'running>completed', 'running>failed', 'running>cancelled', 'failed>queued') AS legal FROM b""", "events")
def check_transitions(e):
    return K.check_transitions(e.select(F.col("user_id").alias("job_id"), "event_id", "ts", F.expr(STATUS).alias("status")))


@query("stream_transitions", ORACLES["check_transitions"])
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-5 as a stream with a state for each job, run to its end."""
    out = new_path(spark, "transitions")
    jobs = _stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), "event_id", "ts", F.expr(STATUS).alias("status"))
    K.run_to_end(K.live_transitions(jobs), "append", f"{out}/checkpoint", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/b={n}"))
    return spark.read.parquet(f"{out}/rows").select("job_id", "event_id", "before", "status", "legal")


@query("stream_buffer", "WITH f AS (SELECT user_id, event_id, row_number() OVER w AS n, ts >= max(ts) OVER (PARTITION BY user_id) - INTERVAL 864000 SECOND AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)) SELECT user_id, event_id FROM f WHERE n <= 20 AND fresh")
def stream_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-4 as a stream with a buffer for each session, run to its end: the buffers after each session's last micro-batch."""
    out = new_path(spark, "buffers")
    K.run_to_end(K.live_buffer(_stream(spark, sf_dir), 20, 864000), "update", f"{out}/checkpoint", lambda df, n: df.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/b={n}"))
    rows = spark.read.parquet(f"{out}/rows")
    return rows.join(rows.groupBy("user_id").agg(F.max("n").alias("n")), ["user_id", "n"]).select("user_id", "event_id")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = read_table(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")


@query("stream_live_budget", with_views("SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage_v GROUP BY ALL"))
def stream_live_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream run to its end; the last update of each user and day."""
    out = new_path(spark, "live-budget")
    usage = _stream(spark, sf_dir).select("user_id", "ts", F.expr("CAST(floor(value * 1000) AS BIGINT)").alias("tokens"))
    K.run_to_end(K.live_budget(usage), "update", f"{out}/checkpoint", lambda df, n: df.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/b={n}"))
    return spark.read.parquet(f"{out}/rows").groupBy("user_id", "day", "w").agg(F.max_by("tokens", "n").alias("tokens")).groupBy("user_id", "day").agg(F.sum("tokens").alias("tokens"))


@query("stream_event_log", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def stream_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events numbered by the stream; one micro-batch, since the SQL numbers all files in order of time."""
    out = new_path(spark, "event-log")
    K.run_to_end(_stream(spark, sf_dir), "append", f"{out}/checkpoint", K.event_log(out))
    return spark.read.parquet(f"{out}/rows").select("user_id", "event_id", "seq")


@query("replay_log", "WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), a AS (SELECT user_id, max(event_id) FILTER (event_id % 3 = 0) - CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1000000 END AS last FROM events GROUP BY 1) SELECT l.* FROM l JOIN a USING (user_id) WHERE seq > coalesce((SELECT seq FROM l x WHERE x.user_id = a.user_id AND x.event_id = a.last), 0)")
def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = read_table(spark, sf_dir, "events")
    log = e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    last = F.max(F.when(F.col("event_id") % 3 == 0, F.col("event_id"))) - F.when(F.col("user_id") % 2 == 0, 0).otherwise(1000000)
    return K.replay(log, e.groupBy("user_id").agg(last.alias("last_event_id")))


@q("section_index", """WITH c AS (SELECT *, CASE WHEN pos % 2 = 0 THEN substr(content, 1, 30) ELSE '' END AS anchor FROM chunks_v),
g AS (SELECT paper_id, section, list(substr(anchor, 1, 200) ORDER BY pos) FILTER (anchor <> '') AS a, list(substr(content, 1, 200) ORDER BY pos) AS t, list(chunk_id ORDER BY pos) AS i, list(chunk_id ORDER BY pos) FILTER (content_type = 'table') AS ta, list(chunk_id ORDER BY pos) FILTER (content_type = 'figure') AS fi FROM c GROUP BY ALL)
SELECT paper_id || '::' || section AS section_id, substr(array_to_string(coalesce(a[1:5], t[1:3]), ' '), 1, 1200) AS summary, array_to_string(list_filter(string_split(section, ' '), lambda w: length(w) > 2), ',') AS key_terms, array_to_string(i[1:50], ',') AS chunk_ids, coalesce(array_to_string(ta[1:10], ','), '') AS table_ids, coalesce(array_to_string(fi[1:10], ','), '') AS figure_ids FROM g""", "chunks_v")
def section_index(c):
    out = G.section_index(c.withColumn("anchor", F.when(F.col("pos") % 2 == 0, F.substring("content", 1, 30)).otherwise("")))
    return out.select("section_id", "summary", *[F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in ("key_terms", "chunk_ids", "table_ids", "figure_ids")])
