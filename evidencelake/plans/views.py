"""Paper-shaped views over the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from evidencelake.sources.tables import TABLES, read_table

VIEWS = {
    # papers: one per order, owned by its customer
    "papers_v": """SELECT o_orderkey AS paper_id, o_custkey AS user_id, c_nationkey AS project_id,
        c_mktsegment || ' study ' || CAST(o_orderkey % 97 AS STRING) || CASE WHEN o_orderkey % 4 = 0 THEN ' of graph retrieval' WHEN o_orderkey % 4 = 1 THEN ' on neural ranking' ELSE '' END AS title,
        CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE c_mktsegment END AS venue, c_name AS author, lower(o_orderpriority) AS keyword, year(o_orderdate) AS pub_year,
        o_orderstatus AS status, o_orderkey % 3 = 0 AS starred, o_orderdate AS created_at, CAST(floor(o_totalprice) AS INT) % 5000 AS citations
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    # chunks: one per paper and line number
    "chunks_v": """SELECT l_orderkey AS paper_id, l_linenumber AS pos, l_orderkey * 10 + l_linenumber AS chunk_id,
        CAST(floor((l_linenumber + 1) / 2) AS INT) AS page_num, CASE l_linenumber % 7 WHEN 0 THEN 'Abstract' WHEN 1 THEN '1. Introduction' WHEN 2 THEN '2 Methodology' WHEN 3 THEN '3. Experimental Setup' WHEN 4 THEN '4 Results' WHEN 5 THEN 'Future Work' ELSE 'Supplementary' END AS section,
        CASE min(l_partkey) % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text' END AS content_type,
        CASE WHEN min(l_partkey) % 5 = 0 THEN 'Table ' || CAST(l_linenumber AS STRING) || ': accuracy of ' || CAST(CAST(min(l_quantity) AS INT) AS STRING) || '% with ' ELSE 'We evaluate ' END || min(p_name) || ' against the ' || min(p_type) || ' baseline. ' || CASE WHEN min(l_suppkey) % 6 = 0 THEN 'It does not improve recall.' ELSE 'It improves recall on ' || min(p_brand) || '.' END AS content,
        min(l_discount) * 10 AS quality, min(l_suppkey) AS source_id, min(l_partkey) AS method_id
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber""",
    # questions: one per part, a template per query family
    "questions_v": """SELECT p_partkey AS query_id, p_size, CASE p_size % 14 WHEN 0 THEN 'Compare ' || p_name || ' versus ' || p_type WHEN 1 THEN 'What accuracy does ' || p_name || ' reach?'
        WHEN 2 THEN 'Survey of ' || p_type || ' methods' WHEN 3 THEN 'Show the figure for ' || p_name WHEN 4 THEN 'Which table lists ' || p_brand || '?' WHEN 5 THEN 'Evolution and timeline of ' || p_name || ' v2'
        WHEN 6 THEN 'Do results on ' || p_name || ' contradict each other?' WHEN 7 THEN 'What are the limitations of ' || p_type || '?' WHEN 8 THEN 'related work on ' || p_name WHEN 9 THEN 'Which architecture is used in ' || p_brand || '?'
        WHEN 10 THEN '比较 ' || p_name || ' 的局限' WHEN 11 THEN 'Why is ' || p_name || ' difficult in 2019 to 2021?' WHEN 12 THEN 'Who wrote ' || p_name || '?' ELSE 'Across papers, which dataset after 2018 uses ' || p_name || '?' END AS question FROM part""",
    # answers: sentences with and without citations, numbers and negations
    "answers_v": """SELECT o_orderkey AS answer_id, 'The model reaches ' || CAST(o_orderkey % 60 AS STRING) || '% accuracy on the benchmark [Paper A, Results]. ' || CASE o_orderkey % 4 WHEN 0 THEN 'It does not outperform the baseline because training fails. ' WHEN 1 THEN 'Graph retrieval is better than ranking [Paper B, ' || o_orderstatus || ']. ' WHEN 2 THEN 'Short. ' ELSE 'The limitation is a small dataset of papers. ' END || 'Therefore ' || o_orderpriority || ' users compared ' || CAST(o_custkey AS STRING) || ' systems.' AS answer,
        o_custkey AS user_id FROM orders""",
    # hits: retrieval candidates per query (customer) with scores
    "hits_v": """SELECT o_custkey AS query_id, o_orderkey % 40 AS paper_id, l_orderkey * 10 + l_linenumber AS chunk_id, min(CASE WHEN l_returnflag = 'A' THEN 'dense' WHEN l_returnflag = 'N' THEN 'sparse' ELSE 'graph' END) AS branch,
        min(CASE l_partkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text' END) AS content_type, min(l_linenumber) AS page_num, min(l_quantity) / 50 AS score, min(l_discount) * 8 AS vector_score, min(l_shipmode_stub) AS section
        FROM (SELECT *, 'sec' || CAST(l_suppkey % 5 AS STRING) AS l_shipmode_stub FROM lineitem) li JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, l_orderkey, l_linenumber""",
    # usage: token counts and models from events
    "usage_v": """SELECT event_id, user_id, event_type AS model, CAST(floor(value * 1000) AS BIGINT) AS tokens, ts FROM events""",
    # edges: which paper (part) cites which (supplier-linked part)
    "edges_v": """SELECT DISTINCT l_partkey AS src, (l_partkey * 7 + l_suppkey) % 2000 AS dst FROM lineitem WHERE l_partkey <> (l_partkey * 7 + l_suppkey) % 2000""",
}


def needs(sql: str) -> list[str]:
    """The tables and views that a piece of SQL names, views after what they need."""
    out: list[str] = []
    for name in [*TABLES, *VIEWS]:
        if re.search(rf"\b{name}\b", sql):
            for n in [*(needs(VIEWS[name]) if name in VIEWS else []), name]:
                if n not in out:
                    out.append(n)
    return out


#: The keys by which the tables of a view meet, and the rows of ``lineitem`` that one task joins and groups where there are more than MOST_AT_ONCE.
MET_BY = {"hits_v": {"lineitem": "l_orderkey", "orders": "o_orderkey"}, "chunks_v": {"lineitem": "l_partkey", "part": "p_partkey"}}
ROWS_A_TASK, MOST_AT_ONCE = 500_000, 4_000_000


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    return spark_sql(spark, sf_dir, f"SELECT * FROM {name}", MET_BY.get(name, {})) if name in VIEWS else read_table(spark, sf_dir, name)


def spark_sql(spark: SparkSession, sf_dir: str, sql: str, met_by: dict[str, str] | None = None) -> DataFrame:
    """SQL over the tables and views, given to Spark as DataFrames; large tables that are ``met_by`` a key are dealt by it into a stated number of parts.

    The number goes by the rows: tasks of scans and of shuffles that are put together go by compressed bytes, and sorting what these hold takes some 25 times as much memory.
    """
    names = needs(sql)
    tables = {n: read_table(spark, sf_dir, n) for n in names if n not in VIEWS}
    rows = tables["lineitem"].count() if met_by else 0
    if rows > MOST_AT_ONCE:
        tables |= {n: tables[n].repartition(-(-rows // ROWS_A_TASK), key) for n, key in met_by.items()}
    return spark.sql(with_views(sql, "{%s}"), **tables)


def with_views(sql: str, table: str = "%s") -> str:
    """SQL with its views as common table expressions; ``table`` formats the names of base tables."""
    names = [n for n in needs(sql) if n in VIEWS]

    def base(text: str) -> str:
        if table == "%s":
            return text
        return re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", lambda m: f"{m[1]} {table % m[2]} AS {m[2]}", text)

    ctes = [f"{n} AS ({base(VIEWS[n])})" for n in names]
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if not ctes:
        return base(sql)
    return f"WITH {m[1] or ''}{', '.join(ctes)}, {base(sql[m.end():])}" if m else f"WITH {', '.join(ctes)} {base(sql)}"
