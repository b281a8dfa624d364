"""B: predicates, listings, normalisation of hits, upserts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Constraints:
    """What a search is limited to; empty fields do not limit."""

    user_id: int | None = None
    paper_ids: list = field(default_factory=list)
    year_from: int | None = None
    year_to: int | None = None
    section: str | None = None
    content_types: list[str] = field(default_factory=list)
    min_quality: float | None = None


def either(parts: Iterable[Column]) -> Column:
    """OR of conditions; false for none."""
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def every(parts: Iterable[Column]) -> Column:
    """AND of conditions; true for none."""
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def constraint_predicate(c: Constraints) -> Column:
    """B-1: one predicate over ``user_id, paper_id, pub_year, section, content_type, quality``; pushed to the scan by Catalyst."""
    parts = []
    if c.user_id is not None:
        parts.append(F.col("user_id") == c.user_id)
    if c.paper_ids:
        parts.append(F.col("paper_id").isin(c.paper_ids))
    if c.year_from is not None:
        parts.append(F.col("pub_year") >= c.year_from)
    if c.year_to is not None:
        parts.append(F.col("pub_year") <= c.year_to)
    if c.section:
        parts.append(F.col("section") == c.section)
    if c.content_types:
        parts.append(F.col("content_type").isin(c.content_types))
    if c.min_quality is not None:
        parts.append(F.col("quality") >= c.min_quality)
    return every(parts)


CONTENT_TYPES = ("text", "table", "figure", "caption", "page")


def evidence_predicate(paper_ids: list | None = None, section_prefixes: list[str] | None = None, page_from: int | None = None, page_to: int | None = None, content_types: list[str] | None = None) -> Column:
    """B-2: papers, any of the section prefixes, a page range, and content types of the allowed set."""
    parts = []
    if paper_ids:
        parts.append(F.col("paper_id").isin(paper_ids))
    if section_prefixes:
        parts.append(either(F.col("section").startswith(p) for p in section_prefixes))
    if page_from is not None:
        parts.append(F.col("page_num") >= page_from)
    if page_to is not None:
        parts.append(F.col("page_num") <= page_to)
    if content_types:
        unknown = set(content_types) - set(CONTENT_TYPES)
        if unknown:
            raise ValueError(f"unknown content types: {sorted(unknown)}")
        parts.append(F.col("content_type").isin(content_types))
    return every(parts)


#: Longest ids by kind (fixed values).
ID_LENGTHS = {"paper": 128, "section": 256, "user": 128}


def valid_id(col: Column, kind: str) -> Column:
    """B-3: whether an id has only letters, digits and ``_ - . : /`` (sections: blanks too) and is not too long."""
    pattern = r"^[\p{L}\p{N}_.:/ -]+$" if kind == "section" else r"^[A-Za-z0-9_.:/-]+$"
    return F.coalesce(col.rlike(pattern) & (F.length(col) <= ID_LENGTHS[kind]), F.lit(False))


def list_papers(papers: DataFrame, progress: DataFrame | None = None, status: str | None = None, starred: bool | None = None, since=None, until=None, read: bool | None = None) -> DataFrame:
    """B-4: papers by status, star, half-open creation range and whether anyone has read them."""
    parts = []
    if status is not None:
        parts.append(F.col("status") == status)
    if starred is not None:
        parts.append(F.col("starred") == starred)
    if since is not None:
        parts.append(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        parts.append(F.col("created_at") < F.lit(until).cast("timestamp"))
    out = papers.where(every(parts))
    if read is None or progress is None:
        return out
    return out.join(progress.select("paper_id"), "paper_id", "left_semi" if read else "left_anti")


def search_papers(papers: DataFrame, term: str, columns: list[str], year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """B-5: the term in any column (case aside), in a year range; wildcards in the term are plain characters."""
    years = every(([F.col("pub_year") >= year_from] if year_from is not None else []) + ([F.col("pub_year") <= year_to] if year_to is not None else []))
    return papers.where(either(F.lower(F.col(c)).contains(term.lower()) for c in columns) & years)


def search_papers_prefix(papers: DataFrame, uploads: DataFrame, term: str) -> DataFrame:
    """B-6: as B-5 on titles, or an author that begins with the term, or an upload whose file name contains it."""
    low = term.lower()
    named = uploads.where(F.lower("filename").contains(low)).select("paper_id").distinct().withColumn("uploaded", F.lit(True))
    both = papers.join(named, "paper_id", "left")
    return both.where(F.lower("title").contains(low) | F.exists("authors", lambda a: F.lower(a).startswith(low)) | F.coalesce("uploaded", F.lit(False))).drop("uploaded")


def list_kbs(kbs: DataFrame, search: str | None = None, category: str | None = None, sort: str = "name", descending: bool = False) -> DataFrame:
    """B-7: knowledge bases by name and category in a total order."""
    parts = ([F.lower("name").contains(search.lower())] if search else []) + ([F.col("category") == category] if category else [])
    return kbs.where(every(parts)).orderBy(F.desc(sort) if descending else F.asc(sort), "kb_id")


def truthy(col: Column) -> Column:
    """Null for an empty string, so that ``coalesce`` falls through as an ``or`` would."""
    return F.when(col != "", col)


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """F-34: a value held between two bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def normalize_hits(hits: DataFrame) -> DataFrame:
    """B-8: canonical ``chunk_id, paper_id, page_num, section, text, score`` from alternative names and ``raw_data`` JSON.

    ``score`` comes from score, else similarity, else 1 - distance, clamped to 0..1. Missing alternatives count as null.
    """
    have = set(hits.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None)
    raw = lambda n: F.get_json_object(col("raw_data").cast("string"), f"$.{n}")
    first = lambda *names: F.coalesce(*[truthy(col(n).cast("string")) for n in names], *[truthy(raw(n)) for n in names])
    number = lambda n: F.coalesce(col(n).cast("double"), raw(n).cast("double"))
    return hits.select(
        first("chunk_id", "source_chunk_id", "id").alias("chunk_id"), first("paper_id", "paperId").alias("paper_id"), first("page_num", "page").cast("int").alias("page_num"),
        first("section", "section_path").alias("section"), first("text", "content_data", "content").alias("text"),
        clamp(F.coalesce(number("score"), number("similarity"), 1 - number("distance"), F.lit(0.0))).alias("score"),
    )


def normalize_handoff(df: DataFrame) -> DataFrame:
    """B-9: camel and snake case keys unified; rows without a paper or chunk id are dropped."""
    have = set(df.columns)
    one = lambda *names: F.coalesce(*[truthy(F.col(n).cast("string")) for n in names if n in have], F.lit(None).cast("string"))
    out = df.select(one("paper_id", "paperId").alias("paper_id"), one("source_chunk_id", "sourceChunkId", "chunk_id", "chunkId").alias("source_chunk_id"), one("claim", "claimText", "claim_text").alias("claim"))
    return out.where("paper_id is not null and source_chunk_id is not null")


#: Titles that stand for none (fixed values).
PLACEHOLDERS = ("untitled", "unknown", "unknown title", "n/a", "none", "null", "document", "paper")


def is_placeholder(col: Column) -> Column:
    """B-11: whether a title says nothing."""
    return F.coalesce(F.lower(F.trim(col)).isin(*PLACEHOLDERS) | (F.trim(col) == ""), F.lit(True))


def normalize_title(col: Column) -> Column:
    """B-11: NULs out, file suffix and underscores out, blanks collapsed."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), "\\x00", ""), r"(?i)\.pdf$", ""), "_", " ")
    return F.trim(F.regexp_replace(clean, r"\s+", " "))


def clean_display_metadata(papers: DataFrame) -> DataFrame:
    """B-10: display title (file name if a placeholder), authors without noise or repeats, year 1900-2100, venue or null."""
    good = F.filter("authors", lambda a: (F.length(F.trim(a)) > 1) & ~F.lower(F.trim(a)).isin(*PLACEHOLDERS, "anonymous", "et al", "et al.") & ~a.rlike(r"@|https?:"))
    trimmed = F.transform(good, lambda a: F.trim(a))
    distinct = F.filter(trimmed, lambda a, i: F.array_position(F.transform(trimmed, lambda b: F.lower(b)), F.lower(a)) == i + 1)
    title = F.when(is_placeholder(normalize_title(F.col("title"))), F.coalesce(truthy(normalize_title(F.col("filename"))), F.lit("Untitled paper"))).otherwise(normalize_title(F.col("title")))
    return papers.withColumns({"title": title, "authors": distinct, "year": F.when(F.col("year").between(1900, 2100), F.col("year")), "venue": F.when(~is_placeholder(F.col("venue")), F.trim("venue"))})


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """B-12: a page of rows in a total order, with the ``total`` count on each."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def retention(df: DataFrame, ts: str, now, days: int) -> DataFrame:
    """B-13: rows not older than ``days`` before ``now``."""
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def weak_first_pass(hits: DataFrame) -> DataFrame:
    """B-14: ``query_id, weak`` : top score under 0.52 or fewer than 3 hits."""
    return hits.groupBy("query_id").agg((F.coalesce((F.max("score") < 0.52), F.lit(True)) | (F.count("*") < 3)).alias("weak"))


def upsert_latest(table: DataFrame, updates: DataFrame, key: list[str], version: str) -> DataFrame:
    """B-15: the newest row of each key; a null field of an update leaves the older value."""
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_first(version))
    rest = [c for c in table.columns if c not in key]
    both = table.unionByName(updates, allowMissingColumns=True).select(*key, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in rest], F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last(version))).alias("__n"))
    return both.where("__n = 1").drop("__n")
