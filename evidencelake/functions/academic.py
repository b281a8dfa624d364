"""F: references, captions, titles and clean-up of academic text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidencelake.functions.text import first_rule


def expand_synonyms(questions: DataFrame, synonyms: DataFrame, most: int = 2) -> DataFrame:
    """F-10: ``query_id, expanded``: the question with up to ``most`` synonyms of each of its words; ``synonyms``: ``word, synonym, ord``."""
    w = F.explode(F.array_distinct(F.split(F.lower("question"), r"\W+"))).alias("word")
    found = questions.select("query_id", w).join(synonyms, "word")
    n = F.row_number().over(Window.partitionBy("query_id", "word").orderBy("ord", "synonym"))
    kept = found.withColumn("n", n).where(F.col("n") <= most).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("synonym")), " ").alias("more"))
    return questions.join(kept, "query_id", "left").select("query_id", F.concat_ws(" ", "question", "more").alias("expanded"))


def evidence_metadata(text: Column, start: Column) -> Column:
    """F-22: figure and table number, caption (the sentence that begins with it) and character span."""
    t = F.coalesce(text, F.lit(""))
    get = lambda p, i: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    return F.struct(
        get(r"(?i)\bfig(?:ure)?\.?\s*(\d+)", 1).alias("figure"), get(r"(?i)\btable\s*(\d+)", 1).alias("table"), get(r"(?i)((?:table|fig(?:ure)?\.?)\s*\d+[:.][^.]*\.?)", 1).alias("caption"),
        start.alias("span_start"), (start + F.length(t)).alias("span_end"),
    )


def figure_contexts(text: Column, most: int = 3) -> Column:
    """F-24: up to ``most`` sentences that mention a figure."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?is)([^.!?]*\bfig(?:ure)?\.?\s*\d+[^.!?]*[.!?])"), 1), lambda s: F.trim(s))), 1, most)


def clean_compare_text(text: Column, most: int = 220) -> Column:
    """F-29: numbered headings, citation marks, hyphenation and blanks cleaned to a fixed point (four passes), cut at a word to ``most``."""
    c = F.coalesce(text, F.lit(""))
    for _ in range(4):
        c = F.regexp_replace(c, r"^\s*(?:\d+(?:\.\d+)*\.?\s+|[-*•]\s+)", "")
        c = F.regexp_replace(c, r"\[\d+(?:\s*,\s*\d+)*\]|\(\s*\)", "")
        c = F.trim(F.regexp_replace(F.regexp_replace(c, r"(\w)-\s*\n\s*(\w)", "$1$2"), r"\s+", " "))
    cut = F.regexp_replace(F.substring(c, 1, most), r"\s+\S*$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("…")))


def line_kind(line: Column) -> Column:
    """F-29: whether a line is a reference, an author line, a title or text."""
    t = F.trim(F.coalesce(line, F.lit("")))
    return first_rule([
        (t.rlike(r"^\[\d+\]|^\d+\.\s+[A-Z][^.]+\.\s.*\b(?:19|20)\d\d\b"), "reference"), (t.rlike(r"^[A-Z][a-z]+ [A-Z][a-z]+(?:,\s*[A-Z][a-z]+ [A-Z][a-z]+)+$"), "authors"),
        ((F.length(t) < 120) & t.rlike(r"^[A-Z]") & ~t.rlike(r"[.!?]$"), "title"),
    ], "text")


def references(texts: DataFrame) -> DataFrame:
    """F-39: items of the reference section: ``paper_id, ref_no, year, title``; a repeated title (case aside) once."""
    section = F.regexp_extract("text", r"(?is)\n\s*(?:references|bibliography)\s*\n(.*)$", 1)
    items = F.filter(F.split(section, r"\n\s*(?=\[\d+\]|\d+\.\s)|^\s*(?=\[\d+\])"), lambda s: F.trim(s) != "")
    each = texts.select("paper_id", F.posexplode(items).alias("ref_no", "item"))
    body = F.regexp_replace(F.trim("item"), r"^(?:\[\d+\]|\d+\.)\s*", "")
    year = F.nullif(F.regexp_extract(body, r"\b((?:19|20)\d\d)\b", 1), F.lit("")).cast("int")
    title = F.trim(F.coalesce(F.nullif(F.regexp_extract(body, "[\"“]([^\"”]+)[\"”]", 1), F.lit("")), F.nullif(F.regexp_extract(body, r"^[^.]+\.\s*([^.]+)\.", 1), F.lit("")), F.regexp_extract(body, r"^([^.]+)", 1)))
    made = each.select("paper_id", "ref_no", year.alias("year"), title.alias("title")).where("title <> ''")
    first = F.row_number().over(Window.partitionBy("paper_id", F.lower("title")).orderBy("ref_no"))
    return made.withColumn("n", first).where("n = 1").drop("n")


def title_score(line: Column, pos: Column) -> Column:
    """F-40: how likely a line is the title: near the top, of fair length, capitalised, no sentence, no address."""
    n = F.length(F.trim(line))
    return (
        F.greatest(F.lit(0), 10 - pos) + F.when(n.between(20, 150), 5).otherwise(0) + F.when(F.trim(line).rlike(r"^[A-Z]"), 2).otherwise(0)
        - F.when(F.trim(line).rlike(r"[.!?]$"), 3).otherwise(0) - F.when(line.rlike(r"@|https?://|(?i)university|arxiv"), 8).otherwise(0)
    )


def best_title(lines: DataFrame) -> DataFrame:
    """F-40: the best line of each paper as its title; the earlier on ties."""
    return lines.groupBy("paper_id").agg(F.max_by("line", F.struct(title_score(F.col("line"), F.col("pos")).alias("s"), (-F.col("pos")).alias("p"))).alias("title"))


def doi(text: Column) -> Column:
    """F-40: first DOI, without the punctuation after it."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;:)\]]+$", ""), F.lit(""))
