"""C and I: matching joins, deduplication, hints, hydration."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidencelake.functions.text import jaccard
from evidencelake.operators.ranking import top_k
from evidencelake.operators.vectors import scoped_top
from evidencelake.scratch import broadcast_if_small, materialize

TITLE_BLOCK, MAX_LARGE_BANDS = 256, 1_000_000


def unread_papers(papers: DataFrame, progress: DataFrame) -> DataFrame:
    """C-3: papers without progress; null-safe, unlike NOT IN."""
    return papers.join(progress.select("paper_id"), "paper_id", "left_anti")


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (|a| + |b|), by one bit-parallel row; 100 for two empty strings."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & where.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


#: Pairs compared in step, fewest pairs and most words of 64 characters for which that is faster than one after another, bytes of their tables and rows, and steps from one look at the bounds to the next.
PAIRS_IN_STEP, FEWEST_IN_STEP, MOST_WORDS, MOST_TABLE, STEPS = 16_384, 100, 1 << 20, 64 << 20, 32


def common_lengths(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each pair ``a[i], b[j]`` the length of the longest common subsequence, or -1 as soon as it cannot reach ``need``.

    The bit rows of ``indel_ratio`` for many pairs at once: a step takes the next character of every right string. Characters that meet in a
    common sequence of ``need`` are no further apart than what either side may leave out, so only words in reach of the step change. Pairs
    drop out when at no place of the left string what is common before it and what is left behind it can add up to ``need``.
    """
    out = np.full(len(i), -1, np.int64)
    words = max(1, -(-max((len(x) for x in a), default=0) // 64))
    code = {c: k for k, c in enumerate(set().union(*a) & set().union(*b), 1)}  # 0: a character of one side only
    table = words * len(a) * (len(code) + 1)
    if len(i) < FEWEST_IN_STEP or words > MOST_WORDS or table * 8 > MOST_TABLE:
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            out[k] = _common_length(a[x], b[y], int(need[k]))
        return np.where(out >= need, out, -1)
    masks = np.zeros((words, len(a), len(code) + 1), np.uint64)
    for x, text in enumerate(a):
        for at, c in enumerate(text):
            if k := code.get(c):
                masks[at >> 6, x, k] |= np.uint64(1 << (at & 63))
    masks = masks.reshape(words, -1)
    longest = max((len(y) for y in b), default=0)
    read, lengths, own = np.zeros((longest, len(b)), np.int32), np.array([len(y) for y in b]), np.array([len(x) for x in a])
    for y, text in enumerate(b):
        read[: len(text), y] = [code.get(c, 0) for c in text]
    most = max(1, min(PAIRS_IN_STEP, MOST_TABLE // (8 * words)))
    for lo in range(0, len(i), most):
        live = np.arange(lo, min(len(i), lo + most))
        live = live[np.minimum(own[i[live]], lengths[j[live]]) >= need[live]]
        if not len(live):
            continue
        base, column, rest, size, want = i[live] * (len(code) + 1), j[live], lengths[j[live]], own[i[live]], need[live]
        rows = np.full((words, len(live)), ~np.uint64(0))
        ahead, behind, last = int((size - want).max()), int((rest - want).max()), int(rest.max())
        for step in range(last):
            at, carry = base + read[step, column], None
            for w in range(max(0, (step - behind) // 64), min(words, (step + ahead) // 64 + 1)):
                row = rows[w]
                both = row & masks[w, at]
                total = row + both
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over
                rows[w] = total | (row ^ both)
            if step % STEPS == STEPS - 1:
                keep = _still_possible(rows, size, np.maximum(rest - step - 1, 0), want, min(words, (step + ahead) // 64 + 1))
                if not keep.all():
                    live, base, column, rest, size, want, rows = live[keep], base[keep], column[keep], rest[keep], size[keep], want[keep], rows[:, keep]
                    if not len(live):
                        break
                    ahead, behind = int((size - want).max()), int((rest - want).max())
        out[live] = 64 * words - np.bitwise_count(rows).sum(axis=0, dtype=np.int64)
    return np.where(out >= need, out, -1)


def _still_possible(rows: np.ndarray, size: np.ndarray, left: np.ndarray, want: np.ndarray, words: int) -> np.ndarray:
    """Whether at the end of some 16 characters of the left strings, of ``size``, the common length so far and the ``left`` characters add up to ``want``."""
    parts = np.ascontiguousarray(rows[:words]).astype("<u8", copy=False).view("<u2").reshape(words, -1, 4)
    common, good = np.zeros(len(size), np.int32), np.zeros(len(size), bool)
    for w in range(words):
        for n in range(4):
            common += 16 - np.bitwise_count(parts[w, :, n])
            good |= common + np.minimum(size - 64 * w - 16 * n, left) >= want
    return good


def _common_length(a: str, b: str, need: int) -> int:
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for at, ch in enumerate(b):
        u = row & where.get(ch, 0)
        row = ((row + u) | (row - u)) & full
        if at % 64 == 63 and len(a) - row.bit_count() + len(b) - at - 1 < need:
            return -1
    return len(a) - row.bit_count()


def ratio_column(a: Column, b: Column) -> Column:
    """``indel_ratio`` of two columns in Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([indel_ratio(p or "", q or "") for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def _counts(titles: list[str], width: int, bins: int) -> np.ndarray:
    """How often each hashed character n-gram of ``width`` occurs in each title."""
    out = np.zeros((len(titles), bins), np.int32)
    for row, t in zip(out, titles):
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        gram = code[: max(0, len(code) - width + 1)]
        for i in range(1, width):
            gram = gram * 131 + code[i : len(code) - width + 1 + i]
        row[:] = np.bincount(gram % bins, minlength=bins)
    return out


#: n-gram width, hashed bins, and by how much one inserted or deleted character changes the counts at most.
COUNTED = ((1, 64, 1), (2, 256, 3), (3, 512, 5))


def _near_in_block(cutoff: float) -> Callable:
    """All pairs of a block's two sides with a ratio of ``cutoff`` or more; common lengths are computed where no n-gram count rules it out."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["scope", "title1", "title2", "ratio"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        a, b = left["title"].tolist(), right["title"].tolist()
        length = np.array([len(t) for t in b])
        theirs = [_counts(b, w, bins) for w, bins, _ in COUNTED]
        mine = [_counts(a, w, bins) for w, bins, _ in COUNTED]
        some: list[np.ndarray] = []
        for i, t in enumerate(a):
            edits = (1 - cutoff / 100) * (len(t) + length) + 1e-9
            at = np.flatnonzero(np.abs(len(t) - length) <= edits)
            for x, y, (_, _, change) in zip(mine, theirs, COUNTED):
                at = at[np.abs(y[at] - x[i]).sum(axis=1) <= change * edits[at]]
            some.append(at)
        i, j = np.repeat(np.arange(len(a)), [len(x) for x in some]), np.concatenate(some)
        both = np.array([len(t) for t in a])[i] + length[j]
        common = common_lengths(a, b, i, j, np.ceil(cutoff * both / 200 - 1e-6).astype(np.int64))
        ratio = np.where(both > 0, 200.0 * common / np.maximum(both, 1), 100.0)
        good = np.flatnonzero((common >= 0) & (ratio >= cutoff))
        scope = left["scope"].iloc[0]
        return pd.DataFrame([(scope, a[i[k]], b[j[k]], float(ratio[k])) for k in good.tolist()], columns=columns)

    return run


def near_titles(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """``scope, title1, title2, ratio`` of all pairs of titles of one scope with an indel ratio of ``cutoff`` or more, equal ones too.

    Both sides are ``scope, title``, each title once in a scope. A ratio of c percent bounds the longer title's length to
    (200 - c) / c times the shorter's, so a title meets only those of its own and the two next bands of length. Bands of more
    than TITLE_BLOCK titles are dealt into blocks, every block of one side meets every block of the other in a task of
    its own, and only pairs that match leave the task. Within a scope and band the work is that of all pairs, mostly a
    comparison of n-gram counts: a scope is one user's library or one search. No pair is lost. Null scopes match nothing.
    """
    step = math.log((200 - cutoff) / cutoff * (1 + 1e-9))
    n = F.length("title")
    band = F.when(n == 0, -9).otherwise(F.floor(F.log(n.cast("double")) / step + 1e-9)).cast("int")
    a = left.where("scope is not null").select("scope", "title", band.alias("band"))
    b = right.where("scope is not null").select("scope", "title", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    both = a.groupBy("scope", "band").agg(F.count("*").alias("n1"), F.lit(0).alias("n2")).unionByName(b.groupBy("scope", "band").agg(F.lit(0).alias("n1"), F.count("*").alias("n2")))
    blocks = lambda c: F.ceil(F.sum(c) / TITLE_BLOCK).cast("int").alias(c)
    large = broadcast_if_small(both.groupBy("scope", "band").agg(blocks("n1"), blocks("n2")).where("n1 > 1 or n2 > 1"), MAX_LARGE_BANDS)

    parts = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, since small tables with much work would be coalesced

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        sized = df.join(large, ["scope", "band"], "left").na.fill({"n1": 1, "n2": 1})
        mine, rest = F.pmod(F.xxhash64("title"), F.greatest(F.col(own), F.lit(1))), F.explode(F.sequence(F.lit(0), F.greatest(F.col(other), F.lit(1)) - 1))
        return sized.select(*[F.col(c).alias(c) for c in ("scope", "title", "band")], mine.cast("int").alias(own), rest.alias(other)).repartition(parts, "scope", "band", "n1", "n2").groupBy("scope", "band", "n1", "n2")

    kind = f"scope {dict(left.dtypes)['scope']}, title1 string, title2 string, ratio double"
    return dealt(a, "n1", "n2").cogroup(dealt(b, "n2", "n1")).applyInPandas(_near_in_block(cutoff), kind)


def fuzzy_title_match(jobs: DataFrame, papers: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """C-7: the best paper of the same user for each job: ``job_id, paper_id, title_ratio, match_score``.

    Titles need a ratio of ``cutoff``; the score is cut to 0.85 if the authors' ratio is 70 or less or the years are
    more than one apart, to 0.7 if both, and must reach ``cutoff`` itself. An author or a year that is unknown on either side
    agrees with any. Equal jobs are matched once, and of equal papers the lowest takes part, so repeated (or
    empty) titles make no square of pairs. Null titles count as empty; rows without a user match nothing.
    """
    row = lambda df, i: df.select(F.col("user_id").alias("scope"), F.lower(F.coalesce("title", F.lit(""))).alias(f"title{i}"), F.nullif(F.lower("author"), F.lit("")).alias(f"a{i}"), F.col("year").alias(f"y{i}"), "job_id" if i == 1 else "paper_id")
    all_jobs = row(jobs, 1)
    same = ["scope", "title1", "a1", "y1"]
    j = all_jobs.groupBy(same).agg(F.min("job_id").alias("job_id"))
    p = row(papers, 2).groupBy("scope", "title2", "a2", "y2").agg(F.min("paper_id").alias("paper_id"))
    near = near_titles(j.select("scope", F.col("title1").alias("title")).distinct(), p.select("scope", F.col("title2").alias("title")).distinct(), cutoff)
    pairs = near.join(j.drop("job_id"), ["scope", "title1"]).join(p, ["scope", "title2"])
    unknown = lambda x, y: F.col(x).isNull() | F.col(y).isNull()
    author_ok = unknown("a1", "a2") | (ratio_column(F.col("a1"), F.col("a2")) > 70)
    year_ok = unknown("y1", "y2") | (F.abs(F.col("y1") - F.col("y2")) <= 1)
    factor = F.when(author_ok & year_ok, 1.0).when(author_ok | year_ok, 0.85).otherwise(0.7)
    scored = pairs.withColumn("match_score", F.col("ratio") * factor).where(F.col("match_score") >= cutoff)
    best = top_k(scored, same, "match_score", "paper_id", 1).select(*[F.col(c).alias(f"__{c}") for c in same], "paper_id", F.col("ratio").alias("title_ratio"), "match_score")
    mine = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same])
    return all_jobs.join(best, mine).select("job_id", "paper_id", "title_ratio", "match_score")


def first_tier(matches: DataFrame) -> DataFrame:
    """C-8: for each job the match of the lowest tier, then the lowest paper."""
    w = Window.partitionBy("job_id").orderBy("tier", "paper_id")
    return matches.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def three_tier_dedupe(jobs: DataFrame, papers: DataFrame, done: DataFrame) -> DataFrame:
    """C-8: external id, then the hash of the latest completed job, then the title: ``job_id, paper_id, tier``."""
    by_id = jobs.where("external_id <> ''").join(papers.where("external_id <> ''").select("paper_id", "external_id"), "external_id").select("job_id", "paper_id", F.lit(1).alias("tier"))
    latest = done.groupBy("file_hash").agg(F.max_by("paper_id", F.struct("finished_at", "paper_id")).alias("paper_id"))
    by_hash = jobs.join(latest, "file_hash").select("job_id", "paper_id", F.lit(2).alias("tier"))
    found = by_id.unionByName(by_hash)
    rest = jobs.join(found.select("job_id"), "job_id", "left_anti")
    return first_tier(found.unionByName(fuzzy_title_match(rest, papers).select("job_id", "paper_id", F.lit(3).alias("tier"))))


def span_overlap_match(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """C-9, H-16: for each expected span of a query whether a hit has its id, overlaps it (half-open), or holds its anchor."""
    h = hits.select("query_id", F.col("chunk_id").alias("h_id"), F.col("paper_id").alias("h_paper"), F.col("start").alias("h_start"), F.col("end").alias("h_end"), F.lower("anchor").alias("h_anchor"))
    both = expected.join(h, "query_id", "left")
    exact = F.col("chunk_id") == F.col("h_id")
    same = F.col("paper_id") == F.col("h_paper")
    overlap = same & (F.greatest("start", "h_start") < F.least(F.greatest("end", "start"), F.greatest("h_end", "h_start")))
    anchor = same & (F.length("anchor") > 0) & (F.length("h_anchor") > 0) & (F.lower("anchor").contains(F.col("h_anchor")) | F.col("h_anchor").contains(F.lower("anchor")))
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return both.groupBy("query_id", "chunk_id").agg(hit(exact).alias("exact_hit"), hit(overlap).alias("overlap_hit"), hit(anchor).alias("anchor_hit"))


def assign_section_by_page(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """C-10: the first section span of the paper that covers the chunk's page; null if none."""
    near = chunks.join(spans, "paper_id", "left").withColumn("inside", F.col("page_num").between(F.col("page_start"), F.col("page_end")))
    return near.groupBy("paper_id", "chunk_id", "page_num").agg(F.min_by("span_section", F.when(F.col("inside"), F.col("ord"))).alias("section"))


#: A Jaccard similarity of keywords from which papers belong together (a fixed value).
ALIKE = 0.05


def evolution_band(hits: DataFrame, papers: DataFrame, years: int = 3, k: int = 5) -> DataFrame:
    """C-11: for each query the ``k`` most cited papers within ``years`` of its hits' years, not hits themselves, that are alike in keywords or near the latest year: ``query_id, paper_id, pub_year, rank``.

    ``papers``: ``paper_id, pub_year, keywords, citations``; ties go to the lower id. A query never meets all papers of its years: papers are ranked within each year, and within each
    keyword and year, and of a list only as many can matter as the query has hits and ``k`` more. Queries with so many keywords that one in common is not enough to be alike
    meet all papers of their keywords instead.
    """
    known = papers.select("paper_id", "pub_year", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("citations", F.lit(0)).alias("citations"))
    own = hits.select("query_id", "paper_id").distinct()
    span = own.join(known, "paper_id").groupBy("query_id").agg(F.min("pub_year").alias("lo"), F.max("pub_year").alias("hi"), F.array_distinct(F.flatten(F.collect_list("keywords"))).alias("words"))
    span = materialize(span.join(own.groupBy("query_id").agg((F.count("*") + k).alias("room")), "query_id"), "spans")
    best = [F.desc("citations"), "paper_id"]
    ranked = lambda df, *by: df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*best)))
    most, longest = span.agg(F.max("room")).first()[0] or 0, known.agg(F.max(F.size("keywords"))).first()[0] or 0
    columns = ["query_id", "paper_id", "pub_year", "citations"]

    by_year = ranked(known, "pub_year").where(F.col("__n") <= most)
    near = span.withColumn("pub_year", F.explode(F.sequence(F.col("hi") - 1, F.col("hi") + 1))).join(by_year, "pub_year").where("__n <= room").select(columns)

    narrow = F.size("words") + longest - 1 <= round(1 / ALIKE)
    terms = known.select("paper_id", "pub_year", "citations", F.size("keywords").alias("m"), F.explode(F.array_distinct("keywords")).alias("word"))
    asked = span.select("query_id", "lo", "hi", "room", F.size("words").alias("n"), narrow.alias("narrow"), F.explode("words").alias("word"))
    listed = ranked(terms, "word", "pub_year").where(F.col("__n") <= most)
    alike = asked.where("narrow").withColumn("pub_year", F.explode(F.sequence(F.col("lo") - years, F.col("hi") + years))).join(listed, ["word", "pub_year"]).where("__n <= room").select(columns)
    shared = asked.where("not narrow").join(terms, "word").where(F.col("pub_year").between(F.col("lo") - years, F.col("hi") + years)).groupBy("query_id", "paper_id", "pub_year", "citations", "n", "m").agg(F.count("*").alias("both"))
    wide = shared.where(F.col("both") / (F.col("n") + F.col("m") - F.col("both")) >= ALIKE).select(columns)

    every = near.unionByName(alike).unionByName(wide).distinct().join(own, ["query_id", "paper_id"], "left_anti")
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k).select("query_id", "paper_id", "pub_year", "rank")


#: Parts of the queries of one kind of span.
SPAN_PARTS = 32


def evolution_band_all(hits: DataFrame, papers: DataFrame, years: int = 3) -> DataFrame:
    """C-11 without a bound: for each query all papers that ``evolution_band`` ranks: ``query_id, paper_id, pub_year``.

    Years and keywords are compared once for each kind of query (the years and keywords of its hits) and kind of paper; rows are made only for the result, and
    papers meet the queries of a kind in ``SPAN_PARTS`` parts. The result is nearly all pairs where years are few; nothing of it is shuffled or held.
    """
    known = papers.select("paper_id", "pub_year", F.sort_array(F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>")))).alias("keywords"))
    own = hits.select("query_id", "paper_id").distinct()
    spans = own.join(known, "paper_id").groupBy("query_id").agg(F.min("pub_year").alias("lo"), F.max("pub_year").alias("hi"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("words"))
    spans = materialize(spans.join(own.groupBy("query_id").agg(F.collect_set("paper_id").alias("own")), "query_id"), "spans")
    near = F.col("pub_year").between(F.col("lo") - years, F.col("hi") + years) & ((jaccard(F.col("words"), F.col("keywords")) >= ALIKE) | (F.abs(F.col("pub_year") - F.col("hi")) <= 1))
    kinds = spans.select("lo", "hi", "words").distinct().join(known.select("pub_year", "keywords").distinct(), near)
    asked = spans.join(kinds, ["lo", "hi", "words"]).select("query_id", "own", "pub_year", "keywords", F.pmod(F.xxhash64("query_id"), F.lit(SPAN_PARTS)).cast("int").alias("part"))
    dealt = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPAN_PARTS - 1))))
    return asked.join(dealt, ["pub_year", "keywords", "part"]).where(~F.array_contains("own", F.col("paper_id"))).select("query_id", "paper_id", "pub_year")


def run_diff(base: DataFrame, cand: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """C-12: cases matched by id, deltas, and on which side a case is missing."""
    a = base.select(key, *[F.col(m).alias(f"base_{m}") for m in metrics], F.lit(1).alias("__a"))
    b = cand.select(key, *[F.col(m).alias(f"cand_{m}") for m in metrics], F.lit(1).alias("__b"))
    both = a.join(b, key, "full")
    side = F.when(F.col("__a").isNull(), "only_candidate").when(F.col("__b").isNull(), "only_baseline").otherwise("both")
    return both.select(key, side.alias("side"), *[(F.col(f"cand_{m}") - F.col(f"base_{m}")).alias(f"delta_{m}") for m in metrics])


def hydrate(cands: DataFrame, chunks: DataFrame) -> DataFrame:
    """C-13: the chunk's full text where it is known, else the candidate's own."""
    full = chunks.select("chunk_id", F.col("content").alias("__full"))
    return cands.join(full, "chunk_id", "left").withColumn("text", F.coalesce(F.when(F.col("__full") != "", F.col("__full")), "text")).drop("__full")


def citation_hints(hits: DataFrame, edges: DataFrame, forward: bool, k: int = 5) -> DataFrame:
    """C-15: papers that cite (forward) or are cited by a query's hits, without the hits, most cited first, k of each query.

    The papers linked to a hit are ranked once for all queries; a query takes as many of each list as it has hits and ``k`` more, since no more than
    its hits can be left out of them.
    """
    here, there = ("dst", "src") if forward else ("src", "dst")
    own = hits.select("query_id", "paper_id").distinct()
    own = materialize(own.withColumn("room", F.count("*").over(Window.partitionBy("query_id")) + k), "own")
    most, linked = own.agg(F.max("room")).first()[0] or 0, edges.select("src", "dst").distinct()
    cited = linked.groupBy(F.col("dst").alias("other")).agg(F.count("*").alias("cited_by"))
    each = linked.select(F.col(here).alias("paper_id"), F.col(there).alias("other")).join(own.select("paper_id"), "paper_id", "left_semi").join(cited, "other", "left").na.fill({"cited_by": 0})
    listed = each.withColumn("__n", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("cited_by"), "other"))).where(F.col("__n") <= most)
    found = own.join(listed, "paper_id").where("__n <= room").select("query_id", F.col("other").alias("paper_id"), "cited_by").distinct()
    return top_k(found.join(own, ["query_id", "paper_id"], "left_anti"), ["query_id"], "cited_by", "paper_id", k)


#: Papers of one method set that one task holds on each side.
SET_BLOCK = 4096


def same_method_hints(methods: DataFrame, least: float = 0.25) -> DataFrame:
    """C-16: pairs of papers whose method sets have a Jaccard similarity of ``least``; candidates share a method.

    Papers with the same methods are compared as one; their pairs are only made for the result, where the papers of a set are dealt into blocks of about ``SET_BLOCK``,
    and blocks meet in tasks of their own. Sets go by number and methods stay with them: papers and blocks are joined by shuffle, since Spark's guess of their
    size goes by compressed files and would broadcast what is many times as large.
    """
    papers = methods.where("paper_id is not null").groupBy("paper_id").agg(F.sort_array(F.collect_set("method")).alias("methods"))  # nulls are no methods
    papers = materialize(papers.withColumn("set", F.xxhash64(F.size("methods"), "methods")), "methods")
    sets = materialize(papers.groupBy("set").agg(F.first("methods").alias("methods"), F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("blocks")), "sets")
    one = sets.select("set", F.size("methods").alias("n"), F.explode("methods").alias("method"))
    other = one.select(F.col("set").alias("other"), F.col("n").alias("m"), "method")
    both = one.join(other.hint("merge"), "method").groupBy("set", "other", "n", "m").agg(F.count("*").alias("k"))
    alike = both.withColumn("similarity", F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).where(F.col("similarity") >= least)
    blocks = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    size = lambda c: sets.select(F.col("set").alias(c), F.col("blocks").alias(f"of_{c}"))
    cells = alike.join(size("set"), "set").join(size("other"), "other").select("set", "other", "similarity", blocks("of_set").alias("block"), "of_other")
    cells = cells.select("set", "other", "block", blocks("of_other").alias("other_block"), "similarity")
    dealt = papers.join(sets.select("set", "blocks"), "set").select("paper_id", "set", F.pmod(F.xxhash64("paper_id"), F.col("blocks")).cast("int").alias("block"))
    cell, parts = ["set", "other", "block", "other_block"], 4 * int(methods.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, since few rows make many pairs
    a = cells.join(dealt.hint("merge"), ["set", "block"]).select(*cell, "paper_id", "similarity").repartition(parts, *cell)
    own = dealt.select(F.col("paper_id").alias("other_id"), F.col("set").alias("other"), F.col("block").alias("other_block"))
    b = cells.drop("similarity").join(own.hint("merge"), ["other", "other_block"]).select(*cell, "other_id").repartition(parts, *cell)
    return a.join(b.hint("merge"), cell).where("paper_id < other_id").select("paper_id", "other_id", "similarity")


def semantic_lookup(queries: DataFrame, cache: DataFrame, least: float = 0.95) -> DataFrame:
    """C-18: the most similar unexpired cache entry with the same scope of papers, at ``least`` cosine."""
    scope = lambda df: df.withColumn("scope", F.array_join(F.sort_array(F.col("paper_ids").cast("array<string>")), ","))
    c = scope(cache.where("not expired")).withColumnRenamed("entry_id", "vec_id")
    return scoped_top(scope(queries), c, 1, "scope", least).select("query_id", F.col("vec_id").alias("entry_id"), "score")


def annotate_library_status(results: DataFrame, papers: DataFrame) -> DataFrame:
    """C-20: the library's paper by arXiv id, else S2 id, else DOI, and its status."""
    out = results
    for n, key in enumerate(("arxiv_id", "s2_id", "doi")):
        lib = papers.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(F.struct("paper_id", "has_fulltext")).alias(f"__m{n}"))
        out = out.join(lib, key, "left")
    m = F.coalesce("__m0", "__m1", "__m2")
    status = F.when(m.isNull(), "not_imported").when(m["has_fulltext"], "fulltext_ready").otherwise("metadata_only")
    return out.withColumns({"library_paper_id": m["paper_id"], "library_status": status}).drop("__m0", "__m1", "__m2")


def resolve_source(legacy: DataFrame, index: DataFrame) -> DataFrame:
    """C-21: the index row that a legacy citation means: paper 8 (required), section 4 or 2, page 3 or 1, text 8, 6 or 4; longer text on ties."""
    i = index.select("paper_id", F.col("chunk_id").alias("i_chunk"), F.col("section").alias("i_section"), F.col("page_num").alias("i_page"), F.col("content").alias("i_text"))
    both = legacy.join(i, "paper_id")
    section = F.when(F.lower("section") == F.lower("i_section"), 4).when(F.lower("i_section").contains(F.lower("section")), 2).otherwise(0)
    page = F.when(F.col("page_num") == F.col("i_page"), 3).when(F.abs(F.col("page_num") - F.col("i_page")) == 1, 1).otherwise(0)
    text = F.when(F.lower("i_text") == F.lower("anchor"), 8).when(F.lower("i_text").contains(F.lower("anchor")), 6).when(F.lower("i_text").contains(F.lower(F.substring("anchor", 1, 40))), 4).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    scored = both.withColumn("match_score", 8 + zero(section) + zero(page) + zero(text))
    w = Window.partitionBy("legacy_id").orderBy(F.desc("match_score"), F.desc(F.length("i_text")), "i_chunk")
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("legacy_id", F.col("i_chunk").alias("chunk_id"), "match_score")


#: Kinds of hint that help each query family (fixed values).
HINT_FAMILIES = {"forward": ("fact", "compare", "critique"), "backward": ("fact", "limitation"), "same_method": ("compare", "numeric"), "evolution": ("survey", "evolution")}


def hints_for_family(queries: DataFrame, hints: DataFrame) -> DataFrame:
    """C-17: of all ``hints(query_id, kind, paper_id)`` those whose kind helps the query's family."""
    table = F.create_map(*[x for k, fs in HINT_FAMILIES.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in fs]))])
    both = hints.join(queries.select("query_id", "family"), "query_id")
    return both.where(F.array_contains(table[F.col("kind")], F.col("family")))
