"""Operator 10: benchmark decontamination by spaced seeds, in DataFrame functions only.

A spaced seed hashes the words that a fixed mask selects and ignores the rest, so a changed
word at an ignored place leaves the seed as it is. Seeds of all places of all texts meet
the seeds of the benchmark items in a hash join; each hit fixes an alignment, and the
alignment is verified by counting equal words over the whole item. The benchmark goes to the
texts, a large one in rounds; of a very large one only seeds, ids and places are shuffled, and the hits find texts and items by id.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencelake.scratch import broadcast_if_small, is_small, materialize

#: Places that each mask selects (fixed values; each weighs 4). No alignment is lost: of any SPAN or more
#: words in a row of which the share SHARE is equal, some mask selects only equal ones. The tests run through
#: all patterns of SPAN to 2 * SPAN - 1 words; longer items consist of such pieces, and one piece has the share.
MASKS = ((0, 2, 4, 5), (0, 1, 7, 8), (0, 1, 4, 6), (0, 2, 3, 4), (0, 1, 2, 3), (0, 2, 5, 6), (0, 1, 8, 9), (0, 1, 5, 7), (0, 1, 2, 7))
#: Items of fewer words are searched for verbatim.
SPAN = 9
#: An item has leaked where at least this share of its words stands in place.
SHARE = 0.6
MAX_BROADCAST_SEEDS, MAX_BROADCAST_WORDS = 2_000_000, 4_000_000
MAX_BROADCAST_IDS = 2_000_000
#: Rounds over the texts that cost less than shuffling every seed of every text.
MOST_ROUNDS = 16


def word_hashes(text: Column) -> Column:
    """Hashes of the words (runs of letters and digits, lower case) of a text; none for a null one."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``h``, word hashes) once for each place and mask: adds ``at`` and ``seed``; none for fewer words than a mask spans."""
    shortest = 1 + min(mask[-1] for mask in MASKS)
    places = rows.withColumn("at", F.explode(F.when(F.size("h") >= shortest, F.sequence(F.lit(0), F.size("h") - shortest))))
    made = [F.when(F.col("at") + mask[-1] < F.size("h"), F.xxhash64(F.lit(m), *[F.get("h", F.col("at") + o) for o in mask])) for m, mask in enumerate(MASKS)]
    return places.withColumn("seed", F.explode(F.array(*made))).where("seed is not null")


def all_small(rows: DataFrame, words: str, most_rows: int) -> bool:
    """Whether ``rows`` are at most ``most_rows``, and the arrays in ``words`` hold at most MAX_BROADCAST_WORDS values (32 MB) together."""
    return is_small(rows, most_rows) and (rows.agg(F.sum(F.size(words))).first()[0] or 0) <= MAX_BROADCAST_WORDS


def short_leaks(texts: DataFrame, items: DataFrame) -> DataFrame | None:
    """Verbatim copies of items of fewer than SPAN words: ``doc_id, item_id, item_words, equal_words, doc_word``; None if there are no such items."""
    n = F.size("h")
    short = items.where((n > 0) & (n < SPAN)).select("item_id", n.cast("long").alias("item_words"), F.xxhash64(n, "h").alias("seed")).distinct()
    lengths = sorted(r.item_words for r in short.select("item_words").distinct().collect())
    if not lengths:
        return None
    places = texts.withColumn("at", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    made = [F.when(F.col("at") + k <= n, F.xxhash64(F.lit(k), F.slice("h", F.col("at") + 1, k))) for k in lengths]
    seeded = places.select("doc_id", "at", F.explode(F.array(*made)).alias("seed")).where("seed is not null")
    hits = seeded.join(broadcast_if_small(short, MAX_BROADCAST_SEEDS), "seed")
    first = hits.groupBy("doc_id", "item_id", "item_words").agg(F.min("at").cast("long").alias("doc_word"))
    return first.select("doc_id", "item_id", "item_words", F.col("item_words").alias("equal_words"), "doc_word")


def _hits(texts: DataFrame, items: DataFrame) -> list[DataFrame]:
    """For each round ``doc_id, h, item_id, doc_word, item_h``: where items of SPAN words or more may begin in texts, by their seeds.

    Seeds and words of items are broadcast, in up to MOST_ROUNDS rounds over the texts, so a task holds at most MAX_BROADCAST_SEEDS and MAX_BROADCAST_WORDS of them
    however many items there are. Where even that is too little, seeds meet by shuffle, and no side is broadcast on Spark's guess of its size.
    """
    place = (F.col("at") - F.col("item_at")).alias("doc_word")
    item_seeds = lambda some: seeds(some).select("seed", "item_id", F.col("at").alias("item_at")).distinct()
    item_words = lambda some: some.select("item_id", F.col("h").alias("item_h"))
    sized = items.select("item_id", F.size("h").cast("long").alias("words"))
    total = sized.agg(F.sum("words")).first()[0] or 0
    rounds = max(1, *[math.ceil(n / most) if most else MOST_ROUNDS + 1 for n, most in ((total * len(MASKS), MAX_BROADCAST_SEEDS), (total, MAX_BROADCAST_WORDS))])
    while rounds <= MOST_ROUNDS:
        own = F.pmod(F.xxhash64("item_id"), F.lit(rounds))
        most = sized.groupBy(own.alias("round")).agg(F.sum("words").alias("words")).agg(F.max("words")).first()[0] or 0
        if most * len(MASKS) <= MAX_BROADCAST_SEEDS and most <= MAX_BROADCAST_WORDS:
            some = [items.where(own == r) if rounds > 1 else items for r in range(rounds)]
            return [seeds(texts).join(F.broadcast(item_seeds(i)), "seed").select("doc_id", "h", "item_id", place).join(F.broadcast(item_words(i)), "item_id") for i in some]
        rounds += 1  # the hash has dealt too many to one round
    found = seeds(texts).select("seed", "doc_id", "at").join(item_seeds(items).hint("merge"), "seed").select("doc_id", "item_id", place).distinct()
    return [found.join(texts.hint("merge"), "doc_id").join(item_words(items).hint("merge"), "item_id")]


def _in_place(hits: DataFrame, share: float) -> DataFrame:
    """``doc_id, item_id, item_words, equal_words, doc_word``: the best alignment of each document and item among the hits, if it has the share."""
    equal = F.aggregate(
        F.sequence(F.lit(0), F.size("item_h") - 1), F.lit(0), lambda n, j: n + F.coalesce(F.when((F.col("doc_word") + j >= 0) & (F.get("h", F.greatest(F.col("doc_word") + j, F.lit(0))) == F.get("item_h", j)), 1), F.lit(0))
    )
    # One long for each hit, greatest for the most equal words and then the earliest place; a filter
    # before the aggregation would move the word count into the join and out of generated code.
    low = 1 << 40
    code = equal.cast("long") * low + (low // 2 - F.col("doc_word"))
    best = hits.select("doc_id", "item_id", F.size("item_h").alias("item_words"), code.alias("code")).groupBy("doc_id", "item_id", "item_words").agg(F.max("code").alias("code"))
    seen = best.select("doc_id", "item_id", F.col("item_words").cast("long").alias("item_words"), F.shiftright("code", 40).alias("equal_words"), (low // 2 - F.col("code").bitwiseAND(F.lit(low - 1))).alias("doc_word"))
    return seen.where(F.col("equal_words") >= F.ceil(F.col("item_words") * share))


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """One row for each leaked item of each document: ``doc_id, item_id, equal_words, item_words, doc_word``.

    Whole for a ``share`` of SHARE or more; below it MASKS may miss alignments.

    ``equal_words`` is the best alignment's count of item words in place (at least ``share`` of
    the item), ``doc_word`` the document's word where the item begins (may be negative where the
    item's beginning lies before the text). Null and empty texts and items give
    no rows. Items of fewer than SPAN words count where they stand verbatim, in texts of any length.
    Repeated document or item rows give one row for each pair of ids; null
    ids are left out; extra columns are not read; an empty table gives no rows. Items of equal words are searched for as one. The benchmark's seeds and words
    are broadcast, round by round if they are many; beyond MOST_ROUNDS seeds are shuffled with ids and places only.
    """
    items = benchmark.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("h")).distinct().withColumn("kind", F.xxhash64(F.size("h"), "h"))
    ids = items.where(F.size("h") > 0).select("kind", "item_id")
    kinds = items.select(F.col("kind").alias("item_id"), "h").dropDuplicates(["item_id"])  # equal texts are one item until the end
    texts = docs.where("doc_id is not null").select("doc_id", word_hashes(F.col("text")).alias("h"))
    hits = _hits(texts, kinds.where(F.size("h") >= SPAN))
    found = [_in_place(h, share) for h in hits]  # a round is done before the next is broadcast
    good = functools.reduce(DataFrame.unionByName, [materialize(f, "leaks") for f in found] if len(found) > 1 else found)
    short = short_leaks(texts, kinds)
    if short is not None:
        good = good.unionByName(short)
    good = good.withColumnRenamed("item_id", "kind").join(broadcast_if_small(ids, MAX_BROADCAST_SEEDS), "kind")
    one = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("equal_words", "item_words", (-F.col("doc_word")).alias("minus"))).alias("one"))
    return one.select("doc_id", "item_id", "one.equal_words", "one.item_words", (-F.col("one.minus")).alias("doc_word"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose document leaks an item; rows with a null id stay."""
    gone = materialize(find_leaks(docs, benchmark).select("doc_id").distinct(), "leaked")
    return docs.join(broadcast_if_small(gone, MAX_BROADCAST_IDS), "doc_id", "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every alignment of every document and item by brute force: pairs of equal words.
ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
iw AS (SELECT item_id, len(w) AS item_words, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM i),
hit AS (SELECT doc_id, item_id, item_words, p - q AS doc_word, count(*) AS equal_words FROM dw JOIN iw USING (word) GROUP BY ALL
  HAVING count(*) >= CASE WHEN item_words < {SPAN} THEN item_words ELSE ceil(item_words * {SHARE}) END)
SELECT doc_id, item_id, equal_words, item_words, doc_word FROM hit
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal_words DESC, doc_word) = 1
"""
