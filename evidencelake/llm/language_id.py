"""Operator 6: language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3) in order. A document's
profile is compared with each language's by the out-of-place distance: the sum over its
n-grams of how far each is from its place in the language's profile, and the profile's
length where it is absent. The nearest language wins, the first by name on ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evidencelake.scratch import is_small, materialize

PROFILE, ORDERS, MAX_PROFILE_ROWS = 300, 3, 300 * 500
SPACE = 32
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters; one table for each worker process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text, lower case, every run of other characters as one space; empty without a letter.

    A code holds up to three code points of 21 bits. n-grams of one space only are left out.
    """
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    s = np.concatenate(([SPACE], np.where(is_letter, points, SPACE), [SPACE])).astype(np.int64)
    s = s[np.concatenate(([True], (s[1:] != SPACE) | (s[:-1] != SPACE)))]
    pairs = s[:-1] << 21 | s[1:]
    return np.concatenate((s[s != SPACE], pairs, pairs[:-1] << 21 | s[2:]))


def profile(codes: np.ndarray, length: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; equal counts in order of code."""
    kinds, counts = np.unique(codes, return_counts=True)
    return kinds[np.argsort(-counts, kind="stable")[:length]]


def held_out() -> Column:
    """Whether crc32 of the id's text leaves 2 on division by 4; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_profiles(rows: DataFrame, length: int = PROFILE) -> DataFrame:
    """``lang, gram, place`` of the most frequent n-grams of each language in ``rows(lang, text)``.

    All n-grams of all rows count. Each batch sends one count for each distinct n-gram, so a
    language with most of the rows is summed before the shuffle. Rows without language or letter add nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                kinds, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = ngrams(text)
                held.setdefault(lang, []).append(codes)
                size += len(codes)
                if size > 8_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = rows.where("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return total.withColumn("rank", rank).where(F.col("rank") <= length).select("lang", "gram", (F.col("rank") - 1).alias("place"))


def _by_join(docs: DataFrame, profiles: DataFrame, length: int) -> DataFrame:
    """``predict`` for profiles too large to hold in every task: documents' own profiles meet them by n-gram.

    A language's distance is ``length`` for each n-gram of the document, less what the n-grams in its profile save.
    """

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = profile(ngrams(text), length)
                columns = [pa.array([row] * len(own), pa.int64()), pa.array(own.astype(np.int64)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array([len(own)] * len(own), pa.int32())]
                yield pa.record_batch(columns, names=["__row", "gram", "at", "own"])

    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "language-rows")
    own = materialize(rows.select("__row", "text").mapInArrow(tops, "__row long, gram long, at int, own int"), "own-profiles")
    saved = own.join(profiles, "gram").groupBy("__row", "lang").agg(F.sum(length - F.abs(F.col("place") - F.col("at"))).alias("saved"))
    two = saved.groupBy("__row").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("saved")).alias("less"), "lang"))), 1, 2).alias("two"))
    names = profiles.agg(F.min("lang").alias("first"), F.count_distinct("lang").alias("langs"))
    sized = own.groupBy("__row").agg((F.first("own").cast("long") * length).alias("all")).join(two, "__row", "left").crossJoin(F.broadcast(names))  # one row
    far = lambda i: F.col("all") + F.coalesce(F.get("two", F.lit(i))["less"], F.lit(0))
    best, second = far(0), F.when(F.col("langs") > 1, far(1)).otherwise(1)
    judged = sized.select("__row", F.coalesce(F.get("two", F.lit(0))["lang"], "first").alias("lang_pred"), F.when(second > 0, second / (best + second)).otherwise(0.5).alias("score"))
    out = rows.drop("lang_pred", "score").join(judged, "__row", "left").drop("__row")
    return out.withColumns({"lang_pred": F.coalesce("lang_pred", F.lit("und")), "score": F.coalesce("score", F.lit(0.0))})


def predict(docs: DataFrame, profiles: DataFrame, length: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred, score`` added (columns of these names are replaced).

    ``und`` and 0 for a null text, one without a letter, or when no language is known. The score is
    the runner-up's share of the two least distances: 0.5 on a tie, towards 1 the clearer.
    Profiles of up to MAX_PROFILE_ROWS rows go to the driver and to every task; more of them are joined by n-gram.
    """
    if not is_small(profiles, MAX_PROFILE_ROWS):
        return _by_join(docs, profiles, length)
    known = profiles.toPandas()
    langs = sorted(known["lang"].unique())
    grams = np.unique(known["gram"].to_numpy(np.int64)) if len(known) else np.empty(0, np.int64)
    places = np.full((len(langs), len(grams) + 1), -1, np.int32)
    for i, lang in enumerate(langs):
        own = known[known["lang"] == lang]
        places[i, np.searchsorted(grams, own["gram"].to_numpy(np.int64))] = own["place"].to_numpy(np.int32)

    @F.pandas_udf("lang_pred string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                codes = ngrams(text)
                if not len(codes) or not langs:
                    out.append(("und", 0.0))
                    continue
                own = profile(codes, length)
                at = np.searchsorted(grams, own)
                at[grams[np.minimum(at, len(grams) - 1)] != own] = len(grams)
                there = places[:, at]
                far = np.where(there < 0, length, np.abs(there - np.arange(len(own)))).sum(axis=1)
                best = int(far.argmin())
                second = np.delete(far, best).min() if len(langs) > 1 else 1
                out.append((langs[best], float(second / (far[best] + second)) if second else 0.5))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*keep, nearest.asNondeterministic()(F.col("text")).alias("__found"))
    return found.select(*keep, F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with profiles from all that may be learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = materialize(language_profiles(docs.where(~held_out())), "language-profiles")
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")
