"""C-5, C-6 and A-5: vector search by Arrow batches. The plug-in surface for models is L-1."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Observation, functions as F

from evidencelake.operators.ranking import top_k
from evidencelake.scratch import is_small

QUERY_BLOCK = 4096
#: Tasks over which the meetings of blocks of one scope are spread.
MEETINGS = 64
#: Queries of a block, and pairs of these, whose scores are held at once.
QUERY_SLICE, PAIRS_AT_ONCE = 256, 65_536
#: Vectors of a block that meets blocks of queries, and scores of such a meeting that are held at once.
VECTOR_BLOCK, SCORES_AT_ONCE = 65_536, 4_000_000
#: Most cells of an inverted file, and about the most vectors that its centres are fitted on and its probes are measured on.
MAX_CELLS, MAX_FIT, MAX_MEASURED = 4096, 200_000, 20_000


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def valid_vectors(df: DataFrame, dim: int, col: str = "embedding") -> Column:
    """A-5: neither null nor of another dimension nor all zero."""
    return F.coalesce((F.size(col) == dim) & F.exists(col, lambda v: v != 0), F.lit(False))


def write_vectors(df: DataFrame, path: str, dim: int, col: str = "embedding") -> DataFrame:
    """A-5: the rows with a valid vector as Parquet below ``path``, and how many were left out and why: ``reason, n``.

    ``reason``: ``kept``, ``no_embedding`` (null, empty or all zero) or ``wrong_dimension``. Tasks write to names of their own that the commit makes
    visible at once, so retried tasks leave no vector twice. One pass: the counts are observed while the rows are written.
    """
    some = F.coalesce(F.exists(col, lambda v: v != 0), F.lit(False))
    reason = F.when(~some, "no_embedding").when(F.size(col) != dim, "wrong_dimension").otherwise("kept")
    seen, reasons = Observation(), ("kept", "no_embedding", "wrong_dimension")
    counted = df.observe(seen, *[F.count_if(reason == r).alias(r) for r in reasons])
    counted.where(valid_vectors(df, dim, col)).write.mode("overwrite").parquet(path)
    return df.sparkSession.createDataFrame([(r, seen.get[r]) for r in reasons if seen.get[r]], "reason string, n long")


def _unit_rows(rows: pd.Series) -> np.ndarray:
    """Vectors as rows of unit length; those with a null or of zeros as zeros."""
    m = np.array(rows.tolist(), np.float64).reshape(len(rows), -1)
    m[np.isnan(m).any(axis=1)] = 0.0
    return _unit(m)


def _met(queries: DataFrame, vectors: DataFrame, scores: Callable) -> DataFrame:
    """``scores`` of every block of queries with every block of vectors that it meets; both sides have ``qb, vb``, and a task holds one such pair of blocks at a time."""
    parts = 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, since few blocks with much work would be coalesced
    side = lambda df: df.repartition(parts, "qb", "vb").groupBy("qb", "vb")
    return side(queries).cogroup(side(vectors)).applyInPandas(scores, "query_id long, vec_id long, score double")


def _blocks(df: DataFrame, most: int) -> int:
    return max(1, -(-df.count() // most))


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _best_pairs(k: int, drop_same: bool = False, centres: np.ndarray | None = None, nprobe: int = 0) -> Callable:
    """The k best vectors of a block for each query of a block, scores taken pair by pair, so that equal vectors tie; with ``centres`` only those whose ``cell`` is among the query's ``nprobe`` nearest."""

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        q_ids, v_ids, out = q["query_id"].to_numpy(), v["vec_id"].to_numpy(), [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if not len(q) or not len(v):
            return out[0]
        every, b = _unit_rows(q["embedding"]), _unit_rows(v["embedding"])
        step = max(1, SCORES_AT_ONCE // len(b))
        for at in range(0, len(every), step):
            x = every[at : at + step]
            score = x @ b.T
            if drop_same:
                score[q_ids[at : at + step, None] == v_ids[None, :]] = -np.inf
            if centres is not None:
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :nprobe]
                probed = np.zeros((len(x), len(centres)), bool)
                probed[np.arange(len(x))[:, None], near] = True
                score[~probed[:, v["cell"].to_numpy()]] = -np.inf
            n = min(k, score.shape[1])
            edge = np.partition(score, -n, axis=1)[:, -n][:, None]
            row, col = np.nonzero(np.isfinite(score) & (score >= edge - 1e-9))
            exact = np.zeros(len(row))
            for i in range(0, len(row), PAIRS_AT_ONCE):
                s = slice(i, i + PAIRS_AT_ONCE)
                exact[s] = (x[row[s]] * b[col[s]]).sum(axis=1)
            best = np.lexsort((v_ids[col], -exact, row))
            best = best[np.arange(len(best)) - np.searchsorted(row[best], row[best]) < k]
            out.append(pd.DataFrame({"query_id": q_ids[at + row[best]], "vec_id": v_ids[col[best]], "score": exact[best]}))
        return pd.concat(out)

    return run


def _block_top(ids: np.ndarray, queries: np.ndarray, k: int, drop_same: bool) -> Callable:
    """Each batch's k best vectors of every query of a block: no more rows leave a task than k for each query and batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            score = queries @ _unit(np.array(pdf["embedding"].tolist(), np.float64)).T
            own = pdf["vec_id"].to_numpy()
            if drop_same:
                score[ids[:, None] == own[None, :]] = -np.inf
            n = min(k, score.shape[1])
            at = np.argpartition(-score, n - 1, axis=1)[:, :n]
            edge = np.take_along_axis(score, at, 1).min(axis=1, keepdims=True)
            row, col = np.nonzero(score >= edge)  # ties at the edge stay
            ok = np.isfinite(score[row, col])
            yield pd.DataFrame({"query_id": ids[row[ok]], "vec_id": own[col[ok]], "score": score[row[ok], col[ok]]})

    return run


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, drop_same: bool = False) -> DataFrame:
    """C-5: exact cosine top-k of ``queries(query_id, embedding)`` in ``vectors(vec_id, embedding)``: ``query_id, vec_id, score, rank``.

    Up to QUERY_BLOCK questions go to every task, and one pass of matrix products over the vectors
    where they lie gives k rows for each question and batch. More questions are dealt into blocks of about eight times that
    size, vectors into blocks of about VECTOR_BLOCK, and each two blocks meet once, in a group of their own. Zero vectors score 0.
    """
    kind = "query_id long, vec_id long, score double"
    if is_small(queries, QUERY_BLOCK):
        rows = queries.select("query_id", "embedding").orderBy("query_id").toPandas()
        if rows.empty:
            return top_k(queries.sparkSession.createDataFrame([], kind), ["query_id"], "score", "vec_id", k)
        score = _block_top(rows["query_id"].to_numpy(), _unit(np.array(rows["embedding"].tolist(), np.float64)), k, drop_same)
        return top_k(vectors.select("vec_id", "embedding").mapInPandas(score, kind), ["query_id"], "score", "vec_id", k)

    nq, nv = _blocks(queries, QUERY_BLOCK * 8), _blocks(vectors, VECTOR_BLOCK)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    asked = queries.select("query_id", "embedding", dealt("query_id", nq).alias("qb"), _numbers(nv).alias("vb"))
    stored = vectors.select("vec_id", "embedding", dealt("vec_id", nv).alias("vb"), _numbers(nq).alias("qb"))
    return top_k(_met(asked, stored, _best_pairs(k, drop_same)), ["query_id"], "score", "vec_id", k)


def scoped_top(queries: DataFrame, vectors: DataFrame, k: int, scope: str, least: float = -2.0) -> DataFrame:
    """Exact cosine top-k of ``queries(query_id, embedding, scope)`` among the ``vectors(vec_id, embedding, scope)`` of the same scope, at ``least``: ``query_id, vec_id, score, rank``.

    Both sides are dealt into blocks of about QUERY_BLOCK within their scope, and blocks of a scope meet in matrix products; scores are then taken pair
    by pair, so that equal vectors tie. Unequal lengths, null and zero vectors score 0.
    """

    def units(rows: list) -> np.ndarray:
        m = np.array([x["e"] for x in rows], np.float64).reshape(len(rows), -1)
        m[np.isnan(m).any(axis=1)] = 0.0
        return _unit(m)

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, v in zip(pdf["queries"], pdf["vectors"]):
                q_ids, v_ids, every, b = np.array([x["id"] for x in q]), np.array([x["id"] for x in v]), units(q), units(v)
                for at in range(0, len(every), QUERY_SLICE):
                    a = every[at : at + QUERY_SLICE]
                    like = a.shape[1] == b.shape[1]
                    score = a @ b.T if like else np.zeros((len(a), len(b)))
                    n = min(k, score.shape[1])
                    edge = np.partition(score, -n, axis=1)[:, -n][:, None]
                    row, col = np.nonzero((score >= edge - 1e-9) & (score >= least - 1e-9))
                    exact = np.zeros(len(row))
                    for i in range(0, len(row) if like else 0, PAIRS_AT_ONCE):
                        s = slice(i, i + PAIRS_AT_ONCE)
                        exact[s] = (a[row[s]] * b[col[s]]).sum(axis=1)
                    best = np.lexsort((v_ids[col], -exact, row))
                    first = np.searchsorted(row[best], row[best])  # of the same query
                    best = best[np.arange(len(best)) - first < k]
                    yield pd.DataFrame({"query_id": q_ids[at + row[best]], "vec_id": v_ids[col[best]], "score": exact[best]})

    def dealt(df: DataFrame, key: str, name: str) -> DataFrame:
        e = F.coalesce("embedding", F.array().cast(dict(df.dtypes)["embedding"]))
        known = df.where(F.col(scope).isNotNull()).select(scope, F.col(key).alias("id"), e.alias("e"), F.size(e).alias("dim"))
        blocks = known.groupBy(scope).agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
        block = known.join(F.broadcast(blocks) if is_small(blocks, QUERY_BLOCK) else blocks, scope).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        return block.groupBy(scope, "dim", "block").agg(F.collect_list(F.struct("id", "e")).alias(name)).drop("dim", "block")

    met = dealt(queries, "query_id", "queries").join(dealt(vectors, "vec_id", "vectors"), scope).select("queries", "vectors").repartition(MEETINGS)
    found = met.mapInPandas(pairs, "query_id long, vec_id long, score double").where(F.col("score") >= least)
    return top_k(found, ["query_id"], "score", "vec_id", k)


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells in which the sample's own k nearest neighbours lie with the share ``recall``, measured for up to 256 of its vectors."""
    if len(sample) < 2:
        return 1
    asked = sample[:256]
    score = asked @ sample.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, (sample @ centres.T).argmax(axis=1)[near], axis=1)
    return int(np.quantile(needed, recall, method="higher")) + 1


def ann_join(queries: DataFrame, vectors: DataFrame, k: int, nlist: int | None = None, nprobe: int | None = None, recall: float = 0.95, seed: int = 3) -> DataFrame:
    """C-6: inverted-file search: k-means cells, each question looks into its ``nprobe`` nearest cells, exact scores there.

    ``nlist`` defaults to the square root of the count, MAX_CELLS at most; ``nprobe`` to what the share ``recall`` of true neighbours
    needs, measured by brute force within a sample of about MAX_MEASURED vectors at most: few cells where vectors cluster, many
    where they do not. The cells are fitted on about MAX_FIT vectors at most; both samples go by a hash of the id; every vector is indexed. Cells are dealt
    into blocks of about VECTOR_BLOCK vectors, a question meets the blocks of its cells in matrix products, and only scores in probed cells count. Vectors of zeros are in no cell.
    """
    norm = lambda c: F.transform(c, lambda v: v / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    units = vectors.where(F.exists("embedding", lambda v: v != 0)).select("vec_id", norm(F.col("embedding")).alias("unit"))
    n = units.count()
    nlist = nlist or min(MAX_CELLS, max(1, round(n**0.5)))
    sampled = lambda most: units.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < round(1_000_000 * min(1.0, most / max(n, 1))))
    model = KMeans(k=nlist, seed=seed, maxIter=15, featuresCol="features").fit(sampled(MAX_FIT).select(array_to_vector("unit").alias("features")))
    centres = _unit(np.array(model.clusterCenters()))
    if nprobe is None:
        rows = sampled(MAX_MEASURED).orderBy(F.xxhash64("vec_id", F.lit(seed))).toPandas()
        nprobe = _probes(np.array(rows["unit"].tolist(), np.float64), centres, k, recall)

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        score = np.array(v.tolist(), np.float64) @ centres.T
        return pd.Series(np.argsort(-score, axis=1, kind="stable")[:, :nprobe].astype(np.int32).tolist())

    nq, nv = _blocks(queries, QUERY_BLOCK * 8), _blocks(units, VECTOR_BLOCK)
    in_block = lambda c: F.pmod(c, F.lit(nv))
    stored = units.select("vec_id", F.col("unit").alias("embedding"), F.get(cells("unit"), F.lit(0)).alias("cell")).select("*", in_block(F.col("cell")).alias("vb"), _numbers(nq).alias("qb"))
    asked = queries.select("query_id", norm(F.col("embedding")).alias("embedding"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qb"))
    asked = asked.withColumn("vb", F.explode(F.array_distinct(F.transform(cells("embedding"), in_block))))
    return top_k(_met(asked, stored, _best_pairs(k, False, centres, nprobe)), ["query_id"], "score", "vec_id", k)


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """L-1: an offline embedder: signed hashed word counts, unit length. Swap in a model behind the same Column function."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed
