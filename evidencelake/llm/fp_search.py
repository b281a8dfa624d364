"""Operator 13: ranked lexical search through trees of documents.

A document is restricted to the terms that the items ask for; its vector lists them rarest first. In each task the vectors of some thousand
documents form a tree in which equal beginnings are one path, and equal vectors one leaf. An item descends depth first:
the greatest tf of each term below a node and the least m below it bound the score of every document below it, and a node that cannot bring the
item over its tenth best score so far is left out with all below it. The items that go on into a node go together, so the bounds of all of
them are one array operation. A small share of the documents goes first and gives every task scores to start from; it never rules out a
document that belongs to a result. All scores and bounds are 64-bit integers and rise with tf and fall with m, so nothing is lost to rounding.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidencelake.llm.workers import tidied
from evidencelake.scratch import materialize

#: Vectors and terms of one tree.
TREE_DOCS, TREE_TERMS = 8192, 2_000_000
#: Terms of items (each with its item) that go to every task at once; more items go round by round.
MAX_ITEM_TERMS = 1_000_000
#: One document in so many goes first, for scores to start from.
FIRST_SHARE = 64
#: Bytes of terms as they are, A to Z lowered, all others as spaces (ASCII digits and letters, and all of other scripts).
TERMS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(TERMS).split() if text else []


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term, times``; rows of one item add up, exact repeats of a row count once."""

    @F.arrow_udf("array<struct<term: string, times: int>>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [[{"term": t.decode("utf-8"), "times": n} for t, n in Counter(terms_of(x)).items()] for x in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("term", pa.string()), ("times", pa.int32())])))

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null").distinct()
    each = rows.select("item_id", F.explode(run("text")).alias("t"))
    return each.groupBy("item_id", "t.term").agg(F.sum("t.times").alias("times"))


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of the documents with a term: all their terms counted, those of the vocabulary listed by number."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            ids, n, terms, tfs, at = [], [], [], [], [0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if words := terms_of(text):
                    found = [(number[w], tf) for w, tf in Counter(words).items() if w in number]
                    ids.append(doc)
                    n.append(len(words))
                    terms += [t for t, _ in found]
                    tfs += [tf for _, tf in found]
                    at.append(len(terms))
            offsets = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidied(run), "doc_id long, n long, terms array<int>, tfs array<int>")


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """Vectors by path: ``order`` leaves in the order of their paths, ``shared[i]`` the length of the path that leaf i shares with the one before."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], k: int):
        keys = sorted((t.astype(">u4").tobytes(), int(m[i]), f.tobytes(), int(ids[i]), i) for i, (t, f) in enumerate(zip(terms, tfs)))
        self.ids: list[list[int]] = []
        picked, self.shared = [], [0]
        for _, group in itertools.groupby(keys, key=lambda x: x[:3]):  # equal vectors have equal scores: the lowest ids come first
            some = list(itertools.islice(group, k))
            self.ids.append([x[3] for x in some])
            picked.append(some[0][4])
        self.m = m[picked]
        sizes = np.array([len(terms[i]) for i in picked], np.int64)
        self.at = np.concatenate(([0], np.cumsum(sizes)))
        self.terms, self.tfs = (np.concatenate([x[i] for i in picked]) for x in (terms, tfs))
        for i in range(1, len(picked)):
            a, b = terms[picked[i - 1]], terms[picked[i]]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            self.shared.append(int(differ.argmax()) if differ.any() else n)
        self.shared = np.array(self.shared)

    def __len__(self) -> int:
        return len(self.ids)

    def below(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The terms of the leaves from ``lo`` to ``hi``, the greatest tf of each, and the least m."""
        if hi - lo == 1:
            return self.terms[self.at[lo] : self.at[hi]], self.tfs[self.at[lo] : self.at[hi]], self.m[lo]
        codes = np.sort(self.terms[self.at[lo] : self.at[hi]].astype(np.int64) << 32 | self.tfs[self.at[lo] : self.at[hi]])
        last = codes[np.append(codes[1:] >> 32 != codes[:-1] >> 32, True)]
        return last >> 32, last & 0xFFFFFFFF, self.m[lo:hi].min()

    def children(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The ranges of leaves below the node that is the longest path shared by all of ``lo`` to ``hi``."""
        inside = self.shared[lo + 1 : hi]
        cuts = [lo, *(np.flatnonzero(inside == inside.min()) + lo + 1).tolist(), hi]
        return list(itertools.pairwise(cuts))


class Ranking:
    """The best ``k`` documents of each item among those seen, and branch-and-bound over trees."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, floors: list[tuple[int, int]], k: int):
        self.spans = [np.arange(a, b) for a, b in itertools.pairwise(at.tolist())]
        self.terms, self.weights, self.k = terms, weights, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.spans]
        #: The score and minus the id that a document has to reach.
        self.floors, self.floor = floors, np.array([f[0] for f in floors], np.int64)
        self.values = np.zeros(n_terms, np.int64)

    def scores(self, items: list[int], terms: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores of a document, or bounds if the numbers are the extremes of several, for the given items."""
        self.values[terms] = saturation(tfs, m)
        places = np.concatenate([self.spans[i] for i in items])
        parts = self.weights[places] * self.values[self.terms[places]]
        self.values[terms] = 0
        ends = np.cumsum([len(self.spans[i]) for i in items])
        return np.add.reduceat(parts, np.concatenate(([0], ends[:-1])))

    def search(self, tree: Tree) -> None:
        todo = [(0, len(tree), list(range(len(self.spans))))]
        while todo:
            lo, hi, items = todo.pop()
            found = self.scores(items, *tree.below(lo, hi))
            alive = np.flatnonzero((found > 0) & (found >= self.floor[items])).tolist()
            if not alive:
                continue
            if hi - lo == 1:
                for j in alive:
                    self._put(items[j], int(found[j]), tree.ids[lo])
            else:
                items = [items[j] for j in alive]
                todo += [(a, b, items) for a, b in reversed(tree.children(lo, hi))]

    def _put(self, item: int, score: int, ids: list[int]) -> None:
        best = self.best[item]
        for doc in ids:
            new = (score, -doc)
            if new < self.floors[item]:
                break  # the ids rise
            if len(best) < self.k:
                heapq.heappush(best, new)
            elif new > best[0]:
                heapq.heapreplace(best, new)
            else:
                break
        if len(best) == self.k:
            self.floors[item] = max(self.floors[item], best[0])
            self.floor[item] = self.floors[item][0]


def _search(items: dict, k: int) -> Callable:
    """Vectors to ``item, doc_id, score``: of each item the best of the task. ``items``: a broadcast of its arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = items.value
        ranking = Ranking(it["at"], it["terms"], it["weights"], len(it["rank"]), list(it["floors"]), k)
        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = batch.column(2).offsets.to_numpy()
            terms, tfs = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            at = at - at[0]
            m = lengths(n, it["N"], it["L"])
            lo = 0
            while lo < len(ids):
                hi = min(len(ids), lo + TREE_DOCS, max(lo + 1, int(np.searchsorted(at, at[lo] + TREE_TERMS, "right")) - 1))
                paths, counts = [], []
                for i in range(lo, hi):
                    rank = it["rank"][terms[at[i] : at[i + 1]]]
                    order = np.argsort(rank)
                    paths.append(rank[order])
                    counts.append(tfs[at[i] : at[i + 1]][order].astype(np.int64))
                ranking.search(Tree(ids[lo:hi], m[lo:hi], paths, counts, k))
                lo = hi
        rows = [(i, -minus, score) for i, best in enumerate(ranking.best) for score, minus in best]
        for a in range(0, len(rows), 100_000):
            item, doc, score = zip(*rows[a : a + 100_000])
            yield pa.record_batch([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of documents with ``n`` terms; beyond 64 bits by whole numbers of any size."""
    if 75 * int(n.max(initial=0)) * documents < 1 << 63:
        return 25 + 75 * n * documents // terms
    return np.array([25 + 75 * x * documents // terms for x in n.tolist()], np.int64)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _round(docs: DataFrame, wanted: DataFrame, id_type: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """The result for items whose terms are few enough for every task."""
    spark = docs.sparkSession
    table = wanted.orderBy("item_id", "term").toArrow()
    names = table.column("term").combine_chunks().dictionary_encode()
    vocabulary = {t.encode("utf-8"): i for i, t in enumerate(names.dictionary.to_pylist())}
    ids = table.column("item_id").combine_chunks().dictionary_encode()
    items, terms = ids.indices.to_numpy(), names.indices.to_numpy()
    at = np.searchsorted(items, np.arange(len(ids.dictionary) + 1))

    rows = materialize(vectors(docs, vocabulary, id_col, text_col), "term-vectors")
    total = rows.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    in_docs = np.zeros(len(vocabulary), np.int64)
    for t, df in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the items
        in_docs[t] = df
    weight = np.array([math.floor(1000 * math.log((2 * total.N + 2) / (2 * df + 1))) for df in in_docs.tolist()], np.int64)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((np.arange(len(vocabulary)), in_docs))] = np.arange(len(vocabulary))
    sent = {"at": at, "terms": rank[terms], "weights": weight[terms] * table.column("times").to_numpy(), "rank": rank, "N": total.N, "L": total.L or 1}

    floors = [(1, -(1 << 63))] * len(ids.dictionary)
    ranked = rows.where("doc_id is not null and size(terms) > 0")
    search = lambda df: df.mapInArrow(tidied(_search(spark.sparkContext.broadcast({**sent, "floors": floors}), k)), "item int, doc_id long, score long")
    first = _best(search(ranked.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_SHARE)) == 0)), k).where(F.col("rank") == k)
    for r in first.collect():  # one row an item
        floors[r.item] = (r.score, -r.doc_id)
    named = spark.createDataFrame(list(enumerate(ids.dictionary.to_pylist())), f"item int, item_id {id_type}")
    return _best(search(ranked), k).join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_items(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``; equal scores by ascending id.

    A null or empty text has no terms: such items give no rows, such documents do not count in any statistic. Documents with a null
    id count in the statistics but are not ranked; each of repeated rows is a document. Items with a null id are left out, and texts of
    one item add up. Other columns are not read; empty tables give no rows. More than MAX_ITEM_TERMS terms of items are searched in
    rounds over the documents, dealt by item.
    """
    id_type = dict(items.dtypes)[item_id]
    wanted = materialize(item_terms(items, item_id, item_text), "item-terms")
    rounds = math.ceil(wanted.count() / MAX_ITEM_TERMS)
    out = docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for r in range(rounds):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r)
        if not mine.isEmpty():
            found = _round(docs, mine, id_type, k, id_col, text_col)
            out = found if rounds == 1 else out.unionByName(found)
    return out


def op13_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents for each benchmark item."""
    return search_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS nd, sum(len(t))::BIGINT AS nt FROM d WHERE len(t) > 0),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
sc AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT AS score
  FROM tf JOIN i USING (term) JOIN w USING (term), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
