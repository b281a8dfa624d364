"""Lexical scoring (F-11, F-12), fixed chunks (G-1) and retrieval measures (H-14, H-15)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window, functions as F

from evidencelake.functions.text import stable_chunk_id
from evidencelake.operators.ranking import top_k
from evidencelake.scratch import is_small

SPARSE_TOKEN = "([a-z0-9_\\-]+|[\u4e00-\u9fff]+)"
WORD_TOKEN = r"([\p{L}\p{N}_]+)"
PLAIN_WORD = r"^[a-z]{3,}$"
MAX_BROADCAST_TERMS = 1_000_000
#: Questions whose distinct terms are at most this many go to every task of a one-pass search.
MAX_ONE_PASS_TERMS = 500_000
#: Chunks of a task after which the questions' postings are put in order for the floors reached, for the first time and between two times at most.
FIRST_ORDER, MOST_ORDER = 64, 8192
#: A floor below every score, and how many postings may be added up in the time that reading one in part takes.
TINY, WORTH = 1e-300, 8
#: Saturation, length share and average length of the sparse score (fixed values).
K1, B, AVGDL = 1.2, 0.75, 200.0


def chunk_fixed(docs: DataFrame, size: int = 1400, overlap: int = 200) -> DataFrame:
    """G-1: character windows ``doc_id, chunk_id, start, content``; trimmed, empty ones dropped.

    Windows begin every ``size - overlap`` characters, while more than the overlap is left.
    """
    step = size - overlap
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))
    cut = docs.where("text is not null").select("doc_id", "text", F.explode(starts).alias("start"))
    out = cut.select("doc_id", "start", F.trim(F.col("text").substr(F.col("start") + 1, F.lit(size))).alias("content")).where("content <> ''")
    return out.select("doc_id", stable_chunk_id(F.col("doc_id"), F.lit(1), F.lit(""), F.col("start"), F.col("start") + F.length("content")).alias("chunk_id"), "start", "content")


def tokens(df: DataFrame, id_col: str, text_col: str, pattern: str, keep: str | None = None) -> DataFrame:
    """``id, n_tokens, token``: one row for each token (that matches ``keep``) of a text, with the text's token count."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(pattern), 1)
    found = F.filter(found, lambda t: t.rlike(keep)) if keep else found
    return df.select(id_col, found.alias("all")).select(id_col, F.size("all").alias("n_tokens"), F.explode("all").alias("token"))


def terms(df: DataFrame, id_col: str, text_col: str, pattern: str, keep: str | None = None) -> DataFrame:
    """``id, n_tokens, token, tf``: the inverted index of some texts."""
    return tokens(df, id_col, text_col, pattern, keep).groupBy(id_col, "n_tokens", "token").agg(F.count("*").alias("tf"))


def _match(query_terms: DataFrame, chunk_tokens: DataFrame) -> DataFrame:
    """Equi join on token, after tokens that no question has are dropped and the rest counted for each chunk.

    The question side goes to all tasks only if its term count is proven small.
    """
    small = is_small(query_terms, MAX_BROADCAST_TERMS)
    hint = F.broadcast if small else lambda df: df
    asked = chunk_tokens.join(hint(query_terms.select("token").distinct()), "token", "left_semi")
    return asked.groupBy("chunk_id", "n_tokens", "token").agg(F.count("*").alias("tf")).join(hint(query_terms), "token")


def sparse_scores(queries: DataFrame, chunks: DataFrame, k1: float = K1, b: float = B, avgdl: float = AVGDL) -> DataFrame:
    """F-11: ``query_id, chunk_id, score`` of every question and chunk that share a token; score / (score + 5)."""
    q = terms(queries, "query_id", "question", SPARSE_TOKEN).select("query_id", "token", F.col("tf").alias("q_tf"))
    hits = _match(q, tokens(chunks, "chunk_id", "content", SPARSE_TOKEN))
    idf = F.log(1 + 1 / (1 + F.length("token") * 0.25)) + 1
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / avgdl)) * F.col("q_tf")
    total = hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("raw"))
    return total.select("query_id", "chunk_id", (F.col("raw") / (F.col("raw") + 5)).alias("score"))


def tfidf_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """F-12: sum over distinct question tokens of tf / length * ln 2."""
    q = terms(queries, "query_id", "question", WORD_TOKEN, PLAIN_WORD).select("query_id", "token")
    hits = _match(q, tokens(chunks, "chunk_id", "content", WORD_TOKEN, PLAIN_WORD))
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("tf") / F.col("n_tokens") * F.log(F.lit(2.0))).alias("score"))


class _Index:
    """The questions' terms as postings, and the raw score that a chunk needs to count for each question.

    A chunk adds up its terms' postings, or reads only the part of them that can matter (MaxScore), whichever last proved to be less work. ``reach`` of a
    posting: the summed weights of its question's terms up to this one, lightest first, over the question's floor. A chunk whose
    largest factor is F reaches a floor only if one of its terms has a reach of 1 / F or more: if the heaviest term that it shares has less, all that it shares
    sums up to less. Postings of a term lie in falling order of reach, so the part that matters is the beginning of each list.
    """

    def __init__(self, terms: pd.DataFrame, weight: Callable[[pd.DataFrame], pd.Series]):
        terms = terms.assign(weight=weight(terms)).sort_values(["query_id", "weight", "token"], kind="stable")
        self.ids, row = np.unique(terms["query_id"].to_numpy(), return_inverse=True)
        names, self.term = np.unique(terms["token"].to_numpy(str), return_inverse=True)
        self.number = {t: i for i, t in enumerate(names.tolist())}
        self.row, self.weight = row, terms["weight"].to_numpy(np.float64)
        self.at = np.searchsorted(row, np.arange(len(self.ids) + 1))
        total = np.cumsum(self.weight)
        self.summed = total - np.where(self.at[row] > 0, total[self.at[row] - 1], 0.0)
        self.values, self.sums, self.floor = np.zeros(len(names)), np.zeros(len(self.ids)), np.full(len(self.ids), TINY)
        self.order()

    def order(self) -> None:
        """Sorts the postings for the floors as they are; floors that rise later only leave too much in."""
        reach = self.summed / self.floor[self.row]
        order = np.lexsort((-reach, self.term))
        self.reach, self.asks, self.weighs = -reach[order], self.row[order], self.weight[order]
        self.spans = np.searchsorted(self.term[order], np.arange(len(self.values) + 1)).tolist()
        self.some = None  # to be decided by the next chunk

    def scores(self, words: list[str], factor: Callable[[int, int], float]) -> tuple[np.ndarray, np.ndarray]:
        """The questions whose floor a chunk reaches, and its raw score for each."""
        own = [(self.number[t], factor(tf, len(words))) for t, tf in Counter(words).items() if t in self.number]
        if not own:
            return np.empty(0, np.int64), np.empty(0)
        rows, scores = self._some(own) if self.some is not False else self._all(own)
        good = scores >= self.floor[rows]
        return rows[good], scores[good]

    def _all(self, own: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        for t, f in own:
            here = slice(self.spans[t], self.spans[t + 1])
            self.sums[self.asks[here]] += f * self.weighs[here]
        rows = np.flatnonzero(self.sums >= self.floor)
        scores = self.sums[rows]
        self.sums[:] = 0
        return rows, scores

    def _some(self, own: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
        least, read, every = (1e-9 - 1) / max(f for _, f in own), [], 0
        for t, _ in own:
            a, b = self.spans[t], self.spans[t + 1]
            read.append(self.asks[a : a + int(np.searchsorted(self.reach[a:b], least, "right"))])
            every += b - a
        if self.some is None:
            self.some = sum(map(len, read)) * WORTH < every
            if not self.some:
                return self._all(own)
        rows = np.unique(np.concatenate(read))
        if not len(rows):
            return rows, np.empty(0)
        terms, factors = zip(*own)
        self.values[list(terms)] = factors
        n = self.at[rows + 1] - self.at[rows]
        begins = np.cumsum(n) - n
        places = np.repeat(self.at[rows] - begins, n) + np.arange(int(n.sum()))
        out = np.add.reduceat(self.weight[places] * self.values[self.term[places]], begins)
        self.values[list(terms)] = 0
        return rows, out


def _sparse_factor(tf: int, n: int) -> float:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / AVGDL))


def _tfidf_factor(tf: int, n: int) -> float:
    return tf / n


#: Tokens, those kept, weight of a question's term, factor of a chunk's term, the final score of a sum, and the sum of a final score.
SCORERS = {
    "sparse": (SPARSE_TOKEN, None, lambda t: (np.log(1 + 1 / (1 + t["token"].str.len() * 0.25)) + 1) * t["q_tf"], _sparse_factor, lambda raw: raw / (raw + 5), lambda s: 5 * s / (1 - s)),
    "tfidf": (WORD_TOKEN, PLAIN_WORD, lambda t: pd.Series(math.log(2.0), t.index), _tfidf_factor, lambda raw: raw, lambda s: s),
}


class _Best:
    """The k best scores of each question so far in a task."""

    def __init__(self, questions: int, k: int):
        self.held, self.floor = np.zeros((questions, k)), np.zeros(questions)

    def put(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Which of the scores are among the best, ties included; they are held from now on."""
        good = (scores > 0) & (scores >= self.floor[rows])
        rows, scores = rows[good], scores[good]
        self.held[rows, self.held[rows].argmin(axis=1)] = scores
        self.floor[rows] = self.held[rows].min(axis=1)
        return np.flatnonzero(good)


def _one_pass(parts: dict[str, tuple], k: int, digits: int) -> Callable:
    """Chunks to ``branch, query_id, chunk_id, score``: of each branch and question the rows that were among the best k of the task so far.

    Postings are put in order anew as the questions' floors rise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {name: (regex.compile(token), keep and regex.compile(keep), index, factor, final, raw, _Best(len(index.ids), k)) for name, (token, keep, index, factor, final, raw) in parts.items()}
        seen, again = 0, FIRST_ORDER
        for pdf in batches:
            found: dict[str, list[tuple]] = {name: [] for name in compiled}
            for chunk, text in zip(pdf["chunk_id"], pdf["content"]):
                if seen == again:
                    again += min(seen, MOST_ORDER)
                    for _, _, index, *_ in compiled.values():
                        index.order()
                seen += 1
                for name, (token, keep, index, factor, final, raw, best) in compiled.items():
                    words = token.findall((text or "").lower())
                    rows, scores = index.scores([w for w in words if keep.match(w)] if keep else words, factor)
                    if len(rows):
                        scores = np.round(final(scores), digits)
                        kept = best.put(rows, scores)
                        if len(kept):
                            found[name].append((rows[kept], [chunk] * len(kept), scores[kept]))
                            index.floor[rows[kept]] = np.maximum(raw(best.floor[rows[kept]] - 10.0**-digits), TINY)
            for name, rows in found.items():
                if rows:
                    q, chunks, scores = zip(*rows)
                    yield pd.DataFrame({"branch": name, "query_id": compiled[name][2].ids[np.concatenate(q)], "chunk_id": [c for x in chunks for c in x], "score": np.concatenate(scores)})

    return run


def lexical_branches(queries: DataFrame, chunks: DataFrame, k: int = 18, branches: tuple[str, ...] = ("sparse", "tfidf"), digits: int = 9) -> DataFrame:
    """F-11, F-12: of each branch of SCORERS the k best chunks of each question: ``branch, query_id, chunk_id, score, rank``.

    Scores are rounded to ``digits`` places before they rank, the lower chunk id first on ties. Questions whose
    terms are few by count go to every task, and one pass over the chunks where they lie scores them for all branches: each chunk only the questions that its terms can bring
    to their k best so far. A task gives little more than k rows for each question. Otherwise terms meet in a join. Null contents and questions have no terms.
    """
    wanted, scored = {name: SCORERS[name] for name in branches}, None
    asked = {name: terms(queries, "query_id", "question", token, keep).select("query_id", "token", F.col("tf").alias("q_tf")) for name, (token, keep, *_) in wanted.items()}
    kind = f"branch string, query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(chunks.dtypes)['chunk_id']}, score double"
    if all(is_small(t, MAX_ONE_PASS_TERMS) for t in asked.values()):
        parts = {name: (token, keep, _Index(asked[name].toPandas(), weight), factor, final, raw) for name, (token, keep, weight, factor, final, raw) in wanted.items()}
        scored = chunks.select("chunk_id", "content").mapInPandas(_one_pass(parts, k, digits), kind)
    else:
        for name in wanted:
            one = (sparse_scores if name == "sparse" else tfidf_scores)(queries, chunks).select(F.lit(name).alias("branch"), "query_id", "chunk_id", F.round("score", digits).alias("score"))
            scored = one if scored is None else scored.unionByName(one)
    return top_k(scored, ["branch", "query_id"], "score", "chunk_id", k)


def lexical_top_k(queries: DataFrame, chunks: DataFrame, k: int = 18, branch: str = "sparse", digits: int = 9) -> DataFrame:
    """One branch of ``lexical_branches``: ``query_id, chunk_id, score, rank``."""
    return lexical_branches(queries, chunks, k, (branch,), digits).drop("branch")


def credited(results: DataFrame, relevant: DataFrame, item: str) -> DataFrame:
    """Results with ``hit``: relevant and not seen at a better rank."""
    marked = results.join(relevant.select("query_id", item).distinct().withColumn("rel", F.lit(1)), ["query_id", item], "left")
    n = F.row_number().over(Window.partitionBy("query_id", item).orderBy("rank"))
    return marked.withColumn("hit", F.when((F.col("rel") == 1) & (n == 1), 1).otherwise(0))


def retrieval_metrics(results: DataFrame, relevant: DataFrame, item: str = "chunk_id", ks: tuple[int, ...] = (5, 10), ndcg_k: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """H-14: recall at each k, MRR and NDCG of every question with relevant items; 0 where nothing was found.

    With ``counts(query_id, n_relevant)`` of all relevant items, ``relevant`` need only have those among the results.
    """
    gold = counts if counts is not None else relevant.select("query_id", item).distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    per = credited(results, relevant, item).groupBy("query_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"hits_{k}") for k in ks],
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= ndcg_k, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(ndcg_k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    both = gold.join(per, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("query_id", "n_relevant", *[zero(F.col(f"hits_{k}") / F.col("n_relevant")).alias(f"recall_{k}") for k in ks], zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"))
