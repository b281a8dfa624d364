"""Operator 12: language-model scores from a log-frequency Bloom filter.

The model is of pairs of tokens (a token and the one before it), smoothed towards single tokens in the manner of a Dirichlet
prior: ``P(w | h) = (c(h, w) + KAPPA * P(w)) / (c(h) + KAPPA)`` and ``P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))``. The end token of a text also stands before
its first token, so each token's count is also that of what follows it.

Counts are not stored. A gram that occurs n times is quantised to level 1 for n = 1 and one more for each whole number that rounding up a power of
BASE gives up to n (2, 3, 4, ... at first, then steps that grow as n does), and put into a Bloom filter once for each level up to its own. A count is read by asking for level 1, 2, ... until the filter says no; the level found stands for the mean count of all grams
of that level in the corpus, so the counts decoded add up to those that were put in. A pair counts no more than its parts.

The filter has shards by gram, each made by one task from one shuffle of (gram, count), so it grows with the corpus. While all shards fit in
a broadcast of proven size they go to the workers; beyond that the texts are read again for each part of the shards of pairs that does, beside those of single tokens, and a text's sums are added up.
Only where that would take too many rounds the grams of the texts travel to the shards.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidencelake.llm.workers import small_texts, tidied, tidy
from evidencelake.scratch import join_per_key, materialize, new_path

BASE, KAPPA = 1.2, 1000.0
#: An entry sets up to HASHES bits of one 64-bit word, and there are BITS_EACH bits for each entry: one look decides, and a gram that is not there passes about 6 times in 1000.
HASHES, BITS_EACH = 6, 14
#: Bytes of text for a shard: SMALL_SHARD up to SHARDS shards, then as many shards as LARGE_SHARD asks for.
SMALL_SHARD, SHARDS, LARGE_SHARD = 4 << 20, 1024, 256 << 20
#: The filter is broadcast up to this size, and so are exact counts of this many words (16 bytes each).
MAX_FILTER_BYTES, MAX_HEAD_WORDS = 256 << 20, 4_000_000
#: Rounds over the texts up to which a larger filter is broadcast part by part.
MOST_ROUNDS = 16
#: Tokens counted before a task hands out what it has, and tokens cut at once.
COUNT_AT_ONCE, CUT_AT_ONCE = 3_000_000, 250_000
SALT, BATCH = 16, 1 << 18
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Least count of each level from 2 on, for all counts of 63 bits.
FLOORS = np.array(sorted({math.ceil(BASE**j) for j in range(1, int(62 * math.log(2) / math.log(BASE)))}), np.int64)
LEVELS = len(FLOORS) + 1
END = np.uint64(0x9E3779B97F4A7C15)
KINDS = "kind string, shard int, gram long, n long, grams long, bits binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that changes half of the bits for each bit changed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def single(tokens: np.ndarray) -> np.ndarray:
    """The grams of single tokens: even."""
    return mix(tokens) << np.uint64(1)


def pair(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The grams of tokens after others: odd."""
    return mix(mix(before) * np.uint64(3) + tokens) << np.uint64(1) | np.uint64(1)


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, one after another, and how many each text has: its words, A to Z lowered, and the end."""
    cut = [t.encode("utf-8").translate(LOWER).split() if t else [] for t in texts]
    every = list(itertools.chain.from_iterable(cut))
    kinds = set(every)
    codes = dict(zip(kinds, map(xxhash.xxh64_intdigest, kinds)))
    n = np.array([len(c) + 1 for c in cut], np.int64)
    ends = np.cumsum(n) - 1
    flat = np.full(int(n.sum()), END, np.uint64)
    words = np.ones(len(flat), bool)
    words[ends] = False
    flat[words] = np.fromiter(map(codes.__getitem__, every), np.uint64, len(every))
    return flat, n


def before(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each; the end before a text's first."""
    out = np.roll(flat, 1)
    out[np.cumsum(n) - n] = END
    return out


def level_of(n: np.ndarray) -> np.ndarray:
    """The level of counts of 1 or more."""
    return 1 + np.searchsorted(FLOORS, n, "right")


def single_shards(shards: int) -> int:
    """The first of the shards hold single tokens, the others pairs; one shard holds both."""
    return max(1, shards // 6)


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    ones = single_shards(shards)
    at, pairs = grams >> np.uint64(20), grams & np.uint64(1) == 1
    return np.where(pairs & (shards > 1), np.uint64(ones) + at % np.uint64(max(1, shards - ones)), at % np.uint64(ones))


def entries(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits that each gram sets at a level, and 32 bits that choose the word."""
    h = mix(grams ^ np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    mask = np.uint64(1) << (h & np.uint64(63))
    for i in range(1, HASHES):
        mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return mask, mix(h) >> np.uint64(32)


class Filter:
    """Words of one or more shards, one after another, for probes; ``offsets`` are their first words and the end of the last."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray):
        self.words, self.start, self.size = words, offsets[:-1].astype(np.uint64), np.diff(offsets).astype(np.uint64)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each gram, 0 where the filter does not hold it."""
        found = np.zeros(len(grams), np.int64)
        if not len(self.words):
            return found
        shard = shard_of(grams, len(self.size)).astype(np.int64)
        start, size = self.start[shard], self.size[shard]
        live = np.flatnonzero(size)
        for level in range(1, LEVELS + 1):
            mask, word = entries(grams[live], level)
            there = self.words[start[live] + (word * size[live] >> np.uint64(32))] & mask == mask
            live = live[there]
            if not len(live):
                break
            found[live] = level
        return found


def fill(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The words of a shard that holds grams with their counts."""
    level = level_of(n)
    words = np.zeros(max(1, math.ceil(int(level.sum()) * BITS_EACH / 64)), np.uint64)
    live = np.arange(len(grams))
    for at in range(1, int(level.max(initial=0)) + 1):
        live = live[level[live] >= at]
        mask, word = entries(grams[live], at)
        np.bitwise_or.at(words, word * np.uint64(len(words)) >> np.uint64(32), mask)
    return words


def summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams and their counts added up."""
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    begins = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.empty(0, np.int64)
    return grams[begins], np.add.reduceat(n, begins) if len(begins) else n


def _count(shards: int) -> Callable:
    """Texts to ``shard, gram, n``: the grams of some millions of tokens at a time, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for a in range(0, len(grams), BATCH):
                g = grams[a : a + BATCH]
                yield pa.record_batch([pa.array(shard_of(g, shards).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(n[a : a + BATCH])], names=["shard", "gram", "n"])

        for batch in batches:
            for texts in _slices(batch.column(0).to_pylist(), CUT_AT_ONCE):
                flat, n = tokens_of(texts)
                held += [single(flat), pair(before(flat, n), flat)]
                size += len(flat)
                if size >= COUNT_AT_ONCE:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _slices(texts: list[str | None], tokens: int) -> Iterator[list[str | None]]:
    """Texts in pieces of about so many tokens (8 bytes each); a longer text stands alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > 8 * tokens:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "") + 8
    if held:
        yield held


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shard, gram, n`` of whole shards to KINDS: the shard's bits, the words' exact counts, and for each kind of gram and level its grams and their counts."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    pending: dict[int, int] = {}
    for batch in batches:
        shard, grams, n = (batch.column(i).to_numpy() for i in range(3))
        for s in np.unique(shard).tolist():
            mine = shard == s
            held.setdefault(s, []).append((grams[mine], n[mine]))
            pending[s] = pending.get(s, 0) + int(mine.sum())
            if pending[s] > COUNT_AT_ONCE:  # adds up what has come so far
                held[s], pending[s] = [summed(*(np.concatenate(x) for x in zip(*held[s])))], 0
    for s, parts in held.items():
        keys, n = summed(*(np.concatenate(x) for x in zip(*parts)))
        level, is_pair = level_of(n), keys & 1
        rows = [{"kind": "bits", "shard": s, "bits": fill(keys.view(np.uint64), n).tobytes()}]
        for kind, at in np.unique(np.stack([is_pair, level]), axis=1).T.tolist():
            these = (is_pair == kind) & (level == at)
            rows.append({"kind": "level", "shard": s, "gram": kind * 1024 + at, "n": int(n[these].sum()), "grams": int(these.sum())})
        yield pa.RecordBatch.from_pylist(rows, KINDS_ARROW)
        words, counts = keys[is_pair == 0], n[is_pair == 0]
        for a in range(0, len(words), BATCH):
            w, m = words[a : a + BATCH], len(words[a : a + BATCH])
            yield pa.record_batch([pa.array(["word"] * m), pa.array([s] * m, pa.int32()), pa.array(w), pa.array(counts[a : a + BATCH]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], schema=KINDS_ARROW)


KINDS_ARROW = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("gram", pa.int64()), ("n", pa.int64()), ("grams", pa.int64()), ("bits", pa.binary())])


@dataclass
class Model:
    """A filter in the shared folder and the few numbers that decode it."""

    uri: str
    parts: DataFrame  # KINDS
    shards: int
    filter_bytes: int
    tokens: int  # N
    kinds: int  # V
    means: tuple[np.ndarray, np.ndarray]  # mean count of each level, of single tokens and of pairs; 0 for level 0

    @property
    def words(self) -> DataFrame:
        """``gram, n``: the exact count of each distinct token."""
        return self.parts.where("kind = 'word'").select("gram", "n")


def train(texts: DataFrame, text_col: str = "text") -> Model:
    """The model of all rows of ``texts``, whole. A null text counts as an empty one (one end token); repeated rows count each time."""
    spark, texts = texts.sparkSession, texts.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(max(min(SHARDS, size / SMALL_SHARD), size / LARGE_SHARD)))
    counted = texts.mapInArrow(tidied(_count(shards)), "shard int, gram long, n long")
    uri = new_path(spark, "bloom-lm")
    with small_texts(spark):
        counted.repartitionById(shards, "shard").mapInArrow(tidied(_build), KINDS).write.partitionBy("kind", "shard").parquet(uri)
    parts = spark.read.schema(KINDS).parquet(uri)
    levels = parts.where("kind = 'level'").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("grams").alias("grams")).collect()  # one row a level
    means = (np.zeros(LEVELS + 1), np.zeros(LEVELS + 1))
    for r in levels:
        means[r.gram // 1024][r.gram % 1024] = r.n / r.grams
    ones = [r for r in levels if r.gram < 1024]
    total = parts.where("kind = 'bits'").agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    return Model(uri, parts, shards, total, sum(r.n for r in ones), sum(r.grams for r in ones), means)


def _read(uri: str, kind: str, columns: list[str], shard: int | None = None) -> Iterator[tuple[int, pa.Table]]:
    """The files of one kind of part, or of one shard's, from the shared folder: shard and table, one after another."""
    files, root = fs.FileSystem.from_uri(uri)
    folder = f"{root}/kind={kind}" + (f"/shard={shard}" if shard is not None else "")
    for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
        if f.base_name.endswith(".parquet"):
            with files.open_input_file(f.path) as source:
                yield int(f.path.rpartition("/shard=")[2].partition("/")[0]), pq.read_table(source, columns=columns)


def _shard_bytes(model: Model) -> list[int]:
    sizes = dict(model.parts.where("kind = 'bits'").select("shard", F.octet_length("bits")).collect())  # one row a shard
    return [sizes.get(s, 0) for s in range(model.shards)]


def _whole_filter(model: Model, sizes: list[int] | None = None, span: tuple[int, int] | None = None) -> Filter:
    """All shards, or those of single tokens and the ``span`` of others, read one by one into one array; the caller has checked their size."""
    ones = single_shards(model.shards)
    held = [span is None or s < ones or span[0] <= s < span[1] for s in range(model.shards)]
    offsets = np.concatenate(([0], np.cumsum([n // 8 if h else 0 for n, h in zip(sizes or _shard_bytes(model), held)]))).astype(np.int64)
    words = np.empty(offsets[-1], np.uint64)
    for shard, table in _read(model.uri, "bits", ["bits"]) if span is None else itertools.chain.from_iterable(_read(model.uri, "bits", ["bits"], s) for s in np.flatnonzero(held).tolist()):
        words[offsets[shard] : offsets[shard + 1]] = np.frombuffer(table.column("bits")[0].as_buffer(), np.uint64)
    return Filter(words, offsets)


def _spans(sizes: list[int]) -> list[tuple[int, int]]:
    """The shards of pairs in runs that fit MAX_FILTER_BYTES together with those of single tokens; none if one does not, or if they are too many."""
    ones = single_shards(len(sizes))
    room, out = MAX_FILTER_BYTES - sum(sizes[:ones]), []
    at = ones
    while at < len(sizes) and len(out) <= MOST_ROUNDS:
        end = at + int(np.searchsorted(np.cumsum(sizes[at:]), room, "right"))
        if end == at:
            return []
        out.append((at, end))
        at = end
    return out if len(out) <= MOST_ROUNDS else []


def _head(model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """Exact counts of the words that occur most, sorted by gram, and L: these are all words of 2 ** L times or more (all words if it is 0)."""
    sizes = {r["at"]: r["count"] for r in model.words.groupBy((F.length(F.bin("n")) - 1).alias("at")).count().collect()}  # up to 63 rows
    least, held = 63, 0
    while least and held + sizes.get(least - 1, 0) <= MAX_HEAD_WORDS:
        least -= 1
        held += sizes.get(least, 0)
    grams, counts = np.empty(held, np.int64), np.empty(held, np.int64)
    at = 0
    for _, table in _read(model.uri, "word", ["gram", "n"]) if held else ():
        n = table.column("n").to_numpy()
        often = n >= 1 << least
        grams[at : at + often.sum()], counts[at : at + often.sum()] = table.column("gram").to_numpy()[often], n[often]
        at += int(often.sum())
    order = np.argsort(grams)
    return grams[order], counts[order], least


FIELDS = {
    "n_tokens": "long", "n_known": "long", "base": "double", "score": "double",
    "rare": "array<struct<gram: bigint, times: int>>", "pairs": "array<struct<w: bigint, h: bigint, p: bigint, times: int>>",
}


class _Scorer:
    """Scores of texts from what was broadcast; ``rare`` and ``pairs`` hold what has to be looked up elsewhere."""

    def __init__(self, head: tuple[np.ndarray, np.ndarray], exact: bool, known: Filter | None, tokens: int, kinds: int, means: tuple[np.ndarray, np.ndarray], span: tuple[int, int] | None = None):
        self.head, self.exact, self.known, self.means, self.tokens, self.span = head, exact, known, means, tokens, span
        self.all = tokens + 0.5 * (kinds + 1)

    def __call__(self, texts: list[str | None]) -> pa.StructArray:
        flat, n = tokens_of(texts)
        starts, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        grams, of = np.unique(single(flat).view(np.int64), return_inverse=True)
        at = np.searchsorted(self.head[0], grams)
        at[at == len(self.head[0])] = 0
        counts = np.where(self.head[0][at] == grams, self.head[1][at], 0) if len(self.head[0]) else np.zeros(len(grams), np.int64)
        known = counts > 0
        part = np.where(known | self.exact, np.log10((counts + 0.5) / self.all), 0.0)
        rare = _lists([grams[of]], ~known[of] & (not self.exact), doc, len(n), ["gram"])
        prior = before(flat, n)
        score, pairs = np.zeros(len(n)), [x.view(np.int64) for x in (single(flat), single(prior), pair(prior, flat))]
        if self.known is not None and len(n):
            score = np.add.reduceat(self._pairs(pairs[2].view(np.uint64), grams.view(np.uint64), of, starts), starts)
        pairs = _lists(pairs, np.full(len(flat), self.known is None), doc, len(n), ["w", "h", "p"])
        sums = [np.add.reduceat(x, starts) if len(n) else np.empty(0) for x in (known[of].astype(np.int64), part[of])]
        columns = [pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(score), rare, pairs]
        return pa.StructArray.from_arrays(columns, list(FIELDS))

    def partial(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the sum over the tokens whose pairs belong to the span."""
        flat, n = tokens_of(texts)
        if not len(n):
            return np.empty(0)
        grams, of = np.unique(flat, return_inverse=True)
        starts = np.cumsum(n) - n
        return np.add.reduceat(self._pairs(pair(before(flat, n), flat), single(grams), of, starts), starts)

    def _pairs(self, pairs: np.ndarray, grams: np.ndarray, of: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 P of each token after the one before it, by probes, 0 where the pair lies outside the span; ``grams[of]`` are the single tokens."""
        one = self.means[0][self.known.levels(grams)]
        word, prior = one[of], np.roll(one[of], 1)
        prior[starts] = word[-1]  # the end, with which every text closes
        mine = slice(None)
        if self.span is not None:
            shard = shard_of(pairs, len(self.known.size))
            mine = np.flatnonzero((shard >= self.span[0]) & (shard < self.span[1]))
            pairs, word, prior = pairs[mine], word[mine], prior[mine]
        most = np.minimum(word, prior)
        both, ask = np.zeros(len(pairs)), np.flatnonzero(most)
        both[ask] = np.minimum(self.means[1][self.known.levels(pairs[ask])], most[ask])
        out = np.zeros(len(of))
        out[mine] = log_p(both, word, prior, self.all, np.log10)
        return out


def log_p(both, word, prior, everything, log10):
    """log10 of the smoothed probability, of numbers or Columns: counts of the pair, the token and the one before."""
    return log10((both + (word + 0.5) * (KAPPA / everything)) / (prior + KAPPA))


def _lists(columns: list[np.ndarray], which: np.ndarray, doc: np.ndarray, n: int, names: list[str]) -> pa.ListArray:
    """For each text the distinct values of the last column where ``which``, with those of the others, and how often each occurs."""
    at = np.flatnonzero(which)
    order = at[np.lexsort((columns[-1][at], doc[at]))]
    key, own = columns[-1][order], doc[order]
    begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))) if len(order) else np.empty(0, np.int64)
    times = np.diff(np.append(begins, len(order))).astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(c[order[begins]]) for c in columns] + [pa.array(times)], [*names, "times"])
    offsets = np.concatenate(([0], np.cumsum(np.bincount(own[begins], minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), structs)


def _probe(model: Model, rows: DataFrame, gram: str, level: str) -> DataFrame:
    """``rows`` with the level of a gram, found where its shard is: rows travel by shard, spread over SALT tasks each, and a task reads one shard at a time."""
    uri, shards = model.uri, model.shards
    ones, at = single_shards(shards), F.shiftrightunsigned(gram, 20)
    others = F.pmod(at, F.lit(max(1, shards - ones))) + ones
    shard = F.when((F.col(gram).bitwiseAND(F.lit(1)) == 1) & F.lit(shards > 1), others).otherwise(F.pmod(at, F.lit(ones)))
    placed = rows.withColumn("__shard", shard.cast("int"))
    placed = placed.repartition("__shard", F.pmod(F.xxhash64(gram), F.lit(SALT))).sortWithinPartitions("__shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one = -1, None
        for batch in batches:
            names = batch.schema.names
            grams, shard = batch.column(names.index(gram)).to_numpy().view(np.uint64), batch.column(names.index("__shard")).to_numpy()
            found = np.zeros(len(grams), np.int64)
            for s in np.unique(shard).tolist():
                if s != at:
                    bits = b"".join(table.column("bits")[0].as_py() for _, table in _read(uri, "bits", ["bits"], s))
                    at, one = s, Filter(np.frombuffer(bits, np.uint64), np.array([0, len(bits) // 8]))
                mine = shard == s
                found[mine] = one.levels(grams[mine])
            yield pa.record_batch([*batch.columns[:-1], pa.array(found.astype(np.int32))], names=[*names[:-1], level])

    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    return placed.mapInArrow(tidied(run), f"{kinds}, {level} int")


def _partial(texts: DataFrame, model: Model, sizes: list[int], span: tuple[int, int]) -> DataFrame:
    """``__text, part``: of each different text, by its hash, the sum over the pairs in a span of shards, written once."""
    spark = texts.sparkSession
    nothing = np.empty(0, np.int64)
    sent = spark.sparkContext.broadcast(_Scorer((nothing, nothing), False, _whole_filter(model, sizes, span), model.tokens, model.kinds, model.means, span))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = sent.value
        with tidy():
            for batch in batches:
                yield pa.array(np.concatenate([np.empty(0), *[scorer.partial(t) for t in _slices(batch.to_pylist(), CUT_AT_ONCE)]]))

    with small_texts(spark):
        out = materialize(texts.select(F.xxhash64("text").alias("__text"), run("text").alias("part")).groupBy("__text").agg(F.first("part").alias("part")), "bloom-part")
    sent.destroy()
    return out


def _decoded(level: str, means: np.ndarray) -> Column:
    return F.get(F.array(*[F.lit(float(m)) for m in means]), F.col(level))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens, n_known`` (tokens that were trained on)``, train_tokens, base_score`` and ``score`` added.

    ``base_score`` has exact counts and no context; ``score`` is the model's log10 probability. A null or empty text has one token, its end. One
    row out for each row in, written once to the shared folder, repeated rows and null ids as well; columns of these names are replaced; untrained, every token is unknown. Exact counts of the most
    frequent words are broadcast, up to MAX_HEAD_WORDS; rarer words are joined. The rows are written once to the shared folder, without the text if ``keep_text`` is false. Words are told apart by 64-bit hashes.
    """
    grams, counts, least = _head(model)
    large = model.filter_bytes > MAX_FILTER_BYTES
    sizes = _shard_bytes(model) if large else []
    spans = _spans(sizes) if large else []
    by_shard = large and not spans
    known = None if by_shard else _whole_filter(model, sizes, spans[0]) if large else _whole_filter(model)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_Scorer((grams, counts), least == 0, known, model.tokens, model.kinds, model.means, spans[0] if spans else None))

    @F.arrow_udf(", ".join(f"{n} {kind}" for n, kind in FIELDS.items()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = sent.value
        with tidy():
            for batch in batches:
                parts = [scorer(texts) for texts in _slices(batch.to_pylist(), CUT_AT_ONCE)]
                yield pa.concat_arrays(parts) if parts else scorer([])

    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in new and (keep_text or c != text_col)]
    key = [F.xxhash64(text_col).alias("__text")] if spans else []
    made = docs.select(*rest, *key, run.asNondeterministic()(F.col(text_col)).alias("__s")).select(*rest, *["__text"] * len(key), *[F.col(f"__s.{n}").alias(f"__{n}") for n in FIELDS])
    everything = model.tokens + 0.5 * (model.kinds + 1)
    rare, pairs = F.struct(F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base")), F.lit(0.0)
    with small_texts(spark):
        made = materialize(made.withColumn("__row", F.monotonically_increasing_id()), "bloom-scores")
    sent.destroy()  # the scores are written, so executors need not keep the filter
    del known
    if len(spans) > 1:  # a text's sum over the pairs of each further part of the filter
        parts = [_partial(docs.select(F.col(text_col).alias("text")), model, sizes, span) for span in spans[1:]]
        sums = functools.reduce(DataFrame.unionByName, parts).groupBy("__text").agg(F.sum("part").alias("__rest"))
        made = join_per_key(made, sums, "__text")
        pairs = F.coalesce("__rest", pairs)
    if least:
        words = model.words.where(F.col("n") < (1 << least))
        each = join_per_key(made.select("__row", F.explode("__rare").alias("r")).select("__row", "r.gram", "r.times"), words, "gram")
        n = F.coalesce(F.col("n"), F.lit(0))
        sums = each.groupBy("__row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10((n + 0.5) / everything)).alias("base"))
        made = made.join(sums.select("__row", F.struct("known", "base").alias("__found")), "__row", "left")
        rare = F.coalesce("__found", rare)
    if by_shard:
        each = made.select("__row", F.explode("__pairs").alias("r")).select("__row", "r.w", "r.h", "r.p", "r.times")
        for gram, level in (("w", "lw"), ("h", "lh"), ("p", "lp")):
            each = _probe(model, each, gram, level)
        word, prior = _decoded("lw", model.means[0]), _decoded("lh", model.means[0])
        both = F.least(_decoded("lp", model.means[1]), word, prior)
        made = made.join(each.groupBy("__row").agg(F.sum(F.col("times") * log_p(both, word, prior, everything, F.log10)).alias("__by_shard")), "__row", "left")
        pairs = F.coalesce("__by_shard", pairs)
    return made.select(
        *rest, F.col("__n_tokens").alias("n_tokens"), (F.col("__n_known") + rare["known"]).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("__base") + rare["base"]).alias("base_score"), (F.col("__score") + pairs).alias("score"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is not trained on: crc32 of its id as text, modulo 5, is 1; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(True))


def op12_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by the model of those that may be trained on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep_text=False).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
