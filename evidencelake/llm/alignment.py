"""Operator 11: alignment of two tokenizers by pointer jumping.

Both encodings of a text cut the same bytes. Every token points to the farthest-right token of the
other encoding that it overlaps, the one that holds its last byte; where two ends meet, the second
encoding's token points to itself. Doubling the pointers (``succ = succ[succ]``) leads each token to the last
token of its component in a number of steps that is the logarithm of the longest chain. Tokens of one
terminal are one group. All texts of a batch are aligned at once, as one long row of bytes.

How often two ids are linked in the whole corpus is counted from the distinct pairs of each text, and
goes back to the texts by a broadcast of proven size or by a join that spreads frequent pairs.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from evidencelake.llm.code_points import newer
from evidencelake.llm.token_files import ODD_SPACE, byte_alphabet
from evidencelake.llm.workers import tidy
from evidencelake.scratch import is_small, join_per_key, materialize

#: Texts are aligned together until they reach this many bytes; a longer one stands alone.
BATCH_BYTES = 1 << 20
#: Pairs of ids that a broadcast may hold (a row of 24 bytes each).
MAX_BROADCAST_PAIRS = 1_000_000
#: A run of white space from which the fast pattern engine might need too many steps.
LONG_RUN = re.compile(r"\s{500}")
FIELDS = {"n_a": "int", "n_b": "int", "n_groups": "int", "n_links": "int", "groups_sha256": "string", "pairs": "array<struct<pair: bigint, times: int>>"}
IDS = {"a_ids": "array<int>", "b_ids": "array<int>", "a_group": "array<int>", "b_group": "array<int>"}


class ByteTokens:
    """Encoding A: a byte-level vocabulary; strings of special tokens are plain text.

    The file's merges are ranks where the ids follow their order; tiktoken then encodes, with the same ids. Texts with characters
    that pattern engines class in different ways, long runs of white space, and other vocabularies go to the tokenizers library.
    """

    def __init__(self, tokenizer_file: str):
        from public_tokenizers import PATTERN

        spec = json.loads(open(tokenizer_file, encoding="utf-8").read())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        of = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        special = {t["content"] for t in spec["added_tokens"]}
        for name, i in vocab.items():
            if name not in special:
                self.bytes[i] = bytes(of[c] for c in name)
        ranked = all(vocab["".join(m if isinstance(m, list) else m.split(" "))] == 256 + i for i, m in enumerate(merges))
        self.fast = None
        if ranked and all(self.bytes[:256]):
            self.fast = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})
        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        seen = set(text)
        if self.fast and ODD_SPACE.isdisjoint(seen) and (text.isascii() or newer().isdisjoint(seen)) and not LONG_RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Encoding B: a sentencepiece model that adds a space before the text and falls back to bytes."""

    def __init__(self, model_file: str):
        self.model = SentencePieceProcessor(model_file=model_file)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode("utf-8"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of two cuts of the same bytes, given the rising end offsets of both; groups are numbered from 0 in order.

    Empty cuts give no groups.
    """
    n = len(a_end)
    to_b, to_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    own = n + np.arange(len(b_end))
    succ = np.concatenate((n + to_b, np.where(a_end[to_a] == b_end, own, to_a))) if n else own
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            break
        succ = further
    label = np.searchsorted(np.unique(succ), succ)
    return label[:n], label[n:]


class Aligner:
    """Both encoders and the tables of their tokens' bytes and decimal names."""

    def __init__(self, byte_file: str, piece_file: str):
        self.a, self.b = ByteTokens(byte_file), PieceTokens(piece_file)
        self.a_len, self.b_len = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        na, nb = len(self.a_len), len(self.b_len)
        #: Names of A followed by a comma or a bar, then names of B followed by a comma or a semicolon.
        self.names = np.array([f"{i}{mark}" for n, mark in ((na, ","), (na, "|"), (nb, ","), (nb, ";")) for i in range(n)], object)

    def pairs(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each text; none where it is null or empty or where either encoding has other bytes than a space and the text."""
        spaced = [f" {t}" if t else "" for t in texts]
        a = [self.a.encode(t) if t else [] for t in spaced]
        b = self.b.encode([t or "" for t in texts])
        for k, t in enumerate(spaced):
            want = t.encode("utf-8")
            if not t or b"".join([self.a.bytes[i] for i in a[k]]) != want or b"".join([self.b.bytes[i] for i in b[k]]) != want:
                a[k], b[k] = [], []
        return a, b

    def align(self, texts: list[str | None], ids: bool) -> list[pa.Array]:
        """One Arrow column for each of FIELDS (and IDS)."""
        a, b = self.pairs(texts)
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        at_a, at_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
        flat_a, flat_b = np.fromiter(itertools.chain.from_iterable(a), np.int64, at_a[-1]), np.fromiter(itertools.chain.from_iterable(b), np.int64, at_b[-1])
        a_end, b_end = np.cumsum(self.a_len[flat_a]), np.cumsum(self.b_len[flat_b])
        g_a, g_b = components(a_end, b_end)
        doc_a, doc_b = np.repeat(np.arange(len(a)), n_a), np.repeat(np.arange(len(b)), n_b)
        new = np.concatenate(([True], g_b[1:] != g_b[:-1])) if len(g_b) else np.empty(0, bool)
        n_groups = np.bincount(doc_b[new], minlength=len(a))

        ends = np.union1d(a_end, b_end)  # each stretch between two ends lies in one token of either side: a link
        link_a, link_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        doc = doc_a[link_a]
        order = np.lexsort((pair := flat_a[link_a] << 32 | flat_b[link_b], doc))
        pair, doc = pair[order], doc[order]
        first = np.concatenate(([True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1]))) if len(pair) else np.empty(0, bool)
        begins = np.flatnonzero(first)
        times = np.diff(np.append(begins, len(pair)))
        at_pair = np.concatenate(([0], np.cumsum(np.bincount(doc[begins], minlength=len(a)))))

        structs = pa.StructArray.from_arrays([pa.array(pair[begins]), pa.array(times.astype(np.int32))], ["pair", "times"])
        out = [pa.array(x.astype(np.int32)) for x in (n_a, n_b, n_groups, np.bincount(doc, minlength=len(a)))]
        out.append(pa.array(self._digests(flat_a, flat_b, g_a, g_b, at_a, at_b), pa.string()))
        out.append(pa.ListArray.from_arrays(pa.array(at_pair.astype(np.int32)), structs))
        if ids:
            before = np.concatenate(([0], np.cumsum(n_groups)))[:-1]
            for at, values in ((at_a, flat_a), (at_b, flat_b), (at_a, g_a - before[doc_a]), (at_b, g_b - before[doc_b])):
                out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32))))
        return out

    def _digests(self, flat_a: np.ndarray, flat_b: np.ndarray, g_a: np.ndarray, g_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``, hashed; an empty string without tokens."""
        na, nb = len(self.a_len), len(self.b_len)
        ends_a, ends_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool) for g in (g_a, g_b))
        place = np.empty(len(g_a) + len(g_b), np.int64)  # a group's A tokens, then its B tokens
        place[np.arange(len(g_a)) + np.searchsorted(g_b, g_a)] = flat_a + ends_a * na
        place[np.arange(len(g_b)) + np.searchsorted(g_a, g_b, "right")] = 2 * na + flat_b + ends_b * nb
        names = self.names[place].tolist()
        at = at_a + at_b
        return [hashlib.sha256("".join(names[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in itertools.pairwise(at.tolist())]


@functools.lru_cache(maxsize=1)
def aligner(byte_file: str, piece_file: str) -> Aligner:
    """One for each worker process."""
    return Aligner(byte_file, piece_file)


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def align_tokens(docs: DataFrame, byte_file: str, piece_file: str, text_col: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` with FIELDS and, with ``ids``, IDS added: the ids of both encodings and the group of each, from 0 in every text.

    ``pairs`` holds the distinct pairs of linked ids (A's shifted left by 32 bits, or B's) and how many links have each. One row in, one row
    out, no shuffle; a null or empty text, or one that an encoding changes, has no tokens: zeros, empty lists and an empty digest. Columns of
    these names are replaced; repeated rows stay.
    """
    kinds = {**FIELDS, **IDS} if ids else FIELDS
    names = list(kinds)

    @F.arrow_udf(", ".join(f"{n} {kind}" for n, kind in kinds.items()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = aligner(byte_file, piece_file)
        with tidy():
            for batch in batches:
                parts = [pa.StructArray.from_arrays(both.align(texts, ids), names) for texts in _slices(batch.to_pylist())]
                yield pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays(both.align([], ids), names)

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*rest, run.asNondeterministic()(F.col(text_col)).alias("__aligned")).select(*rest, *[F.col(f"__aligned.{n}").alias(n) for n in names])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: how many links of the corpus have each pair of ids, and whether no other pair of its B id has more."""
    counts = materialize(aligned.select(F.explode("pairs").alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.times").alias("n")), "pair-counts")
    b: Column = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame) -> DataFrame:
    """``aligned`` rows (as ``align_tokens`` gives them) with ``n_best`` and ``count_sum`` in place of ``pairs``.

    ``count_sum`` adds the corpus-wide counts of all links, ``n_best`` counts the links whose count is the highest of their B id, ties
    included. Zeros without links. Pairs are broadcast if proven few; else they are joined, with frequent pairs spread.
    """
    rows = materialize(aligned.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(rows), "pairs")
    links = rows.select("__row", F.explode("pairs").alias("p")).select("__row", F.col("p.pair").alias("pair"), F.col("p.times").alias("times"))
    met = links.join(F.broadcast(counts), "pair", "left") if is_small(counts, MAX_BROADCAST_PAIRS) else join_per_key(links, counts, "pair")
    sums = met.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "n_best", "count_sum").join(sums, "__row", "left").drop("__row")
    return out.withColumns({x: F.coalesce(x, F.lit(0)).cast("long") for x in ("n_best", "count_sum")})


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document in both public vocabularies."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    aligned = align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), ids=False).drop("text")
    long = [F.col(c).cast("long").alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return link_scores(aligned).select(*long, "groups_sha256")
