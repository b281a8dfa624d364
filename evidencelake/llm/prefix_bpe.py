"""Operator 9: BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the last token of its encoding is unique: the one token that
ends there whose predecessor prefix ends in a compatible token (or is empty). An
Aho-Corasick automaton gives the tokens that end at each position; two adjacent tokens are
compatible if merging their joined text by rank leaves exactly these two, which is decided
on the tokens' merge trees alone. Following the back-pointers from the end emits the ids.
No merge loop runs over a word.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from evidencelake.llm.code_points import newer, unknown_to
from evidencelake.llm.token_files import byte_alphabet
from evidencelake.llm.wordcache import TwoGenerations
from evidencelake.llm.workers import tidy

#: Bytes of each generation of cached words, pairs of tokens kept, and texts encoded at once.
CACHED_BYTES, CACHED_PAIRS, SLICE = 64 << 20, 300_000, 256
#: White space in the sense of the tokenizer's normalizer (fixed values); str.split() also splits at U+001C to U+001F.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: The word pattern of this public vocabulary (fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Code points that all versions of Unicode normalize and lower alike; a text with others is normalized by the library.
USUAL = re.compile("[\0-\u036f\u0391-\u03ff\u0400-\u0482\u048a-\u04ff\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf\u2100-\u2bff\u3000-\u3029\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff00-\uffef]*")
#: The same for words with letters or numbers of a newer Unicode than the tokenizer's.
WORDS_BUT = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{0}]]+|[\p{{N}}--[{0}]]|[^\s||[[\p{{L}}\p{{N}}]--[{0}]]]+"
#: The last symbol of a word is another symbol than the same byte inside it; shifted by this much.
LAST = 0x10000


class PrefixBpe:
    """Encoder and decoder for a byte-level vocabulary with word ends, from a tokenizer file's vocabulary and merges."""

    def __init__(self, tokenizer_file: str, cache_bytes: int = CACHED_BYTES):
        spec = json.loads(open(tokenizer_file, encoding="utf-8").read())
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(f"({re.escape(t)})" for t in self.special)) if self.special else None
        self.names = {i: t for t, i in {**vocab, **self.special}.items()}
        self.alphabet = byte_alphabet()
        rank_of = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.merged, self.parts, self.rank = {}, {}, {}
        for (a, b), r in rank_of.items():
            t = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = r
            if t not in self.parts:
                self.parts[t], self.rank[t] = (vocab[a], vocab[b]), r
        self.matches = ahocorasick.Automaton()
        for name, i in vocab.items():
            symbols = self._symbols(name)
            self.matches.add_word(symbols, (i, len(symbols)))
        self.matches.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.cache = TwoGenerations(cache_bytes)
        self.file, self.words_but = tokenizer_file, None

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's own, loaded at the first text whose normalization or words only it can tell."""
        return Tokenizer.from_file(self.file)

    def _symbols(self, name: str) -> str:
        if name.endswith(self.end) and len(name) > len(self.end):
            body = name[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + LAST)
        return name

    def _pair(self, a: int, b: int) -> bool:
        """Whether the joined text of tokens ``a`` and ``b`` encodes to exactly these two.

        Walks both merge trees down along the seam, latest merge first. The seam would have
        been closed if the two tokens now facing each other merge at a rank before the merge
        that was just undone; on equal ranks the left one happens first.
        """
        left, right = a, b
        while True:
            undo_left = self.rank.get(left, -1)
            undo_right = self.rank.get(right, -1)
            seam = self.merged.get((left, right))
            if seam is not None and self._earlier(seam, a, left, b, right):
                return False
            if undo_left < 0 and undo_right < 0:
                return True
            if undo_left > undo_right:
                left = self.parts[left][1]
            else:
                right = self.parts[right][0]

    def _earlier(self, seam: int, a: int, left: int, b: int, right: int) -> bool:
        """Whether a merge at rank ``seam`` happens before ``left`` and ``right`` are absorbed into ``a`` and ``b``."""
        absorbed_left = min((self.rank[t] for t in self._chain(a, left, 1)), default=None)
        absorbed_right = min((self.rank[t] for t in self._chain(b, right, 0)), default=None)
        return (absorbed_left is None or seam < absorbed_left) and (absorbed_right is None or seam <= absorbed_right)

    def _chain(self, top: int, down: int, side: int) -> Iterator[int]:
        """The tokens above ``down`` on the way from ``top`` along one edge of the merge tree."""
        while top != down:
            yield top
            top = self.parts[top][side]

    def word(self, word: str) -> list[int]:
        """Ids of one word (a match of the word pattern, normalized)."""
        s = word.encode("utf-8").decode("latin-1").translate(self.alphabet)
        s = s[:-1] + chr(ord(s[-1]) + LAST)
        last: list[tuple[int, int] | None] = [None] * len(s)
        known = self.compatible
        for at, (token, n) in self.matches.iter(s):
            before = at - n
            if before >= 0:
                if last[at] is not None or last[before] is None:
                    continue
                pair = last[before][0] << 32 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= CACHED_PAIRS:
                        known.clear()
                    fits = known[pair] = self._pair(last[before][0], token)
                if not fits:
                    continue
            elif last[at] is not None:
                continue
            last[at] = (token, before)
        out, at = [], len(s) - 1
        while at >= 0:
            if last[at] is None:
                raise ValueError(f"no encoding of {word!r}")
            token, at = last[at]
            out.append(token)
        return out[::-1]

    def _words(self, chunk: str) -> list[str]:
        if chunk.isascii() or newer().isdisjoint(chunk):
            return WORDS.findall(chunk)
        if self.words_but is None:
            self.words_but = regex.compile(WORDS_BUT.format(unknown_to(self.tokenizer) or "\0"))
        return self.words_but.findall(chunk)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        ids = [i for w in self._words(chunk) for i in self.word(w)]
        return np.array(ids, "<u4").tobytes(), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder does: the tokens with a space between them."""
        return " ".join(self.names[i] for i in ids)

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            if not USUAL.fullmatch(text):
                return self.tokenizer.normalizer.normalize_str(text).split(" ")
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [c for c in SPACE.split(text) if c] if SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and their decoded text."""
        cut: list[list[list[str] | str]] = []
        for t in texts:
            parts = [x for x in self.specials.split(t or "") if x] if self.specials and any(x in (t or "") for x in self.special) else [t or ""]
            cut.append([x if x in self.special else self._chunks(x) for x in parts])
        for c in self.cache.missing(c for doc in cut for part in doc if isinstance(part, list) for c in part):
            self.cache.put(c, self._chunk(c))
        get, out = self.cache.young, []
        for doc in cut:
            found: list[tuple[bytes, str]] = []
            for part in doc:
                if isinstance(part, str):
                    found.append((np.array([self.special[part]], "<u4").tobytes(), part))
                else:
                    found += [get[c] for c in part]
            out.append((b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])))
        return out


_encoders: dict[str, PrefixBpe] = {}


def prefix_bpe(tokenizer_file: str, cache_bytes: int) -> PrefixBpe:
    """One encoder and cache for each worker process."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = PrefixBpe(tokenizer_file, cache_bytes)
    return _encoders[tokenizer_file]


def forget() -> None:
    """Frees this worker's encoders. A function of the module, since a function sent to workers has copies of the globals that it names."""
    _encoders.clear()


def bpe_round_trip(docs: DataFrame, tokenizer_file: str, text_col: str = "text", digests_only: bool = False, keep: bool = True, cache_bytes: int = CACHED_BYTES) -> DataFrame:
    """``docs`` with ``token_ids`` (binary, little-endian unsigned 32-bit), ``decoded``, or their digests, added.

    ``digests_only`` gives ``n_tokens, ids_sha256, decoded_sha256`` instead of ids and text. ``keep``: workers keep the
    encoder and its cache (two generations of ``cache_bytes``) for their next task, else they free both after each, for jobs whose other stages need the memory. One row
    in, one row out, no shuffle; a null text counts as empty (no ids, empty decoded text); columns of
    ``docs`` with the same names are replaced; repeated rows stay.
    """
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests_only else "n_tokens long, token_ids binary, decoded string"

    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests_only else ["n_tokens", "token_ids", "decoded"]

    @F.pandas_udf(kind)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = prefix_bpe(tokenizer_file, cache_bytes)
        with tidy():
            for texts in batches:
                rows: list[tuple] = []
                for a in range(0, len(texts), SLICE):
                    for ids, decoded in bpe.encode(texts.iloc[a : a + SLICE].tolist()):
                        if digests_only:
                            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
                        else:
                            rows.append((len(ids) // 4, ids, decoded))
                yield pd.DataFrame(rows, columns=names)
            del bpe
            if not keep:
                forget()

    udf = encode.asNondeterministic()
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*rest, udf(F.col(text_col)).alias("__bpe")).select(*rest, *[F.col(f"__bpe.{n}").alias(n) for n in names])


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded text of every whole document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), digests_only=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
