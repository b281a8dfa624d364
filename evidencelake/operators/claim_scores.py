"""H-2: scores of claims against sources, for all pairs of an Arrow batch at once: words become numbers, and overlaps are looked up in sorted keys."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidencelake.functions import text as T

#: Words that negate (fixed values).
NEGATIONS = ("not", "never", "without", "cannot", "fails", "fail", "failed", "lack", "lacks", "none")
#: Bytes of texts that are taken apart at once.
BYTES_AT_ONCE = 8_000_000
#: The bytes of words (``T.tokens3``) in lower case, others 0; white space and the marks that end a sentence (``T.sentences``), the wide ones by their bytes.
LOWER = bytes(ord(chr(b).lower()) if b < 128 and (chr(b).isalnum() or chr(b) == "_") else 0 for b in range(256))
BLANK, MARK = (bytes(b in x for b in range(256)) for x in (b" \t\n\x0b\f\r", b".!?"))
WIDE_MARKS = [tuple(m.encode()) for m in "。！？"]
#: Letters beyond ASCII whose lower case has a letter of ASCII.
LOWERED = {"K": "k", "İ": "i̇"}
#: ``T.NUMBER``, and the bytes that it can be made of.
FIGURE, OF_FIGURES = re.compile(T.NUMBER, re.ASCII), bytes(b if b in b"0123456789.%" else 0 for b in range(256))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all pieces of rows with ``counts`` places from ``starts`` on."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _runs(raw: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Where runs of bytes that ``table`` does not make 0 begin, their sizes, and what it makes them."""
    made = np.frombuffer(raw.translate(table), np.uint8)
    inside = made > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate(([0], edges)) if inside[:1].any() else edges
    first, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return first, size, pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(made[inside])).dictionary_encode()


def _taken_apart(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts the text, the sentence and the word's number; whether that word negates, by number; of all figures the text and the figure's number."""
    for letter, low in LOWERED.items():
        texts = pc.replace_substring(texts, letter, low)
    joined = pc.binary_join_element_wise(texts, "", "\n")  # a line feed ends each text, so that none runs into the next
    begins = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1).astype(np.int64)
    raw = joined.buffers()[2][: begins[-1]].to_pybytes()
    owner = lambda places: np.searchsorted(begins, places, "right") - 1
    first, size, words = _runs(raw, LOWER)
    long = size >= 3
    first, word = first[long], words.indices.to_numpy()[long].astype(np.int64)

    data, blank, mark = (np.frombuffer(x, np.uint8) for x in (raw, raw.translate(BLANK), raw.translate(MARK)))
    stops = [begins[1:-1], np.flatnonzero(blank[1:] & mark[:-1]) + 1]
    for a, b, c in WIDE_MARKS if not raw.isascii() else ():
        stops.append(np.flatnonzero(blank[3:] & (data[:-3] == a) & (data[1:-2] == b) & (data[2:-1] == c)) + 3)
    sentence = np.searchsorted(np.sort(np.concatenate(stops)), first, "right")

    at, _, runs = _runs(raw, OF_FIGURES)
    found = [FIGURE.findall(r) for r in runs.dictionary.to_pylist()]  # a figure ends where its run does
    numbers: dict[str, int] = {}
    figures = np.array([numbers.setdefault(x, len(numbers)) for f in found for x in f], np.int64)
    counts = np.array([len(f) for f in found], np.int64)
    run = runs.indices.to_numpy()
    figure = figures[_spread((np.cumsum(counts) - counts)[run], counts[run])]
    return owner(first), sentence, word, pc.is_in(words.dictionary, pa.array(NEGATIONS)).to_numpy(False), owner(np.repeat(at, counts[run])), figure


def _different(x: np.ndarray) -> np.ndarray:
    """The different numbers in order."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))]


def _shared(own: np.ndarray, item: np.ndarray, n_all: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text how many different items it has; of each item that claim ``i`` and source ``j`` of a pair share the pair, and its place among the sorted keys, which come last."""
    base = int(item.max(initial=0)) + 1
    keys = _different(own * base + item)
    sizes = np.bincount(keys // base, minlength=n_all)
    starts = np.cumsum(sizes) - sizes
    n = sizes[i]
    pair = np.repeat(np.arange(len(i)), n)
    wanted = j[pair] * base + keys[_spread(starts[i], n)] % base
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    hit = keys[at] == wanted
    return sizes, pair[hit], at[hit], keys


def _most_of_a_sentence(own: np.ndarray, sentence: np.ndarray, word: np.ndarray, pair: np.ndarray, at: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Of each pair the most shared words that one sentence of the source has."""
    most = np.zeros(n, np.int64)
    if not len(pair):
        return most
    base, many = int(word.max()) + 1, int(sentence.max()) + 1
    place = np.searchsorted(keys, own * base + word)
    once = _different(place * many + sentence)  # a word once a sentence, by text and word
    counts = np.bincount(once // many, minlength=len(keys))
    starts = np.cumsum(counts) - counts
    c = counts[at]
    met = np.sort(np.repeat(pair, c) * many + once[_spread(starts[at], c)] % many)
    begins = np.flatnonzero(np.diff(met, prepend=-1))
    times, of = np.diff(begins, append=len(met)), met[begins] // many
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    most[of[begins]] = np.maximum.reduceat(times, begins)
    return most


def _part(claim: pa.Array, numeric: np.ndarray, text: pa.Array) -> np.ndarray:
    claim, text = claim.dictionary_encode(), text.dictionary_encode()
    n_claims = len(claim.dictionary)
    i, j = claim.indices.to_numpy(), text.indices.to_numpy().astype(np.int64) + n_claims
    n_all = n_claims + len(text.dictionary)
    own, sentence, word, negative, figure_own, figure = _taken_apart(pa.concat_arrays([claim.dictionary, text.dictionary]))
    sizes, pair, at, keys = _shared(own, word, n_all, i, j)
    common = np.bincount(pair, minlength=len(i))
    most = _most_of_a_sentence(own, sentence, word, pair, at, keys, len(i))
    n_figures, same, _, _ = _shared(figure_own, figure, n_all, i, j)
    negates = np.zeros(n_all, bool)
    negates[own[negative[word]]] = True

    n = np.maximum(sizes[i], 1)
    lexical = common / n
    coverage = common / np.maximum(np.minimum(sizes[i], sizes[j]), 1)
    figures = np.bincount(same, minlength=len(i)) / np.maximum(n_figures[i], 1)
    penalty = np.where((negates[i] != negates[j]) & (lexical >= 0.2), 0.18, 0.0)
    return np.clip(lexical * 0.4 + coverage * 0.25 + most / n * 0.2 + figures * np.where(numeric, 0.25, 0.05) - penalty, 0.0, 1.0)


def scores(claim: pa.Array, numeric: pa.Array, text: pa.Array) -> pa.Array:
    """The score of each claim against the text beside it; ``numeric``: whether it is a numeric claim. Null is an empty text, and not numeric."""
    claim, text = (x.cast(pa.string()).fill_null("") for x in (claim, text))
    flags = numeric.fill_null(False).to_numpy(False)
    step = max(1, len(text) * BYTES_AT_ONCE // max(claim.nbytes + text.nbytes, BYTES_AT_ONCE))
    parts = [_part(claim[k : k + step], flags[k : k + step], text[k : k + step]) for k in range(0, len(text), step)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0))
