"""Counts over one whole text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from evidencelake.llm.workers import tidy

FIELDS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_digits n_stops n_bangs n_pipes n_distinct n_top_word n_non_ascii"
).split()
SPACE = b"\t\n\v\f\r "


def _count(data: bytes, these: bytes) -> int:
    return len(data) - len(data.translate(None, these))


def text_stats(text: str | None) -> tuple[int, ...]:
    """``FIELDS`` of one text; zeros for a null or empty one.

    A word is a run of characters other than ASCII white space. ``n_repeat_words``: words in
    3-word windows that occur at least twice; ``n_dup_lines``: lines with a word that equal an
    earlier line.
    """
    if not text:
        return (0,) * len(FIELDS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, covered = Counter(windows), bytearray(len(words))
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered[i] = covered[i + 1] = covered[i + 2] = 1
        repeated = sum(covered)
    lines = [x for x in data.split(b"\n") if x.strip()]
    kinds = Counter(words)
    return (
        len(words), len(text) - _count(data, SPACE), _count(data, b"#*$%&|<>"), len(lines) - len(set(lines)), repeated, len(lines),
        _count(data, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _count(data, b"0123456789"), _count(data, b".,;:?"), _count(data, b"!"), _count(data, b"|"),
        len(kinds), max(kinds.values(), default=0), len(data) - len(text),
    )


def stats_column(text: Column) -> Column:
    """A struct of ``FIELDS``; computed once wherever it is used (it is marked as not deterministic)."""

    @F.pandas_udf(", ".join(f"{f} long" for f in FIELDS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with tidy():
            for texts in batches:
                yield pd.DataFrame([text_stats(t) for t in texts], columns=FIELDS, dtype="int64")

    return run.asNondeterministic()(text)
