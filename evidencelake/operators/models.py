"""L-1: models behind protocols, loaded once in each worker process, with offline defaults."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, functions as F

TOKEN = re.compile(r"[a-z0-9]{3,}")
NUMBER = re.compile(r"\d+(?:\.\d+)?")
#: Words that turn a statement round (fixed values), and the share of common words from which that contradicts.
NEGATION, ALIKE = re.compile(r"\b(?:not|no|never|without|fails?)\b"), 0.3

_models: dict[str, object] = {}


class Scorer(Protocol):
    """Scores texts for questions, the higher the better; None where it cannot tell."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float | None]: ...


class Entailment(Protocol):
    """For claims and sources the probabilities that the source entails the claim and that it contradicts it."""

    def judge(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float]]: ...


def once(make: Callable) -> object:
    """The model that ``make`` loads, one for each worker process. A function of the module, so that all tasks of a process share its table."""
    key = f"{make.__module__}.{make.__qualname__}"
    if key not in _models:
        _models[key] = make()
    return _models[key]


def _share(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a) if a else 0.0


class TokenOverlap:
    """The offline scorer: the share of a question's distinct tokens that a text holds."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float | None]:
        return [_share(set(TOKEN.findall(q.lower())), set(TOKEN.findall(t.lower()))) for q, t in pairs]


class LexicalEntailment:
    """The offline entailment: the share of a claim's tokens in the source; a contradiction where they are alike and only one of them is negated."""

    def judge(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float]]:
        out = []
        for claim, source in pairs:
            a, b = claim.lower(), source.lower()
            same = _share(set(TOKEN.findall(a)), set(TOKEN.findall(b)))
            out.append((same, float(same >= ALIKE and bool(NEGATION.search(a)) != bool(NEGATION.search(b)))))
        return out


def model_score(query: Column, text: Column, make: Callable[[], Scorer] = TokenOverlap) -> Column:
    """A scorer over Arrow batches: double; null where either side is null or the model gives none."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = once(make)
        for q, t in batches:
            both = (q.notna() & t.notna()).to_numpy()
            scores = iter(model.score(list(zip(q[both], t[both]))))
            yield pd.Series([next(scores) if known else None for known in both], dtype="float64")

    return run(query, text)


def entailment(claim: Column, source: Column, make: Callable[[], Entailment] = LexicalEntailment) -> Column:
    """An entailment model over Arrow batches: ``entail, contradiction``; both 0 where either side is null."""

    @F.pandas_udf("entail double, contradiction double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = once(make)
        for a, b in batches:
            both = (a.notna() & b.notna()).to_numpy()
            judged = iter(model.judge(list(zip(a[both], b[both]))))
            yield pd.DataFrame([next(judged) if known else (0.0, 0.0) for known in both], columns=["entail", "contradiction"], dtype="float64")

    return run(claim, source)


def numeric_share(claim: Column, source: Column) -> Column:
    """The share of a claim's distinct numbers that the source holds; 0 without numbers."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER.pattern), 0))
    n = F.size(found(claim))
    return F.when(n > 0, F.size(F.array_intersect(found(claim), found(source))) / n).otherwise(0.0)
