"""Operator 13 against plain scoring of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from evidencelake.llm import fp_search
from evidencelake.llm.fp_search import Ranking, Tree, lengths, saturation, search_items, terms_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    """``(item, rank, doc, score)`` for ``[(id, text)]`` of both."""
    own = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, want in asked.items():
        ranked = []
        for d, c, n in own:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in want.items() if c[t])
            if s > 0 and d is not None:
                ranked.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out)


def frame(spark, rows, id_name):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], f"{id_name} long, text string, score string, rank int")


def made_up(seed, n_docs=400, n_items=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)]
    text = lambda n: " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(n_docs)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # one text many times
    docs += [(2000 + i, docs[9][1] + f" w{i}") for i in range(60)]
    items = [(i, text(rng.randint(1, 15))) for i in range(n_items)] + [(90, docs[7][1]), (91, docs[9][1])]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("item_terms, tree", [(10**6, 8192), (40, 8192), (10**6, 7)])
def test_equals_plain(spark, monkeypatch, item_terms, tree):
    monkeypatch.setattr(fp_search, "MAX_ITEM_TERMS", item_terms)
    monkeypatch.setattr(fp_search, "FIRST_SHARE", 8)
    docs, items = made_up(item_terms + tree)
    got = search_items(frame(spark, docs, "doc_id").repartition(6), frame(spark, items, "item_id"))
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == plain(docs, items)
    few = search_items(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), k=2)
    assert sorted(tuple(r) for r in few.collect()) == plain(docs, items, 2)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "... --- !!!"), (4, "Ä ä É é A a"), (4, "Ä ä É é A a"), (None, "alpha beta"), (5, "日本語 alpha\x00beta"), (6, "alpha " * 50_000), (7, "ALPHA Beta gamma_delta x-y"), (-3, "alpha beta"),
        (8, "\x7falpha\x80 beta"),
    ]
    items = [(1, "Alpha beta, alpha!"), (2, None), (3, "  ?? "), (None, "alpha"), (4, "ä É 日本語"), (4, "delta"), (5, "nowhere"), (5, "nowhere"), (1, "Alpha beta, alpha!"), (6, "alpha\x80")]
    got = search_items(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"))
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, items)
    assert search_items(frame(spark, [], "doc_id"), frame(spark, items, "item_id")).count() == 0
    assert search_items(frame(spark, docs, "doc_id"), frame(spark, [], "item_id")).count() == 0


def test_terms():
    text = "".join(map(chr, range(0x250))) + " Ab9_zé–x　y"
    assert [t.decode() for t in terms_of(text)] == terms(text)


@pytest.mark.parametrize("tree_size", [3, 50, 500])
def test_branch_and_bound_prunes_and_loses_nothing(tree_size):
    rng = np.random.default_rng(tree_size)
    n_terms, n_docs, n_items, k = 40, 500, 12, 5
    docs = [np.sort(rng.choice(n_terms, rng.integers(0, 12), replace=False)) for _ in range(n_docs)]
    tfs = [rng.integers(1, 4, len(d)) for d in docs]
    m = rng.integers(25, 60, n_docs)
    items = [rng.choice(n_terms, 4, replace=False) for _ in range(n_items)]
    weights = [rng.integers(1, 5000, 4) for _ in items]
    at = np.concatenate(([0], np.cumsum([len(i) for i in items])))
    ranking = Ranking(at, np.concatenate(items), np.concatenate(weights), n_terms, [(1, -(1 << 63))] * n_items, k)
    scored, score = [], ranking.scores
    ranking.scores = lambda active, *x: scored.append(len(active)) or score(active, *x)
    for a in range(0, n_docs, tree_size):
        ranking.search(Tree(np.arange(a, min(n_docs, a + tree_size)), m[a : a + tree_size], docs[a : a + tree_size], tfs[a : a + tree_size], k))
    if tree_size == 500:
        assert sum(scored) < n_docs * n_items  # bounds and scores together are fewer than all scores
    for i in range(n_items):
        every = []
        for d in range(n_docs):
            got = dict(zip(docs[d].tolist(), tfs[d].tolist()))
            s = sum(int(w) * int(saturation(np.int64(got[t]), m[d])) for t, w in zip(items[i].tolist(), weights[i]) if t in got)
            if s:
                every.append((s, -d))
        assert sorted(ranking.best[i], reverse=True) == sorted(every, reverse=True)[:k]


def test_tree_shares_paths():
    tree = Tree(np.array([5, 3, 9, 1]), np.array([30, 30, 30, 30]), [np.array([0, 1, 2]), np.array([0, 1, 2]), np.array([0, 1]), np.array([4])], [np.array([1, 1, 1])] * 2 + [np.array([1, 1]), np.array([2])], 10)
    assert tree.ids == [[9], [3, 5], [1]] and tree.shared.tolist() == [0, 2, 0]
    assert tree.children(0, 3) == [(0, 2), (2, 3)] and tree.children(0, 2) == [(0, 1), (1, 2)]
    assert [x.tolist() for x in tree.below(0, 3)[:2]] == [[0, 1, 2, 4], [1, 1, 1, 2]]


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**7])
    assert lengths(n, 10**12, 3 * 10**14).tolist() == [25 + 75 * x * 10**12 // (3 * 10**14) for x in (1, 10**7)]
    assert lengths(np.empty(0, np.int64), 5, 5).tolist() == []
