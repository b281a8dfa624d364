"""Operator 12 against exact counts in dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evidencelake.llm import bloom_lm
from evidencelake.llm.bloom_lm import BASE, END, KAPPA, Filter, fill, level_of, op12_bloom_lm, pair, score, shard_of, single, tokens_of, train

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id held_out n_tokens n_known train_tokens base_score score".split()


def words(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["\n"]


def level(n):
    return 1 + len({math.ceil(BASE**j) for j in range(1, 60) if math.ceil(BASE**j) <= n})


def plain(rows, learned):
    """``n_tokens, n_known, N, base, score`` of each text: exact counts for the base, and counts as means of their levels for the score, without a filter."""
    one, two = Counter(), Counter()
    for t in learned:
        w = words(t)
        one.update(w)
        two.update(zip(["\n", *w], w))
    total, everything = sum(one.values()), sum(one.values()) + 0.5 * (len(one) + 1)
    means = []
    for counts in (one, two):
        sums, number = Counter(), Counter()
        for n in counts.values():
            sums[level(n)] += n
            number[level(n)] += 1
        means.append({**{at: sums[at] / number[at] for at in sums}, 0: 0.0})
    read = lambda counts, k, at: means[at][level(counts[k])] if counts[k] else 0.0
    out = []
    for t in rows:
        w = words(t)
        base = sum(math.log10((one[x] + 0.5) / everything) for x in w)
        s = 0.0
        for h, x in zip(["\n", *w], w):
            c_h, c_w = read(one, h, 0), read(one, x, 0)
            s += math.log10((min(read(two, (h, x), 1), c_h, c_w) + KAPPA * (c_w + 0.5) / everything) / (c_h + KAPPA))
        out.append((len(w), sum(one[x] > 0 for x in w), total, base, s))
    return out


def documents(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def learn(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 != 1


def test_whole_table(spark):
    got = sorted(tuple(r[c] for c in COLUMNS) for r in op12_bloom_lm(spark, SF).collect())
    rows = documents(spark)
    want = plain([t for _, t in rows], [t for d, t in rows if learn(d)])
    assert [g[:2] for g in got] == [(d, not learn(d)) for d, _ in rows]
    assert [g[2:5] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[5] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-9)
    off = np.abs(np.array([g[6] for g in got]) - [w[4] for w in want])
    assert (off < 1e-7).mean() > 0.2  # the others hold a gram that the filter takes for another
    assert off.sum() / sum(w[0] for w in want) < 0.005
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)  # context helps on unseen texts


@pytest.mark.parametrize("filter_bytes, head", [(0, 10**6), (1 << 28, 50), (0, 0)])
def test_shards_and_joins_give_the_same(spark, monkeypatch, filter_bytes, head):
    want = {r.doc_id: r for r in op12_bloom_lm(spark, SF).collect()}
    monkeypatch.setattr(bloom_lm, "SMALL_SHARD", 20_000)
    many = op12_bloom_lm(spark, SF)
    many_rows = {r.doc_id: r for r in many.collect()}
    monkeypatch.setattr(bloom_lm, "MAX_FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(bloom_lm, "MAX_HEAD_WORDS", head)
    monkeypatch.setattr("evidencelake.scratch.HOT_ROWS", 5)
    got = {r.doc_id: r for r in op12_bloom_lm(spark, SF).collect()}
    assert got.keys() == want.keys()
    for d, r in got.items():
        assert r[:5] == want[d][:5]
        assert math.isclose(r.base_score, want[d].base_score, rel_tol=1e-9) and math.isclose(r.score, many_rows[d].score, rel_tol=1e-9)


def test_large_filters_go_in_rounds_without_a_row_a_pair(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "SMALL_SHARD", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(20)).union(spark.createDataFrame([(None, None), (None, ""), (-1, None)], "doc_id long, text string"))
    model = train(docs.where("doc_id % 3 > 0"))
    rows = lambda: sorted(((r.doc_id or 0, *r[1:]) for r in score(docs, model, keep_text=False).collect()), key=str)
    want = rows()
    monkeypatch.setattr(bloom_lm, "MAX_FILTER_BYTES", model.filter_bytes // 2)
    spans, written = [], []
    partial, put = bloom_lm._partial, bloom_lm.materialize
    monkeypatch.setattr(bloom_lm, "_partial", lambda *a: spans.append(a[-1]) or partial(*a))
    monkeypatch.setattr(bloom_lm, "materialize", lambda df, name: written.append(put(df, name)) or written[-1])
    got = rows()
    assert len(spans) >= 2 and not any(w.where("size(__pairs) > 0").count() for w in written if "__pairs" in w.columns)
    assert [g[:-1] for g in got] == [w[:-1] for w in want] and np.allclose([g[-1] for g in got], [w[-1] for w in want], rtol=1e-9)


def test_odd_rows(spark):
    odd = [None, "", "  \t\n", "A a Ä ä", "A a Ä ä", "x " * 20_000, "a\x1cb\x85c d", "\x00 𝄞"]
    rows = spark.createDataFrame([(i if i else None, t, "mine", 1.5) for i, t in enumerate(odd)], "doc_id long, text string, score string, extra double")
    model = train(rows)
    out = score(rows, model)
    assert sorted(out.columns) == sorted("doc_id text extra n_tokens n_known train_tokens base_score score".split())
    got = [r for r in out.collect()]
    assert len(got) == len(odd)
    by_text = {t: w for t, w in zip(odd, plain(odd, odd))}
    for r in got:
        n, known, total, base, s = by_text[r.text]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, s, rel_tol=1e-9)


def test_untrained_and_empty(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert score(nothing, train(nothing)).count() == 0
    r = score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), train(nothing)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isclose(r.score, 0.0, abs_tol=1e-9)


def test_filter():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    n = np.maximum(1, (rng.pareto(1.0, len(grams)) * 2).astype(np.int64))
    shards = 7
    bits = [fill(grams[shard_of(grams, shards) == s], n[shard_of(grams, shards) == s]) for s in range(shards)]
    held = Filter(np.concatenate(bits), np.concatenate(([0], np.cumsum([len(b) for b in bits]))))
    assert (held.levels(grams) >= level_of(n)).all() and (held.levels(grams) == level_of(n)).mean() > 0.99
    others = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert (held.levels(others) > 0).mean() < 0.008
    assert level_of(np.arange(1, 3000)).tolist() == [level(i) for i in range(1, 3000)]
    assert not Filter(np.empty(0, np.uint64), np.array([0])).levels(grams).any()


def test_probabilities_add_up(spark):
    text = " ".join(f"w{i * i % 97} w{i % 13} the" for i in range(4000))
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    model = train(docs)
    known = bloom_lm._whole_filter(model)
    flat, _ = tokens_of([text])
    kinds = np.unique(flat)
    one = model.means[0][known.levels(single(kinds))]
    for h in kinds[:20]:
        c_h = model.means[0][known.levels(single(np.array([h])))][0]
        both = np.minimum(model.means[1][known.levels(pair(np.full(len(kinds), h), kinds))], np.minimum(one, c_h))
        p = 10 ** bloom_lm.log_p(both, one, c_h, model.tokens + 0.5 * (model.kinds + 1), np.log10)
        assert 0.85 < p.sum() < 1.1
    assert END in kinds
