"""Operators 1, 3 and 10 on small cases, and the pipeline against plain versions."""

from __future__ import annotations

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import chosen_path as C, decontamination as D, license_scan as S
from tests.compare import same


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def brute(rows):
    """Classes and links by all pairs."""
    sets = [set(C.shingle_set(t).tolist()) for _, t in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    up = [r[0] for r in rows]
    for _ in range(n):
        up = [min([up[i], *(up[j] for j in range(n) if link[i][j])]) for i in range(n)]
    return {rows[i][0]: (up[i], sum(link[i])) for i in range(n)}


@pytest.fixture
def small_limits(monkeypatch):
    monkeypatch.setattr(C, "LIMIT", 6)
    monkeypatch.setattr(C, "BLOCK", 5)


def test_join_equals_all_pairs(spark, small_limits):
    rng, rows = random.Random(4), []
    for g in range(12):
        base = words(80, g)
        for k in range(25 if g == 0 else 3):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    shared = words(70, 99)
    rows += [(len(rows) + i, " ".join(shared + words(40, 1000 + i))) for i in range(30)]
    rows += [(500, rows[3][1]), (501, None), (502, ""), (503, "two words"), (504, "Two  words"), (505, "   \n ")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in C.jaccard_classes(df).collect()}
    assert got == brute(rows)


def test_join_on_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    got = C.jaccard_classes(df).collect()
    assert [(r.class_id, r.n_copies, r.n_links) for r in got] == [(1, 3, 2)] * 3
    assert sorted(str(r.doc_id) for r in C.keep_first(df).collect()) == ["1", "1", "None"]
    assert C.jaccard_classes(df.limit(0)).count() == 0


def test_join_without_broadcast(spark, small_limits, monkeypatch):
    monkeypatch.setattr(C, "MAX_BROADCAST_IDS", 0)
    base = words(60, 1)
    rows = [(i, " ".join([*base[:i], "x", *base[i + 1 :]])) for i in range(9)] + [(20, " ".join(words(60, 2)))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in C.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate((a[: len(a) // 2], rng.integers(0, 2**63, 200).astype(np.uint64))))
        x = np.frombuffer(C.parity(a), np.uint8) ^ np.frombuffer(C.parity(b), np.uint8)
        assert int(np.bitwise_count(x).sum()) <= len(np.setxor1d(a, b))
    assert C.common_counts([a, b], 64).tolist() == [[len(a), len(np.intersect1d(a, b))], [len(np.intersect1d(a, b)), len(b)]]


def test_leaks(spark):
    item = words(30, 7)
    changed = list(item)
    changed[5] = changed[17] = "changed"
    docs = [(1, " ".join(words(40, 1) + item + words(9, 2)), "x"), (2, " ".join(changed).upper(), "x"), (3, " ".join(words(90, 3)), "x"), (4, None, "x"), (5, "", "x"), (6, " ".join(item[:12] + words(80, 5)), "x"), (None, " ".join(item), "x"), (1, "other", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, " ".join(item)), (10, " ".join(item)), (11, None), (12, "short item"), (None, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.equal_words, r.item_words, r.doc_word) for r in D.find_leaks(df, bench).collect()}
    assert got == {(1, 10): (30, 30, 40), (2, 10): (28, 30, 0)}
    assert sorted(str(r.doc_id) for r in D.drop_leaked(df, bench).collect()) == ["3", "4", "5", "6", "None"]
    assert D.find_leaks(df, bench.limit(0)).count() == D.find_leaks(df.limit(0), bench).count() == 0


def test_both_ways_of_the_seed_join(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    few = D.op10_decontamination(spark, sf).orderBy("doc_id", "item_id").collect()
    monkeypatch.setattr(D, "MAX_BROADCAST_SEEDS", 0)
    assert D.op10_decontamination(spark, sf).orderBy("doc_id", "item_id").collect() == few


def test_large_benchmarks_go_in_rounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(words(5, 50 + i) + words(20, i % 6) + words(5, 80 + i))) for i in range(30)], "doc_id long, text string")
    items = [(100 * copy + i, " ".join(words(20, i)).upper() if copy else " ".join(words(20, i))) for copy in range(6) for i in range(6)] + [(900, " ".join(words(4, 1)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = {(i, 100 * copy + i % 6, 20, 20, 5) for i in range(30) for copy in range(6)} | {(i, 900, 4, 4, 5) for i in range(1, 30, 6)}
    made, seeds = [], D.seeds
    monkeypatch.setattr(D, "seeds", lambda rows: made.append(rows) or seeds(rows))
    for most, rounds in ((D.MAX_BROADCAST_SEEDS, 1), (3 * 20 * len(D.MASKS), None), (D.MAX_BROADCAST_SEEDS, 1)):
        made.clear()
        monkeypatch.setattr(D, "MAX_BROADCAST_SEEDS", most)
        out = D.find_leaks(docs, bench)
        sides = [m for m in made if "item_id" in m.columns]
        sizes = [m.count() for m in sides]  # equal texts are one
        assert sum(sizes) == 6 and max(sizes) * 20 * len(D.MASKS) <= most and len(sizes) == (rounds or len(sizes))
        assert {tuple(r) for r in out.collect()} == wanted
    monkeypatch.setattr(D, "MAX_BROADCAST_SEEDS", 0)
    plan = D.find_leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin [seed" in line for line in plan.splitlines())  # Spark's guess of a small side does not broadcast it


def test_masks_hit_every_pattern_of_the_share():
    for n in range(D.SPAN, 2 * D.SPAN):
        for equal in itertools.combinations(range(n), -(-6 * n // 10)):
            here = set(equal)
            assert any(all(at + o in here for o in mask) for at in equal for mask in D.MASKS), (n, equal)


def test_leaks_down_to_the_share_equal_brute_force(spark):
    rnd, docs, items = random.Random(1), [], []
    for n in (9, 10, 11, 12, 14, 15, 16, 18, 23, 30):
        item = words(n, n)
        items.append((n, " ".join(item)))
        for k in range(40):
            out = set(rnd.sample(range(n), rnd.choice((n - -(-6 * n // 10), n - -(-6 * n // 10), 1))))
            changed = [f"other{k}" if i in out else w for i, w in enumerate(item)]
            cut = rnd.choice((0, 0, 0, 1))
            docs.append((len(docs), " ".join(changed[cut:] if cut else words(rnd.randrange(3), 99) + changed)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    c = duckdb.connect()
    for name, rows in (("documents", docs), ("benchmark", items)):
        c.execute(f"CREATE TABLE {name} ({'doc_id' if name == 'documents' else 'item_id'} BIGINT, text VARCHAR)")
        c.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    same(D.find_leaks(df, bench), D.ORACLE, c)


def test_shuffled_seeds_find_the_same_in_a_very_long_text(spark, monkeypatch):
    item = words(25, 5)
    text = words(20_000, 8)
    for at, changed in ((3, ()), (9_000, (0, 7, 12)), (19_990, ())):
        text[at : at + 25] = [f"x{i}" if i in changed else w for i, w in enumerate(item)]
    df = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(item[:15])), (2, " ".join(item[8:])), (3, "short")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(words(25, 6)))], "item_id long, text string")
    few = {tuple(r) for r in D.find_leaks(df, bench).collect()}
    assert few == {(1, 7, 25, 25, 3), (2, 7, 17, 25, -8)}
    licensed = spark.createDataFrame([(1, " ".join(text[:10_000]) + " " + S.TEMPLATES[2][2] + " " + " ".join(text[10_000:])), (2, None)], "doc_id long, text string")
    found = {tuple(r) for r in S.scan_licenses(licensed, S.template_table(spark)).collect()}
    assert ("MIT", "grant") in {r[1:3] for r in found}
    for module in (D, S):
        for limit in ("MAX_BROADCAST_SEEDS", "MAX_BROADCAST_BANDS", "MAX_BROADCAST_WORDS"):
            if hasattr(module, limit):
                monkeypatch.setattr(module, limit, 0)
    assert {tuple(r) for r in D.find_leaks(df, bench).collect()} == few
    assert {tuple(r) for r in S.scan_licenses(licensed, S.template_table(spark)).collect()} == found


def test_runs_follow_from_the_recall():
    assert C.runs_for(C.RECALL) == 20 and C.runs_for(0.99) < C.runs_for(0.999) < C.runs_for(0.9999) and C.runs_for(0.999, 2) < C.runs_for(0.999, 4)


def test_short_items_are_found_verbatim(spark, monkeypatch):
    docs = [(1, "before Which one, is it? after " + " ".join(words(20, 1))), (2, "which ONE is it"), (3, "which one was it " + " ".join(words(20, 2))), (4, "is it which one is it which one is it " + " ".join(words(8, 8))), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "which one is it"), (1, "which one is it"), (2, " ".join(words(8, 8))), (3, ""), (4, None), (5, " ".join(words(20, 1)))], "item_id long, text string")
    wanted = {(1, 1, 4, 4, 1), (1, 5, 20, 20, 6), (2, 1, 4, 4, 0), (4, 1, 4, 4, 2), (4, 2, 8, 8, 10)}
    for most in (D.MAX_BROADCAST_SEEDS, 0):
        monkeypatch.setattr(D, "MAX_BROADCAST_SEEDS", most)
        assert {tuple(r) for r in D.find_leaks(df, bench).collect()} == wanted
    assert [r.doc_id for r in D.drop_leaked(df, bench).orderBy("doc_id").collect()] == [3, 5]


def test_licenses(spark):
    mit = dict((a + b, c) for a, b, c in S.TEMPLATES)["MITgrant"].split()
    damaged = list(mit)
    damaged[20] = damaged[40] = "xxx"
    docs = [(1, "intro words here\n" + " ".join(mit).upper() + " more"), (2, " ".join(words(33, 1) + damaged)), (3, " ".join(mit[:20])), (4, None), (5, ""), (6, "Released under the MIT License."), (7, "two words"), (None, " ".join(mit)), (6, "Released under the MIT License.")]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license, r.form): r.containment for r in S.scan_licenses(df, S.template_table(spark)).collect()}
    assert set(got) == {(1, "MIT", "grant"), (2, "MIT", "grant"), (6, "MIT", "short")}
    assert got[1, "MIT", "grant"] == 1 and 0.8 <= got[2, "MIT", "grant"] < 1
    assert S.scan_licenses(df.limit(0), S.template_table(spark)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id", "left_semi").where("n_chars between 400 and 3000").orderBy("doc_id").limit(5).collect()
    wide = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id string"
    odd = [(None, good[0].text), (900_001, None), (900_002, ""), (900_003, good[1].text), (900_003, good[1].text), (900_004, " \n")]
    rows = [(*r, 0.5, "x") for r in good] + [(i, t, None, None, None, None, None) for i, t in odd]
    for name, stage in P.STAGES:
        empty = stage(spark, spark.createDataFrame([], wide), sf)
        assert empty.count() == 0, name
        df = spark.createDataFrame(rows, wide)
        out = stage(spark, df, sf)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "tokens":
            assert len(ids) == len(rows) and out.where("n_tokens = 0").count() == 3
        else:
            assert out.columns == df.columns and set(out.collect()) <= set(df.collect()), name
        if name in ("near_duplicates", "decontamination"):
            assert {900_001, 900_002, 900_004, None} <= set(ids), name
        if name == "quality_rules":
            assert not {900_001, 900_002, 900_004} & set(ids) and ids.count(900_003) in (0, 2)


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in P.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, sf).collect(), before.schema)
        assert docs.columns == before.columns
        left, was = {r.doc_id for r in docs.collect()}, {r.doc_id: r.text for r in before.collect()}
        if name == "near_duplicates":
            assert left == {c for c, _ in brute(sorted(was.items())).values()}
        if name == "quality_classifier":
            assert sum(labels.get(i) == 1 for i in was if i not in left) <= 0.02 * len(labels)
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(x in was[i] for i in left for x in items)
    out = P.STAGES[-1][1](spark, docs, sf).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: r.n_tokens for r in out} == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    assert len(out) > 100
    assert docs.agg(F.count("*")).first()[0] == len(out)
