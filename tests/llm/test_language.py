"""Operator 6: profiles against a plain count, distances, held-out accuracy."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from evidencelake.llm import language_id as L


def plain_ngrams(text):
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in s:
        s = s.replace("  ", " ")
    return Counter([c for c in s if c != " "] + [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2)])


def decode(code):
    parts = [code >> 42 & 0x1FFFFF, code >> 21 & 0x1FFFFF, code & 0x1FFFFF]
    return "".join(chr(p) for p in parts if p)


def test_ngrams_equal_a_plain_count():
    for text in ("Hello, wörld 12 x", "ab", "日本語 テスト"):
        assert Counter(decode(int(c)) for c in L.ngrams(text)) == plain_ngrams(text)
    assert len(L.ngrams(None)) == len(L.ngrams("")) == len(L.ngrams("12 !")) == 0


def test_profiles_and_predictions(spark):
    rows = [(1, "the cat and the hat and the bat", "en"), (2, "der hund und der mund und der bund", "de"), (3, "the den", None), (4, None, "en"), (5, "123", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = L.language_profiles(docs, 20)
    en = [decode(r.gram) for r in profiles.where("lang = 'en'").orderBy("place").collect()]
    count = plain_ngrams(rows[0][1])
    assert [count[g] for g in en] == sorted(count.values(), reverse=True)[:20]
    out = {r.doc_id: r for r in L.predict(docs.withColumn("score", F.lit("x")), profiles, 20).collect()}
    assert [out[i].lang_pred for i in range(1, 6)] == ["en", "de", "en", "und", "und"]
    assert out[4].score == 0 and all(0 <= r.score <= 1 for r in out.values())
    assert {r.lang_pred for r in L.predict(docs, profiles.limit(0)).collect()} == {"und"}
    assert L.predict(docs.limit(0), profiles).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = L.op6_language_id(spark, sf).join(docs, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def nearest(text, profiles, length):
    """Language and score by the definition of the out-of-place distance."""
    count = plain_ngrams(text or "")
    own = sorted((g for g in count if g.strip()), key=lambda g: (-count[g], sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))))[:length]
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    far = sorted((sum(abs(p[g] - at) if g in p else length for at, g in enumerate(own)), lang) for lang, p in profiles.items())
    return far[0][1], far[1][0] / (far[0][0] + far[1][0])


def test_predictions_of_the_whole_table_equal_plain_distances(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    profiles = L.language_profiles(docs.where(~L.held_out())).cache()
    plain = {}
    for r in profiles.collect():
        plain.setdefault(r.lang, {})[decode(r.gram)] = r.place
    want = {r.doc_id: nearest(r.text, plain, L.PROFILE) for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.op6_language_id(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-12, i
    monkeypatch.setattr(L, "MAX_PROFILE_ROWS", 0)  # more languages than a task can hold
    more = docs.union(spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12", None)], docs.schema))
    joined = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(more, profiles).collect()}
    assert {i: joined.pop(i) for i in (-1, -2, -3)} == dict.fromkeys((-1, -2, -3), ("und", 0.0))
    assert all(joined[i][0] == got[i][0] and abs(joined[i][1] - got[i][1]) < 1e-12 for i in got) and len(joined) == len(got)
