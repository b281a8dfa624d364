"""Operator 11 against a plain version that goes byte by byte."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from evidencelake.llm import alignment
from evidencelake.llm.alignment import align_tokens, components, link_scores, op11_alignment
from evidencelake.llm.token_files import byte_alphabet

SF = "/root/testdata/sf0.001"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "  two  spaces\n\nx", "a\tb\x1fc d", "it's <|endoftext|> x <s> </s> <unk> <0x41>", "", None, " lead", "trail ", " ", "\n", "日本語　x", "é é ﬁ", "▁under▁score", "😀👩‍👩‍👧",
    "\x00﻿ab​", "word " * 5000, " " * 3000, "x" * 20_000, "same text", "same text", "\U000105c0 \U0001e030new letters",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILES[0])
    t.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=FILES[1])
    of = {c: i for i, c in enumerate(byte_alphabet())}
    a_bytes = {i: bytes(of.get(c, 0) for c in name) for name, i in t.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def cut(text):
        """``[(id, first byte, end)]`` of both sides, or nothing."""
        if not text:
            return [], []
        sides = []
        for ids, of_id in ((t.encode(" " + text, add_special_tokens=False).ids, a_bytes.get), (b.encode(text), piece)):
            at, side, data = 0, [], b""
            for i in ids:
                data += of_id(i)
                side.append((i, at, len(data)))
                at = len(data)
            if data != (" " + text).encode():
                return [], []
            sides.append(side)
        return tuple(sides)

    return cut


def plain(rows, cut):
    """The contract's columns for ``[(doc_id, text)]``, in their order."""
    seen, links = [], Counter()
    for _, text in rows:
        a, b = cut(text)
        own, j = [], 0
        for i, x, y in a:
            while j < len(b) and b[j][2] <= x:
                j += 1
            k = j
            while k < len(b) and b[k][1] < y:
                own.append((i, b[k][0]))
                k += 1
        both = sorted({y for *_, y in a} & {y for *_, y in b})
        groups = [[[], []] for _ in both]
        for side, tokens in enumerate((a, b)):
            g = 0
            for i, _, y in tokens:
                groups[g][side].append(i)
                g += y == both[g]
        text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        links.update(own)
        seen.append((len(a), len(b), len(groups), own, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return [(d, na, nb, ng, len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), sha) for (d, _), (na, nb, ng, own, sha) in zip(rows, seen)]


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def test_whole_table(spark, library):
    got = sorted(tuple(r) for r in op11_alignment(spark, SF).select(*COLUMNS).collect())
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert got == plain(rows, library)


@pytest.mark.parametrize("limit", [alignment.MAX_BROADCAST_PAIRS, 5])
def test_odd_texts_and_pairs_by_join(spark, library, monkeypatch, limit):
    monkeypatch.setattr(alignment, "MAX_BROADCAST_PAIRS", limit)
    monkeypatch.setattr("evidencelake.scratch.HOT_ROWS", 3)
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame([(i, t, "mine", 7) for i, t in rows], "doc_id long, text string, n_a string, extra int")
    out = link_scores(align_tokens(docs, *FILES, ids=False))
    assert "extra" in out.columns and out.columns.count("n_a") == 1
    assert sorted(tuple(r) for r in out.select(*COLUMNS).collect()) == plain(rows, library)


def test_real_outputs(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in align_tokens(docs, *FILES).collect():
        a, b = library(r.text)
        assert r.a_ids == [i for i, *_ in a] and r.b_ids == [i for i, *_ in b]
        ends = sorted({y for *_, y in a} & {y for *_, y in b})
        assert r.a_group == [int(np.searchsorted(ends, y)) for *_, y in a] and r.b_group == [int(np.searchsorted(ends, y)) for *_, y in b]


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert link_scores(align_tokens(empty, *FILES)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    out = link_scores(align_tokens(rows, *FILES)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_groups, r.count_sum) for r in out] == [(None, 2, 4), (None, 2, 4), (3, 0, 0)]


def test_pointer_doubling():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 200)
        a, b = (np.array(sorted(set(rng.sample(range(1, n + 1), rng.randint(0, n - 1) if n > 1 else 0)) | {n})) for _ in range(2))
        common = np.intersect1d(a, b)
        g_a, g_b = components(a, b)
        assert np.array_equal(g_a, np.searchsorted(common, a)) and np.array_equal(g_b, np.searchsorted(common, b))
    n = 100_000  # one long chain: ends never meet but at the end
    a, b = np.append(np.arange(1, n, 2), n + 1), np.append(np.arange(2, n, 2), n + 1)
    g_a, g_b = components(a, b)
    assert not g_a.any() and not g_b.any()
    assert [len(x) for x in components(np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]
