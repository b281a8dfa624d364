"""Operators 8 and 9 against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidencelake.llm.prefix_bpe import PrefixBpe, bpe_round_trip, op9_prefix_bpe
from evidencelake.llm.token_files import ByteLevelEncoder, op8_token_files, open_sequences, read_token_files, sequence, write_token_files
from evidencelake.llm.wordcache import TwoGenerations

ODD = [
    "  two  Spaces\n\nx \n y", "a\tb\x1fc d", "it's WE're <|endoftext|> x<|startoftext|>", "", None, " lead", "trail ", "\n", "12 ²½ 33", "日本 語　x Ⅷ", "İSTANBUL ΟΔΟΣ ß ﬁ é É",
    "'s 'S don't...!!", "\x85a\xa0b", "_a_b__ c-d a.b,c", "\x00﻿ab ​", "word " * 30_000, "$$$. x%%%, ### |.", "plain prose, with commas. And stops.\nNext line, too.",
]


@pytest.fixture(scope="module")
def byte_file():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_file():
    return public_tokenizers.path("word_bpe_49k.json")


def test_byte_level_encoder_equals_the_library(byte_file):
    t = Tokenizer.from_file(byte_file)
    got = [np.frombuffer(x, "<u2").tolist() for x in ByteLevelEncoder(byte_file).encode(ODD)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in ODD]


def test_prefix_bpe_equals_the_library(word_file):
    t, bpe = Tokenizer.from_file(word_file), PrefixBpe(word_file)
    for text, (ids, decoded) in zip(ODD, bpe.encode(ODD)):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == t.decode(want, skip_special_tokens=False)
    rng = random.Random(1)
    for _ in range(3000):
        w = "".join(rng.choice("aeioutnrsthlxyzéüß") for _ in range(rng.randint(1, 14)))
        assert bpe.word(w) == t.encode(w, add_special_tokens=False).ids


def odd_text(rng, marks):
    """Up to 14 characters from all planes, marks and letters that normalize or lower in odd ways among them."""
    out = []
    for _ in range(rng.randint(1, 14)):
        kind = rng.random()
        if kind < 0.5:
            out.append(rng.choice("'sStrevmlLdD .,!?\t\n\r\x1c\x1f\x85\xa0İıßſΣσςKÅẞéÉ12²½Ⅷ日한각") if kind < 0.35 else rng.choice(marks))
        else:
            c = rng.choice((rng.randrange(0x80, 0x3000), rng.randrange(0xA000, 0xD800), rng.randrange(0xE000, 0x110000), 0x10000 + rng.randrange(0x4000)))
            out.append(chr(c))
    return "".join(out)


def test_both_encoders_on_all_planes(byte_file, word_file):
    rng, marks = random.Random(3), [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("Mn", "Mc")]
    texts = [odd_text(rng, marks) for _ in range(20_000)] + ["\u0558\U00024ffd", "1,\U00013ac6,l", "\U00010d54x"]
    t, bpe = Tokenizer.from_file(word_file), PrefixBpe(word_file)
    for text, (ids, decoded) in zip(texts, bpe.encode(texts)):
        want = t.encode(text, add_special_tokens=False).ids
        assert (np.frombuffer(ids, "<u4").tolist(), decoded) == (want, t.decode(want, skip_special_tokens=False)), text
    t = Tokenizer.from_file(byte_file)
    for text, ids in zip(texts, ByteLevelEncoder(byte_file).encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_prefix_bpe_emits_every_token_of_the_vocabulary(word_file):
    bpe = PrefixBpe(word_file)
    for name, i in list(Tokenizer.from_file(word_file).get_vocab().items())[::11]:
        if name.endswith("</w>"):
            raw = bytes(bpe.alphabet.index(c) for c in name[:-4])
            try:
                word = raw.decode()
            except UnicodeDecodeError:
                continue
            assert bpe.word(word) == [i]


def test_round_trip_columns(spark, word_file):
    rows = [(1, "one two", 5), (1, "one two", 5), (2, None, 6), (None, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe_round_trip(df, word_file, digests_only=True).orderBy("doc_id").collect()
    assert [r.n_tokens for r in out] == [0, 2, 2, 0]
    assert out[1] == out[2] and out[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe_round_trip(df, word_file).where("doc_id = 1").first().decoded == "one</w> two</w>"
    assert bpe_round_trip(df.limit(0), word_file).count() == 0


def test_token_files_round_trip(spark, byte_file, tmp_path):
    rng = random.Random(2)
    texts = {i: x for i, x in enumerate([*ODD, *(" ".join(rng.choice(["tion", "the", "ax."]) for _ in range(rng.randint(0, 900))) for _ in range(80))])}
    df = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, start long").repartition(5)
    uri = f"file://{tmp_path}/files"
    manifest = write_token_files(df, uri, byte_file, end_id=2, length=64)
    got = {r.doc_id: r for r in read_token_files(spark, uri, manifest).collect()}
    t, start = Tokenizer.from_file(byte_file), 0
    stream = []
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        stream += ids
    first = manifest.orderBy("part").first()
    reader = open_sequences(f"{tmp_path}/files/seq-{first.part:06d}.arrow")
    assert sequence(reader, 65)[0].tolist() == stream[65 * 64 : 66 * 64]
    n = -(-first.n_tokens // 64)
    ids, mask = sequence(reader, n - 1)
    assert mask.to_pylist() == [k < first.n_tokens - (n - 1) * 64 for k in range(64)] and len(ids) == 64


def test_token_files_of_nothing(spark, byte_file, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    uri = f"file://{tmp_path}/none"
    manifest = write_token_files(df, uri, byte_file, end_id=2)
    assert manifest.count() == 0 and read_token_files(spark, uri, manifest).count() == 0


def test_cache_is_bounded():
    cache = TwoGenerations(2000)
    for i in range(500):
        for w in cache.missing([f"w{i}", "steady", f"{i} " * 20, f"{i} " * 20]):
            cache.put(w, (w.encode(), w))
        assert len(cache.young) + len(cache.old) <= 24 and cache.held < 2600
        assert cache.young["steady"][1] == "steady" and f"{i} " * 20 in cache.young
        assert sum(len(w) > cache.LONGEST for g in (cache.young, cache.old) for w in g) <= 2


def test_whole_table_equals_the_library(spark, byte_file, word_file):
    sf, start = "/root/testdata/sf0.001", 0
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    files = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op8_token_files(spark, sf).collect()}
    bpe = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9_prefix_bpe(spark, sf).collect()}
    assert len(files) == len(bpe) == len(texts)
    byte, word = Tokenizer.from_file(byte_file), Tokenizer.from_file(word_file)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for i, text in texts:
        ids = [*byte.encode(text or "", add_special_tokens=False).ids, 2]
        assert files[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        ids = word.encode(text or "", add_special_tokens=False).ids
        assert bpe[i] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(word.decode(ids, skip_special_tokens=False).encode()))
