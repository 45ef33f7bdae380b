import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import packing, tokens

TEXTS = ["", None, "Hello  world\n\n x", "word " * 3000, "<|endoftext|>a<|endoftext|>", "é ß 漢字 🎉\t\x85\x1cend", "a" * 500, " lead and trail ", "it's we'll\nNew line. The end", "\n", " "]
COUNT, PACK = (Tokenizer.from_file(public_tokenizers.path(n)) for n in (tokens.TOKENIZER, packing.TOKENIZER))
PARTS = st.lists(st.sampled_from(["a", "Word", " ", "  ", "\n", "'s", "é", "漢", "1", "...", "<|endoftext|>", "\x1c", "\xa0", "aaaa", "!", "Σ"]), max_size=14).map("".join)


@given(PARTS)
@settings(max_examples=300, deadline=None)
def test_counts_agree_with_the_library(text):
    assert tokens.merger(public_tokenizers.path(tokens.TOKENIZER)).count([text]) == [len(COUNT.encode(text, add_special_tokens=False).ids)]


@given(PARTS)
@settings(max_examples=300, deadline=None)
def test_ids_agree_with_the_library(text):
    got = packing.encoder(public_tokenizers.path(packing.TOKENIZER)).encode([text])[0]
    assert np.frombuffer(got, "<u2").tolist() == PACK.encode(text, add_special_tokens=False).ids


MARKED = st.lists(st.sampled_from(["a", "Zebra", "ÉCOLE", "ÿ", "Ÿ", "K", "İ", "$", "%", "_", "^", "`", "[", "]", "\\", "/", "-", "&", "'", "<", "|", "9", ".", " ", "\xad", "\xa0", "e\u0301", "\u0301"]), max_size=10).map("".join)


@given(MARKED)
@settings(max_examples=500, deadline=None)
def test_marked_words_agree_with_the_library(text):
    got = packing.encoder(public_tokenizers.path(packing.TOKENIZER)).encode([text])[0]
    assert np.frombuffer(got, "<u2").tolist() == PACK.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "é漢a"])
@pytest.mark.parametrize("size", [2049, 30_000])
def test_long_pretokens_agree_with_the_library(letters, size):
    text = "".join(np.random.default_rng(size).choice(list(letters), size))
    assert tokens.merger(public_tokenizers.path(tokens.TOKENIZER)).count([text]) == [len(COUNT.encode(text, add_special_tokens=False).ids)]
    got = packing.encoder(public_tokenizers.path(packing.TOKENIZER)).encode([text])[0]
    assert np.frombuffer(got, "<u2").tolist() == PACK.encode(text, add_special_tokens=False).ids


def test_a_pretoken_of_a_million_letters_is_no_square():
    text = "".join(np.random.default_rng(1).choice(list("etaoinshrdlu"), 1_000_000))
    start = time.process_time()
    tokens.merger(public_tokenizers.path(tokens.TOKENIZER)).count([text])
    assert time.process_time() - start < 30


def documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "word " * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)


def test_count_tokens(spark):
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(documents(spark)).collect())
    want = sorted((i, len((t or "").encode()), len(COUNT.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(TEXTS), (3, "word " * 3000)])
    assert got == want


@pytest.mark.parametrize("length", [7, 4096])
def test_pack(spark, length):
    rows = packing.pack(documents(spark), length=length).collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        by_sequence[r.sequence_id].append(r)
        by_document[r.doc_id].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or s == max(by_sequence)
    for i, t in enumerate(TEXTS):
        want = [*PACK.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        pieces = sorted(by_document[i], key=lambda r: (r.start, r.sequence_id, r.offset))
        assert {r.doc_tokens for r in pieces} == {len(want)}
        copies = 2 if i == 3 else 1
        assert sum(r.length for r in pieces) == copies * len(want)
        if copies == 1:
            assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0 and tokens.count_tokens(empty).count() == 0
