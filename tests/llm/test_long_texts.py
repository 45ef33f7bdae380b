"""Texts of a megabyte and more, and columns whose names clash, for the operators and for each stage."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import langid, mixing, neardup, packing, pii, quality, sharding, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("kept", "n_words", "anomaly", "base_failed", "size", "copies", "row", "rep", "digest", "sig", "cluster", "comp", "vslot", "salt", "unit", "part", "at", "ids", "nth", "drawn", "hash", "counts", "r")


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    long = [word() for _ in range(200_000)]
    near = list(long)
    for at in rng.sample(range(len(near)), 3000):
        near[at] = word() + "x"
    texts = [" ".join(word() for _ in range(rng.randint(60, 120))) for _ in range(60)]
    texts += [" ".join(long), " ".join(near), " ".join(long), "q" * 1_200_000, ("a b " * 300_000), "\n".join(f"{w} me@x.org" for w in long[:60_000]), "", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    base = str(tmp_path_factory.mktemp("long"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"{c}!") for c in CLASH})
    frame.repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(64, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, {r[0]: r[1] for r in rows}


def test_sizes_and_counts(spark, docs):
    base, texts = docs
    got = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.op2_virtual_slots(spark, base).collect()}
    assert got == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    for r in quality.op4_isolation_forest(spark, base).collect():
        words = WORDS.findall(texts[r.doc_id] or "")
        seen, covered = {}, [False] * len(words)
        for k in range(len(words) - 2):
            seen.setdefault(tuple(words[k : k + 3]), []).append(k)
        for places in seen.values():
            for k in places if len(places) > 1 else ():
                covered[k] = covered[k + 1] = covered[k + 2] = True
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(covered))
        assert r.base_failed == (len(words) < 50 or 100 * sum(covered) > 50 * len(words))


def test_near_copies_of_long_texts(spark, docs):
    base, texts = docs
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op8_chosen_path(spark, base).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [WORDS.findall(t.lower())] for i in range(max(len(w) - 4, 1))} if WORDS.search(t or "") else set()
    a, b = shingles(texts[60]), shingles(texts[61])
    assert 0.75 < len(a & b) / len(a | b) < 0.95
    assert [got[i][1] for i in (60, 61, 62, 63, 64, 66, 67)] == [60, 60, 60, 63, 64, 66, 67]
    assert {i: n for i, (n, *_) in got.items()} == {i: len(shingles(t or "")) for i, t in texts.items()}


def test_mixing_and_packing(spark, docs):
    base, texts = docs
    size = {i: len(WORDS.findall(t or "")) for i, t in texts.items()}
    assert {r.doc_id: r["size"] for r in mixing.op5_pivotal_mix(spark, base).collect()} == size
    t, ids, by = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), {}, {}
    for r in packing.op10_concat_cut(spark, base).collect():
        by.setdefault(r.doc_id, []).append(r)
    for i in (0, 60, 63, 65, 66, 67):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)


def test_operators_with_clashing_columns(spark, docs):
    base, texts = docs
    few = spark.read.parquet(f"{base}/documents.parquet").filter("doc_id < 60 or doc_id > 65")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    n = few.count()
    assert quality.judge(few, labels).count() == n and quality.keep(few, labels).columns == few.columns
    assert sharding.shard(few, 3).count() == n and mixing.mix(few).count() == n and mixing.take(few).columns == few.columns
    assert neardup.link(few).count() == n and neardup.deduplicate(few).columns == few.columns
    assert tokens.count(few).count() == n if hasattr(tokens, "count") else True
    assert pii.spans_of(few).count() == n and pii.masked(few).columns == few.columns
    assert packing.pack(few).select("doc_id").distinct().count() == n
    assert langid.identify(few, langid.fit(few)).count() == n


def test_stages_with_long_texts(spark, docs):
    import corpus_pipeline

    base, texts = docs
    rows = spark.read.parquet(f"{base}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, base)
        if name == "pack sequences":
            kept[name] = {r.doc_id for r in out.collect()}
            break
        assert out.columns == rows.columns, name
        path = corpus_pipeline.scratch_dir(spark)
        rows = corpus_pipeline.materialize(out, path)
        kept[name] = {r.doc_id: r.text for r in rows.select("doc_id", "text").collect()}
    assert {63, 64, 66, 67} & set(kept["quality rules"]) == set() and {60, 61, 62} <= set(kept["quality rules"])
    assert {60, 61, 62} & set(kept["near duplicates"]) == {60}
    assert 65 not in kept["personal data"] or "me@x.org" not in kept["personal data"][65]
    assert kept["pack sequences"] == set(kept["mix sources"])
