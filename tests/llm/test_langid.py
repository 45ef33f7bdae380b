"""Language identification: held-out accuracy, hostile texts, and margins against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import langid

SYLLABLES = {"en": "the and ing tion wh th sh ed er ly ou".split(), "de": "der und ung keit sch ei ch ge ver ß ö".split(), "fr": "le que tion eau oi é ai ment les ç ou".split(), "es": "el que ción mente ll ñ ó los ado ie ar".split(), "xx": "zzo qua bwa kli mro".split()}


def prose(lang, rng, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("languages"))
    rng = random.Random(2)
    rows = [(i, prose(lang, rng, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choice("en en en de fr es xx".split()) for _ in range(1500))]
    rows += [(2000, None, "en"), (2001, "", "de"), (2002, "1234 -- ###", "fr"), (2003, rows[0][1], None), (None, rows[1][1], rows[1][2]), (7, rows[7][1].upper() + "!!", rows[7][2])]
    rows += [(2004, prose("fr", rng, 250_000), "fr"), (2005, "ung" * 500_000, "de")]
    extra = {c: F.lit("clash") for c in ("id", "n", "nth", "drawn", "held_out", "lang_pred", "score", "places")}
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(extra).repartition(4).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_held_out_accuracy_and_defined_cases(spark, base):
    path, rows = base
    out = langid.op11_language_families(spark, path)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r for r in got}
    known = {i: lang for i, _, lang in rows if i is not None and i < 1500}
    ok = [by[i].lang_pred == lang for i, lang in known.items() if by[i].held_out]
    assert len(ok) > 250 and np.mean(ok) > 0.97
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (2000, 2001, 2002))
    assert by[2003].lang_pred == by[0].lang_pred and by[2004].lang_pred == "fr" and by[2005].lang_pred == "de"


def test_predictions_do_not_look_at_labels(spark, base):
    """Languages, ids and sources of rows that are judged change nothing."""
    path, _ = base
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out("doc_id")))
    some = docs.filter("doc_id < 200").select("doc_id", "text", "lang")
    first = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(some, model).collect()}
    other = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(some.withColumn("lang", F.lit("xx")).repartition(3), model).collect()}
    assert all(first[i][0] == other[i][0] and abs(first[i][1] - other[i][1]) < 1e-9 for i in first)


def test_sample_is_bounded_and_reaches_rare_languages(spark, base):
    """One text makes up most rows of one language; every language has its share of the sample all the same."""
    path, _ = base
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang")
    hot = spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("the thing").alias("text"), F.lit("en").alias("lang"))
    model = langid.fit(docs.filter("doc_id < 1500").union(hot), max_fit=100)
    assert model.families == ["=xx", "germanic", "romance"] and model.within["romance"] == ["es", "fr"]
    assert len(model.weights) == 3 + 1 + 1


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, langid.fit(docs)).collect()] == [("und", 0.0)] * 2
    one = spark.createDataFrame([(1, "words", "en"), (2, "!", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(one, langid.fit(one)).collect()} == {1: ("en", 1.0), 2: ("und", 0.0)}
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).collect() == []


def symbols(text):
    return "".join(" ".join(["", *"".join(c if c.isalpha() else " " for c in text).split(), ""])) if any(c.isalpha() for c in text) else " "


def test_margins_by_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé ß.\n\U00010400") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", " ", "a", "..", "ab" * 40]
    weights = np.random.default_rng(0).normal(size=(2, langid.WIDTH)).astype(np.float32)
    plain, some = langid.margins(texts, weights)
    for piece in (1_000_000, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        for i, t in enumerate(texts):
            s = symbols(t)
            assert some[i] == (len(s) > 1) and "".join(map(chr, langid._whole(t))) == s
            runs = list(langid._runs(np.array([ord(c) for c in s], np.uint32)))
            want = sum((weights[:, r].mean(1) for r in runs if len(r)), np.zeros(2)) if some[i] else np.zeros(2)
            assert np.allclose(plain[i], want, atol=1e-5) and np.allclose(langid.margins([t], weights)[0][0], want, atol=1e-5)


def test_unlisted_languages_are_families_of_their_own():
    assert langid.family_of("pt-BR") == langid.family_of("es") == "romance" and langid.family_of("en_GB") == "germanic" and langid.family_of("klingon") == "=klingon"
