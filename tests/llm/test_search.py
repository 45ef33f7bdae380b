"""Nearest neighbours, near-duplicates, URL filter, pipeline."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import ann, neardup, urls


def test_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(30_000, None), (30_001, [0.0] * 16), (30_002, [float("nan")] * 16), (30_003, [1.0, None] * 8), (30_004, []), (None, x[5].tolist()), (7, x[7].tolist()), (40_000, [1.0, 2.0]), (40_100, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    out = ann.search(df, df.filter("vec_id % 100 = 0"), block_rows=4096).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append(r)
    d = x.astype(float)
    hits = []
    for q in range(0, 20_000, 100):
        got = sorted(by[q], key=lambda r: r["rank"])
        true = np.sqrt(((d - d[q]) ** 2).sum(1))
        assert [r["rank"] for r in got] == list(range(1, 11)) and all(abs(true[r.vec_id] - r.score) < 1e-12 for r in got) and q not in [r.vec_id for r in got]
        true[q] = np.inf
        best = np.lexsort((np.arange(len(true)), true))[:10]
        hits.append(np.isin(best, [r.vec_id for r in got]).mean())
    assert np.mean(hits) > 0.95
    assert [r.vec_id for r in sorted(by[0], key=lambda r: r["rank"])] == list(range(100, 110))  # ties go to the smaller id
    assert [r.vec_id for r in by[40_000]] == [40_100] and not {30_000, 30_001, 30_002} & set(by)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    base = [[word() for _ in range(60)] for _ in range(30)]
    for b in base:
        rows.append(list(b))
        for _ in range(rng.randint(0, 6)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = word()
            rows.append(c)
    big = [word() for _ in range(80)]
    for _ in range(150):  # one large group at all distances
        c = list(big)
        for _ in range(rng.randint(0, 5)):
            c[rng.randrange(len(c))] = word()
        rows.append(c)
    rows += [passage + [word() for _ in range(60)] for _ in range(120)]
    texts = [" ".join(r) for r in rows] + ["one two", "ONE\ttwo", "", None, " \n", "é É", "é é"]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def brute(rows):
    sets = {}
    for i, t in rows:
        w = neardup.words_of(t or "")
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("options", [{}, {"small": 10, "depth": 3}, {"small": 10, "depth": 0, "cluster_weight": 500}])
def test_components(spark, options):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(df, **options).collect()}
    want = brute(rows)
    assert got == want


def test_deduplicate_keeps_one_of_each(spark):
    rows = corpus(6)
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string").withColumn("source", F.lit("s"))
    got = [r.doc_id for r in neardup.deduplicate(df).collect()]
    assert sorted(got) == sorted(i for i, (_, c) in brute(rows).items() if i == c)
    assert neardup.deduplicate(df.limit(0)).count() == 0 and neardup.link(df.limit(0)).count() == 0


def test_url_parts_and_rules(spark):
    cases = {
        "https://a.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"), "http://example.org": ("example.org", "", None, None), "x://b.org/en/12#f": ("b.org", "/en/12", "org/", "allow"), "x://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"), "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "http://notcom/fr/": ("notcom", "/fr/", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "http://x.com?y=/fr/": ("x.com", "", None, None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("score", F.lit("clash"))
    host, path = urls.parts(F.col("url"))
    rule, verdict = urls.rule_of(F.col("h"), F.col("p"))
    got = df.select("page_id", host.alias("h"), path.alias("p")).select("page_id", "h", "p", rule.alias("r"), verdict.alias("v")).orderBy("page_id").collect()
    assert [(r.h, r.p, r.r, r.v) for r in got] == list(cases.values())
    out = urls.filter_urls(df).collect()
    assert len(out) == len(cases) and {r.verdict for r in out} <= {"allow", "block"}
    assert urls.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.filter_urls(df.filter("url like 'no%'")).collect()} == {"allow"}


def test_url_scores_are_linear_in_length(spark):
    df = spark.createDataFrame([(1, "http://b.org/" + "a" * 200_000), (2, "http://x.com/de/q")], "page_id long, url string")
    assert urls.filter_urls(df).count() == 2


def test_url_query_matches_its_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i % 150, f"http://{rng.choice(['www', 'm'])}.{rng.choice(['spam', 'news', 'shop'])}{i % 7}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'fr', 'de', 'es'])}/{i}") for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, urls.op9_url_language_ratio(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(urls.ORACLE_SQL["op9_url_language_ratio"]).fetchall(), key=str)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    docs = [(i, " ".join(word() for _ in range(90)) + (" me@x.org" if i % 9 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(120)]
    docs += [(500 + i, t, *rest) for i, (_, t, *rest) in enumerate(docs[:30])]
    docs += [(900 + i, " ".join(word() + "###" for _ in range(90)), "en", "s0", 0) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(900 + i, 0, 0) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == frame.columns
        kept.write.parquet(f"{tmp_path}/{len(ids)}")
        kept = spark.read.parquet(f"{tmp_path}/{len(ids)}")
        ids.append({r.doc_id for r in kept.collect()})
    assert ids[0] == {d[0] for d in docs if d[0] < 900} and ids[1] == set(range(120)) == ids[2] and ids[3] <= ids[2]
    assert kept.filter(F.contains("text", F.lit("@"))).count() == 0 and kept.filter("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert packed.agg(F.sum("length")).first()[0] > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mix sources", "pack sequences"]
