import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folio.llm import mixing, sharding


def documents(spark, n=3000):
    rows = [(i, None if i % 97 == 0 else "word " * (1 + i * 7919 % 200), f"s{i % 5}" if i % 11 else None) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).repartition(4)


def test_shards_are_even_and_gapless(spark):
    out = sharding.shard(documents(spark), 8).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() < 0.01 * sums.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    r = out[out.doc_id == 3].iloc[0]
    text = "word " * (1 + 3 * 7919 % 200)
    assert (r["size"], r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text.encode()), "bytes")
    assert (out[out.doc_id == 97]["size"] == 1).all() and (out[out.doc_id == 97].text_crc32 == 0).all()


def test_one_id_in_a_third_of_the_rows(spark):
    rows = documents(spark).select(F.when(F.col("doc_id") % 3 == 0, F.lit(7)).otherwise(F.col("doc_id")).alias("doc_id"), "text")
    out = sharding.shard(rows, 8).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(out) == 3000 and sums.max() - sums.min() < 0.05 * sums.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


def test_maps_are_stored_and_edited(spark, tmp_path):
    first = sharding.initial_map(4, 64)
    load = [i * i for i in range(64)]
    second = sharding.rebalance(first, load)
    assert second.version == 2 and 0 < len(second.moved) < 64
    sharding.store(spark, second, str(tmp_path))
    assert [r.shard for r in spark.read.parquet(f"{tmp_path}/version=2").orderBy("unit").collect()] == list(second.shard_of)


def test_shard_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    whole, capped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in capped]
        pool, share = whole - sum(capped.values()), sum(weight[s] for s in left)
        over = [s for s in left if pool * weight[s] / share > 3 * sizes[s]]
        if not over:
            return capped | {s: pool * weight[s] / share for s in left}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix(spark):
    docs = documents(spark).filter("source is null or source <> 's1' or doc_id < 60")
    out = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = lambda df: sorted(zip(df.doc_id, df.copies, strict=True))
    assert key(out) == key(again) and len(out) == docs.count()
    sizes = {s if isinstance(s, str) else None: int(g["size"].sum()) for s, g in out.groupby("source", dropna=False)}
    want = brute_targets(sizes)
    for s, g in out.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 * want[s]
        assert abs((g.copies * g["size"]).sum() - want[s]) <= g["size"].max() / 2 + 1e-6
    assert out.copies.between(0, 3).all() and (out[out["size"] == 0].copies == 0).all()


def test_meeting_is_fair():
    rng = np.random.default_rng(1)
    part, size = np.array([0.2, 0.5, 0.7, 0.4]), np.array([3.0, 1.0, 2.0, 5.0])
    total = np.zeros(4)
    for _ in range(4000):
        got, held = mixing.meet(part, size, rng)
        assert sum(0 < p < 1 for p in got) <= 1 and abs((got * size).sum() - (part * size).sum()) < 1e-9
        total += got
    assert np.abs(total / 4000 - part).max() < 0.05


def test_take(spark):
    docs = documents(spark).drop("size")
    docs = docs.union(docs.filter("doc_id = 5"))
    got = Counter(r.doc_id for r in mixing.take(docs).collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    assert got == +want and mixing.take(docs).columns == docs.columns


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
