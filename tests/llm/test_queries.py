"""Every query of the subpackage on a small table, against brute force; hostile columns, nulls, repeats, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import ann, chat, mixing, neardup, packing, pii, quality, sharding, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 160))) + rng.choice(["", " me@x.org", " 10.0.0.1", " 4111 1111 1111 1111", " +44 20 7946 0018"]), rng.choice(["a", "b", "c", None])) for i in range(240)]
    docs += [(300 + i, " ".join(word() + "###" for _ in range(70)), "a") for i in range(30)]
    docs += [(400, None, "a"), (401, "", None), (402, "é ß x", "b"), (403, docs[0][1], "b"), (404, " x y z" * 60, "c")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 200)] + [(300 + i, 0) for i in range(20)], "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    x = np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{base}/embeddings.parquet")
    talks = [(i % 40, i // 40, rng.choice(["user", "assistant"]), rng.choice([None, "", "<|im_end|>", "hi\nthere", word()])) for i in range(200)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{base}/conversations.parquet")
    return base, docs, x, talks


def test_op1(spark, tables):
    base, _, x, _ = tables
    out = ann.op1_prefix_forest(spark, base)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    by = {}
    for r in out.collect():
        by.setdefault(r.query_id, {})[r["rank"]] = r
    d, hits = x.astype(float), []
    assert sorted(by) == list(range(0, 3000, 100))
    for q, got in by.items():
        true = np.sqrt(((d - d[q]) ** 2).sum(1))
        assert sorted(got) == list(range(1, 11)) and all(got[k].score <= got[k + 1].score for k in range(1, 10))
        assert all(abs(true[r.vec_id] - r.score) < 1e-12 and r.vec_id != q for r in got.values())
        true[q] = np.inf
        hits.append(np.isin(np.argsort(true, kind="stable")[:10], [r.vec_id for r in got.values()]).mean())
    assert np.mean(hits) >= 0.9


def test_recall_of_64_dimensions_over_many_blocks(spark):
    x = np.random.default_rng(5).normal(size=(20_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    hits, d = [], x.astype(float)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 200 = 0"), block_rows=5000).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 20_000, 200):
        true = ((d - d[q]) ** 2).sum(1)
        true[q] = np.inf
        hits.append(np.isin(np.argsort(true, kind="stable")[:10], got[q]).mean())
    assert np.mean(hits) >= 0.9


def test_repeated_vectors_are_candidates_each(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>").withColumn("block", F.lit("clash"))
    assert [(r["rank"], r.vec_id) for r in ann.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 2)]


def test_op2(spark, tables):
    base, docs, *_ = tables
    rows = sharding.op2_virtual_slots(spark, base).collect()
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == want and len(rows) == len(docs)
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8))
    sums = [sum(r["size"] for r in g) for g in by.values()]
    assert max(sums) - min(sums) < 0.1 * np.mean(sums)
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())


def test_slot_maps_are_edited_from_run_to_run(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    first = {r.doc_id: r.shard for r in sharding.shard(rows, 8, map_path=path).collect()}
    one = sharding.load(spark, path)
    again = {r.doc_id: r.shard for r in sharding.shard(rows, 8, map_path=path).collect()}
    assert first == again and sharding.load(spark, path) == one and one.version == 2  # nothing to move, no new version
    more = rows.union(rows.filter("doc_id % 7 = 0").select((F.col("doc_id") + 10_000).alias("doc_id"), F.repeat("text", 4).alias("text")))
    grown = sharding.shard(more, 8, map_path=path).collect()
    two = sharding.load(spark, path)
    assert two.version == 3 and sum(a != b for a, b in zip(one.shard_of, two.shard_of, strict=False)) < len(one.shard_of) / 2
    sums = np.bincount([r.shard for r in grown], [r["size"] for r in grown])
    assert sums.max() - sums.min() < 0.02 * sums.mean()
    eight = sharding.load(spark, path)
    nine = sharding.shard(more, 9, map_path=path).toPandas()
    grown = sharding.load(spark, path)
    assert grown.n_shards == 9 and set(nine.shard) == set(range(9)) and grown.version == eight.version + 1
    changed = [u for u, (a, b) in enumerate(zip(eight.shard_of, grown.shard_of, strict=True)) if a != b]
    assert len(changed) < 0.15 * len(eight.shard_of) and all(grown.shard_of[u] == 8 for u in changed)
    back = sharding.shard(more, 8, map_path=path).toPandas()
    shrunk = sharding.load(spark, path)
    assert {grown.shard_of[u] for u, (a, b) in enumerate(zip(grown.shard_of, shrunk.shard_of, strict=True)) if a != b} == {8} and max(shrunk.shard_of) == 7
    for out in (nine, back):
        sums = out.groupby("shard")["size"].sum()
        assert sums.max() - sums.min() < 0.02 * sums.mean() and all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


@pytest.mark.parametrize("n", [1, 3, 7, 9, 16])
def test_maps_of_another_number_of_shards(n):
    rng = random.Random(n)
    load = [rng.choice([0, 5, 50, 400]) for _ in range(4096)]
    eight = sharding.rebalance(sharding.initial_map(8), load)
    out = sharding.resize(eight, n, load)
    total = [sum(w for w, s in zip(load, out.shard_of, strict=True) if s == k) for k in range(n)]
    assert out.version == eight.version + 1 and set(out.shard_of) == set(range(n)) and max(total) - min(total) <= 0.02 * sum(total) / n
    if n > 8:
        assert all(out.shard_of[u] >= 8 for u in out.moved) and len(out.moved) <= 1.2 * len(load) * (n - 8) / n
    else:
        assert all(eight.shard_of[u] >= n for u in out.moved)


def test_empty_texts_under_one_id_are_spread(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 != 0, F.repeat(F.lit("x"), 500)).alias("text"))
    out = sharding.shard(rows, 8).toPandas()
    assert out[out.doc_id == 7].groupby("shard").size().max() < 0.5 * 10_000
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])


def test_op3(spark, tables):
    base, _, _, talks = tables
    got = {r.conv_id: r for r in chat.op3_offset_masks(spark, base).collect()}
    both = "<|im_end|><|im_start|>assistant ok"
    convs = {-1: [("user", both), ("assistant", both)]}
    for c, t, role, text in sorted(talks, key=lambda r: (r[0], r[1])):
        convs.setdefault(c, []).append((role, text or ""))
    assert sorted(got) == sorted(convs)
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    for c, turns in convs.items():
        said = [x for r, x in turns if r == "assistant"]
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), sha(f"{r}\n{x}\n" for r, x in turns), sum(map(len, said)), sha(said))


def test_a_very_long_turn(spark):
    text = "word <|im_end|> " * 100_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.format_chats(df)).first()
    assert r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op4(spark, tables):
    base, docs, *_ = tables
    out = quality.op4_isolation_forest(spark, base)
    assert {n: dict(out.dtypes)[n] for n in ("doc_id", "n_words", "n_symbols", "base_failed", "kept")} == {"doc_id": "bigint", "n_words": "bigint", "n_symbols": "bigint", "base_failed": "boolean", "kept": "boolean"}
    got = {r.doc_id: r for r in out.collect()}
    for i, t, _ in docs:
        n = len(WORDS.findall(t or ""))
        assert got[i].n_words == n and got[i].n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert got[i].base_failed == (n < 50 or i == 404) and (not got[i].kept or not got[i].base_failed)
    sound = [i for i, t, _ in docs if i < 240 and not got[i].base_failed]
    assert not any(got[300 + i].kept for i in range(30)) and sum(got[i].kept for i in sound) >= 0.97 * len(sound)


@pytest.mark.parametrize("n_good, n_bad", [(80, 15), (30, 120), (600, 6)])
def test_forest_tells_junk_at_any_ratio(n_good, n_bad):
    for seed in range(3):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))  # noqa: B023, E731
        counts = lambda n, mark: np.array([quality.text_statistics(" ".join(word() + mark for _ in range(90))) for _ in range(n)])  # noqa: B023, E731
        good, bad = quality.features(counts(n_good + 100, "")), quality.features(counts(n_bad + 50, "#"))
        x, y = np.vstack([good[:n_good], bad[:n_bad]]), np.r_[np.ones(n_good), np.zeros(n_bad)]
        used = quality.informative(x, y)
        forest = quality.grow(good[:n_good:2][:, used], low=x[:, used].min(0), high=x[:, used].max(0))
        most = quality.calibrate(forest.score(good[1:n_good:2][:, used]), forest.score(bad[:n_bad][:, used]))
        assert (forest.score(good[n_good:][:, used]) <= most).mean() >= 0.97 and (forest.score(bad[n_bad:][:, used]) > most).mean() >= 0.97


def test_op5(spark, tables):
    base, docs, *_ = tables
    rows = mixing.op5_pivotal_mix(spark, base).collect()
    sizes = {i: len(WORDS.findall(t or "")) for i, t, _ in docs}
    assert {r.doc_id: r["size"] for r in rows} == sizes and len(rows) == len(docs)
    source = {i: s for i, _, s in docs}
    for s in {s for *_, s in docs}:
        own = [r for r in rows if source[r.doc_id] == s]
        assert {r.source_size for r in own} == {sum(r["size"] for r in own)} and len({r.target for r in own}) == 1
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
    assert all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in rows)
    assert abs(sum({source[r.doc_id]: r.target for r in rows}.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())


def test_a_repeated_id_is_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 100)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("w "), 20).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix(rows).toPandas()
    again = mixing.mix(rows.repartition(9)).toPandas()
    key = lambda df: sorted(zip(df.doc_id, df.source, df.copies, strict=True))
    assert len(out) == 3000 and key(out) == key(again)
    for _, g in out.groupby("source"):
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) <= 10


def test_op6(spark, tables):
    base, docs, *_ = tables
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.op6_array_merge_counts(spark, base).collect()}
    for i, text, _ in docs:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 512)


def test_op7(spark, tables):
    base, docs, *_ = tables
    out = pii.op7_crf_spans(spark, base)
    got = {r.doc_id: r for r in out.collect()}
    for i, text, _ in docs:
        spans = pii.base_spans(text or "")
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in spans)
        g = got[i]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert g.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= {"", *g.spans.split(",")}
        assert g.n_spans == (len(g.spans.split(",")) if g.spans else 0)


def test_recall_and_precision_of_each_kind():
    """Of spans that no pattern finds, in the forms and carriers of the labelled table, with numbers drawn anew."""
    model = pii.train()
    found, wanted, right = ({k: 0 for k in pii.KINDS} for _ in range(3))
    for marked in pii.labelled_table(77, 4):
        spans, plain, at = [], "", 0
        for m in re.finditer(r"<(\w+)>(.*?)</\1>", marked):
            plain += marked[at : m.start()]
            spans.append((m[1], len(plain), len(plain) + len(m[2])))
            plain, at = plain + m[2], m.end()
        base, every = pii.find_spans([plain + marked[at:]], model)[0]
        for k, a, z in set(every) - set(base):
            found[k] += 1
            right[k] += (k, a, z) in spans
        for k, a, z in set(spans) - set(base):
            wanted[k] += not any(s < z and a < e for _, s, e in base)  # what a pattern takes for another kind stays so
    assert all(right[k] >= 0.95 * found[k] and right[k] >= 0.9 * wanted[k] for k in pii.KINDS), (found, right, wanted)


def test_words_are_read_whole():
    """What makes a word personal data stands behind its 80th, and behind its 400th character."""
    model = pii.train()
    for size in (5, 90, 480):
        name = "".join(random.Random(size).choice("abcdefghijklmno") for _ in range(size))
        text = f"write to {name}[at]example.com soon"
        assert pii.find_spans([text], model)[0][1] == [("email", 9, 9 + size + len("[at]example.com"))], size
    assert pii.shape("a" * 100 + "[at]" + "b" * 100 + "." + "c" * 100) == "xxx[xx]xxx.xxx"


@pytest.mark.parametrize("kind, least", [("phone", 0.75), ("email", 0.9), ("ip", 0.9), ("card", 0.9)])
def test_forms_left_out_of_training_are_found(kind, least, monkeypatch):
    """One written form at a time is kept from the labelled table; most of its spans are found all the same."""
    forms, rng, found, wanted = pii.FORMS[kind], random.Random(11), 0, 0
    for form in forms:
        monkeypatch.setitem(pii.FORMS, kind, tuple(f for f in forms if f != form))
        model = pii.train(pii.labelled_table())
        for carrier in pii.CARRIERS[kind] * 2:
            span = pii._written(form, rng)
            text, at = carrier.format(span), carrier.index("{}")
            if not pii.base_spans(text):
                wanted += 1
                found += any(k == kind and s < at + len(span) and e > at for k, s, e in pii.find_spans([text], model)[0][1])
    assert found >= least * wanted, (found, wanted)


def test_numbers_with_a_wrong_check_digit_are_no_cards():
    model, rng = pii.train(), random.Random(6)
    for _ in range(200):
        bad = pii._sound(rng, 16, False)
        shown = rng.choice([bad, " ".join(bad[i : i + 4] for i in range(0, 16, 4))])
        assert pii.find_spans([f"the {shown} of"], model)[0][1] == []


@pytest.mark.parametrize("text", ["10.0.0.1 " * 111_111, "a@b.org " * 125_000, "1234 " * 200_000, "x" * 1_000_000 + " 1", "4111111111111112 " * 60_000])
def test_spans_are_linear(text):
    import time

    model = pii.Field(np.zeros((pii.DIMENSIONS, len(pii.LABELS))), np.zeros((len(pii.LABELS),) * 2))
    start = time.process_time()
    pii.find_spans([text[: len(text) // 4]], model)
    quarter = time.process_time() - start
    start = time.process_time()
    pii.find_spans([text], model)
    assert time.process_time() - start < 8 * quarter + 1


def test_op8(spark, tables):
    base, docs, *_ = tables
    got = {r.doc_id: r for r in neardup.op8_chosen_path(spark, base).collect()}
    assert got[403].component_id == 0 and not got[403].kept and got[400].n_shingles == 0 and got[400].kept and len(got) == len(docs)


def test_op10(spark, tables):
    base, docs, *_ = tables
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    by, seqs = {}, {}
    for r in packing.op10_concat_cut(spark, base).collect():
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, text, _ in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for s, rows in seqs.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or s == max(seqs)


CLASH = ("kept", "n_words", "anomaly", "base_failed", "word_chars", "base", "spans", "kind", "size", "copy", "copies", "row", "times", "nth", "id", "comp", "part")


def test_stages_leave_columns_alone(spark, tables):
    """Clashing names, nulls, one id with several texts, an empty table."""
    import corpus_pipeline

    base, docs, *_ = tables
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(80))
    extra = [(7, text(), "a"), (7, text(), None), (None, text(), "b"), (None, text(), "b"), (7, None, None)]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, source string").withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.md5("text"), F.lit(""))) for c in CLASH})
    for rows in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, base)
            assert out.columns == frame.columns, name
            rows = spark.createDataFrame(out.collect(), frame.schema)
            assert rows.filter(" or ".join(f"{c} not like '{c}:%'" for c in CLASH)).count() == 0
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, base)
        assert packed.count() >= rows.count()
    kept = corpus_pipeline.near_duplicates(spark, frame, base).collect()
    assert {r.text for r in kept if r.doc_id == 7} == {t for i, t, _ in docs + extra if i == 7} and sum(r.doc_id is None for r in kept) == 2


def test_run_is_its_stages(spark, tables):
    import corpus_pipeline

    base, docs, *_ = tables
    out = corpus_pipeline.run(spark, base)
    ids = {r.doc_id for r in out.collect()}
    assert ids and not ids & {300 + i for i in range(30)} and 404 not in ids and 403 not in ids
