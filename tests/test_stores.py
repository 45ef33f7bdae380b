"""The stores that grow by batches: what is rewritten and read, crashes and repeats, any split of the input."""

import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import history
from folio.sources import keyed, store
from folio.sources.analyses import Analyses
from folio.sources.versions import Versions
from folio.streaming import incremental

SCHEMA = "k string, name string, flag boolean, member string, used int"


def rows_of(n, seed=1, keys=40):
    rng = random.Random(seed)
    return [(f"k{rng.randint(0, keys)}", rng.choice([None, "", f"n{i}"]), rng.random() < 0.1, rng.choice([None, f"m{rng.randint(0, 30)}"]), i) for i in range(n)]


def facts(spark, rows):
    return keyed.facts(spark.createDataFrame(rows, SCHEMA), "k", "used", ["name"], ["flag"], {"members": ("member", "member")})


def shown(s):
    entries = {r.k: (r.name, r.flag, r.n_members, r.first_use, r.last_use) for r in s.entries("k", ["name"], ["flag"], ["members"]).collect()}
    return entries, {r.k: r.members for r in s.members("k", "members", 1000).collect()}


def by_hand(rows):
    entries, members = {}, {}
    for k in {r[0] for r in rows if r[0]}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[4])
        first = {}
        for r in own:
            if r[3] is not None:
                first.setdefault(r[3], r[4])
        entries[k] = (next((r[1] for r in own if r[1]), None), any(r[2] for r in own), len(first), own[0][4], own[-1][4])
        if first:
            members[k] = [m for m, _ in sorted(first.items(), key=lambda x: (x[1], x[0]))]
    return entries, members


@pytest.mark.parametrize("splits", [1, 4])
def test_any_split_gives_the_same_registry(spark, tmp_path, splits):
    rows = rows_of(400) + [(None, "x", True, "m", 1), ("", "x", True, "m", 2)]
    s = keyed.Keyed(spark, f"{tmp_path}/r", buckets=8, spread=3)
    order = random.Random(5).sample(rows, len(rows))
    for i in range(splits):
        s.merge(facts(spark, order[i::splits]), i)
    assert shown(s) == by_hand(rows)


def test_a_merge_rewrites_the_touched_buckets_only_and_survives_crashes(spark, tmp_path, monkeypatch):
    rows, path = rows_of(400), f"{tmp_path}/r"
    s = keyed.Keyed(spark, path, buckets=32, spread=2)
    s.merge(facts(spark, rows), 0)
    before = s.versions.pieces()
    one = [("k7", "late", True, "new", 999)]
    commit = Versions.commit
    monkeypatch.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash before the switch")))
    with pytest.raises(RuntimeError, match="crash"):
        s.merge(facts(spark, one), 1)
    assert s.versions.pieces() == before and shown(s) == by_hand(rows)
    monkeypatch.setattr(Versions, "commit", commit)
    for _ in range(2):  # delivered again, and once more
        s.merge(facts(spark, one), 1)
        after = s.versions.pieces()
        assert shown(s) == by_hand(rows + one)
        assert 1 <= sum(after[p] != before.get(p) for p in after) <= 4  # heads and members of one key
    assert len(glob.glob(f"{path}/data/*")) == 2  # what the crash left is gone


def test_a_hot_key_is_spread_and_no_member_is_read_for_its_size(spark, tmp_path):
    s = keyed.Keyed(spark, f"{tmp_path}/r", buckets=16, spread=8)
    hot = spark.range(60_000).select(F.lit("hot").alias("k"), F.lit("n").alias("name"), F.lit(False).alias("flag"), F.col("id").cast("string").alias("member"), F.col("id").cast("int").alias("used"))
    s.merge(keyed.facts(hot, "k", "used", ["name"], ["flag"], {"members": ("member", "member")}), 0)
    assert s.entries("k", ["name"], ["flag"], ["members"]).first().n_members == 60_000
    assert all("part=set" not in f for f in s.entries("k", sets=["members"]).inputFiles())
    sizes = [r["count"] for r in s.read("set").groupBy("bucket").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 60_000 / 4
    assert s.members("k", "members", 3).first().members == ["0", "1", "2"]
    assert s.entries("k", keys=["hot"]).count() == 1 and s.read("head", ["nobody"]) in (None,) or s.read("head", ["nobody"]).count() == 0


def history_rows(spark, n=600):
    rng = random.Random(3)
    words = ["Ácme Ltda", "Beta_Gama", "100% Pura", "delta", "EPSILON", None, "é", "ab", "x\U0001f600yz"]
    rows = [(f"p{i}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=13 * i), rng.choice(["ok", "no", None]), rng.choice([None, i * 1.5]), rng.choice(words), rng.choice(words)) for i in range(n)]
    df = spark.createDataFrame(rows, "proc_id string, created timestamp, result string, total double, supplier string, unit_name string")
    return store.analysis_rows(df.withColumn("total", F.col("total").cast("decimal(18,2)")), "proc_id", "created", ["result", "total", "supplier", "unit_name"])


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    made = history_rows(spark)
    a = Analyses(spark, str(tmp_path_factory.mktemp("history")))
    number = F.substring("proc_id", 2, 9).cast("int")
    for batch in (0, 1, 1):
        a.append(made.filter(number % 2 == batch), batch)
    return a, made, number


def months(files):
    return {f.split("month=")[1].split("/")[0] for f in files}


def stats(rows):
    found = rows.groupBy("month", "result").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("t")).collect()
    return sorted((r.month, r.result or "", r.n, float(r.t)) for r in found)


def kept_stats(a):
    return sorted((r.month, r.result or "", r.n, float(r.total)) for r in a.counts().collect())


def test_history_reads_what_it_needs(spark, stored):
    a, made, _ = stored
    assert a.read().count() == 600 and kept_stats(a) == stats(made)
    newest = a.latest(100)
    assert [r.proc_id for r in newest.collect()] == [r.proc_id for r in history.latest(made, 100, "created", "analysis_id").collect()]
    assert len(months(newest.inputFiles())) <= 3 < len(months(a.read().inputFiles()))
    recent = a.period(F.lit("2024-11-20").cast("date"), 30)
    assert recent.count() == history.period(made, "created", F.lit("2024-11-20").cast("date"), 30).count() and len(months(recent.inputFiles())) <= 3
    one = made.first()
    assert a.lookup(one.analysis_id).first().proc_id == one.proc_id and a.lookup("none").count() == 0


@pytest.mark.parametrize("text", ["ácme", "ELTA", "beta_gama", "100\\%", "%", "silon%", "a_g", "ab", "\U0001f600yz", "nowhere", "é", "del%a"])
def test_search_equals_the_scan(stored, text):
    a, made, _ = stored
    ids = lambda df: sorted(r.proc_id for r in df.select("proc_id").collect())
    assert ids(a.search(text)) == ids(history.search(made, text, ("supplier", "unit_name")))
    assert ids(a.search(text, result="ok")) == ids(history.search(made, text, ("supplier", "unit_name"), result="ok"))


def test_search_opens_the_months_of_its_candidates(spark, tmp_path):
    made = history_rows(spark, 300)
    rare = made.withColumn("supplier", F.when(F.col("proc_id") == "p7", "agulha rara").otherwise("palha"))
    a = Analyses(spark, f"{tmp_path}/h")
    a.append(rare, 0)
    found = a.search("LHA RARA")
    assert [r.proc_id for r in found.collect()] == ["p7"]
    assert months(f for f in found.inputFiles() if "/rows/" in f) == {"2024-01"}


def test_deletes_touch_one_month_and_are_taken_off_the_counts(spark, tmp_path):
    made = history_rows(spark, 200)
    a = Analyses(spark, f"{tmp_path}/h")
    a.append(made, 0)
    before = a.versions.pieces()
    gone = made.filter("proc_id = 'p100'")
    assert a.delete(gone.select("analysis_id")) is True and a.delete(gone.select("analysis_id")) is False
    assert a.delete(spark.createDataFrame([("x",)], "analysis_id string")) is False
    left = made.filter("proc_id <> 'p100'")
    assert a.read().count() == 199 and kept_stats(a) == stats(left)
    month = gone.first().month
    assert {p: f for p, f in a.versions.pieces().items() if p.startswith("rows/")} == {p: f for p, f in before.items() if p.startswith("rows/")}
    assert a.fold() == [month] and a.fold() == []
    after = a.versions.pieces()
    assert {p.split("/")[1] for p in before if p.startswith("rows/") and after.get(p) != before[p]} == {f"month={month}"}
    assert a.read().count() == 199 and kept_stats(a) == stats(left)
    a.append(made, 0)  # the batch comes again after the fold
    assert a.read().count() == 199
    assert a.search("delta").count() == history.search(left, "delta", ("supplier", "unit_name")).count()


def test_an_empty_history(spark, tmp_path):
    a = Analyses(spark, f"{tmp_path}/h")
    assert a.read() is None and a.latest(5) is None and a.counts().collect() == [] and a.delete(spark.createDataFrame([("x",)], "analysis_id string")) is False
    a.append(history_rows(spark, 3).limit(0), 0)
    assert a.read() is None and a.counts().collect() == []


def test_pages_wait_until_their_dossier_is_whole(spark, tmp_path):
    got = []
    work = incremental.whole(f"{tmp_path}/w", lambda df, n: got.append((n, sorted((r.proc_id, r.page_no, r.text) for r in df.collect()))), limit=datetime.timedelta(days=2))
    day = lambda n: datetime.datetime(2026, 2, n)

    def send(batch, *pages):
        got.clear()
        work(spark.createDataFrame(list(pages), "proc_id string, page_no int, text string, n_pages int, arrived timestamp"), batch)
        return list(got)

    assert send(0, ("A", 1, "a1", 2, day(1)), ("B", 1, "b1", None, day(1)), ("C", 1, "c1", 1, day(1)), (None, 1, "x", 1, day(1))) == [(0, [("C", 1, "c1")])]
    assert send(1, ("A", 1, "late copy", 2, day(2))) == []
    done = [(2, [("A", 1, "a1"), ("A", 2, "a2")])]
    assert send(2, ("A", 2, "a2", None, day(2)), ("C", 2, "late", None, day(2))) == done  # C was handed on already
    assert send(2, ("A", 2, "a2", None, day(2)), ("C", 2, "late", None, day(2))) == done  # the batch comes again
    assert send(3, ("D", 1, "d1", 5, day(4))) == [(3, [("B", 1, "b1")])]  # B never says how many it has: time is up
    assert send(4) == []
    assert os.path.exists(f"{tmp_path}/w/versions")


def test_postings_name_rows_shortly_and_older_ones_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i:064d}", f"2026-0{i % 3 + 1}-01", f"2026-0{i % 3 + 1}", "ok", f"Acme {i}") for i in range(30)], "analysis_id string, created string, month string, result string, supplier string")
    kept = Analyses(spark, f"{tmp_path}/h", searched=("supplier",))
    kept.append(rows.limit(20), 0)
    held = [f for p, f in kept.versions.pieces().items() if p.startswith("grams/")]
    assert dict(kept.versions.read(held).dtypes)["row"] == "int" and "analysis_id" not in kept.versions.read(held).columns
    old = kept._postings(kept.read()).join(kept.read().select("analysis_id", F.hash("analysis_id").alias("row")), "row").drop("row")
    assert old.count() > 0
    old.write.parquet(f"{tmp_path}/h/data/older/grams")  # as a batch left them before
    kept.versions.commit({p: ("data/older/grams" if p.startswith("grams/") else f) for p, f in kept.versions.pieces().items()})
    kept.append(rows.exceptAll(rows.limit(20)), 1)
    assert sorted(r.supplier for r in kept.search("ACME 1").collect()) == sorted(f"Acme {i}" for i in [1, *range(10, 20)])
    assert [r.supplier for r in kept.search("acme 2_").orderBy("supplier").collect()] == [f"Acme {i}" for i in range(20, 30)]


def test_a_fold_leaves_few_small_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 16).select(F.sha2(F.col("id").cast("string"), 256).alias("analysis_id"), F.lit("2026-01-01").alias("created"), F.format_string("2026-%02d", F.col("id") % 4 + 1).alias("month"), F.lit("ok").alias("result"), F.lit("Acme").alias("supplier"))
    kept = Analyses(spark, f"{tmp_path}/h")
    kept.append(rows, 0)
    kept.delete(rows.filter("analysis_id < '1'").select("analysis_id"))
    assert len(kept.fold()) == 4
    files = [f for m in kept.versions.pieces().items() if m[0].startswith("rows/") for f in glob.glob(f"{tmp_path}/h/{m[1]}/*.parquet")]
    assert len(files) == 4 and max(map(os.path.getsize, files)) < 300_000  # a filter of fixed size alone takes a megabyte
    one = kept.read().first()
    assert kept.lookup(one.analysis_id).count() == 1
