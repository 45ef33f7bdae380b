"""Mixing sources to target weights by pivotal rounding.

A source's target is its weight's share of all words, at most ``most`` times its own size; what a capped source
leaves is shared again by weight. Each document of a source may be taken target / size times; the whole part is
taken, and the fractions are rounded by the pivotal method: two fractional documents meet, one passes words to
the other at random (fair in expectation) until one of them is integral, and the other goes on. So a source's
words are kept at each meeting; only its last document is rounded to the nearer side.

The meetings form a tree: documents of one size class (a power of two) fall into ``buckets`` by a hash of source, id, size
and a number that tells equal ones apart, each bucket leaves one fractional document a source and class, and these meet again, ``fan_in`` buckets at a
time. At the root the few that are left of all classes meet, the largest first: each is settled against smaller ones, so
that the very last is small. Documents over a sixteenth of their source are settled before all others, which then
share what is left of the target. A source, or an id, with a third of all rows is so spread over all buckets. Only (source,
id, size) is shuffled, counted before, never a text. Random numbers depend on source, bucket and level alone, and documents meet
in a fixed order, so that reruns agree, however the rows are partitioned.

Nulls: a null text has size 0; the null source is a source, ranked last; a null id is an id. Repeated rows
are documents each; of rows with one id, source and size it is not said which is taken how often. Documents of size 0 are
not taken; a very long text is a size like any other. Documents of equal size meet in order of a hash. An empty table gives no rows. Other columns are ignored by ``mix`` and carried along by ``take``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import free_name, materialize, n_words, scratch_dir, table

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS, FAN_IN = 256, 16
#: A document over the LARGE-th part of its source is settled before the others; a source has fewer than LARGE of them.
LARGE = 16
SEED = 29
#: Up to so many sources their table is broadcast (about 100 bytes a row); beyond, it is joined by shuffle.
SMALL_SOURCES = 50_000
#: Up to so many rows of (row number, copies), about 50 bytes each, are broadcast.
SMALL_ROWS = 500_000
#: Equal rows that one task numbers at once.
REPEATS = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    The level L solves sum(min(most * size, L * weight)) = all words. It starts as if no source were capped and
    rises as capped sources are found; each step is one aggregate over the sources."""
    spark = sizes.sparkSession
    # code points rank as UTF-8 bytes do; ranks come from range partitions and their counts, not from one sorted task
    keyed = sizes.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id())
    keyed = materialize(keyed, f"{scratch_dir(spark)}/sources")
    before, seen = {}, 0
    for r in keyed.groupBy("part").count().orderBy("part").collect():  # one row per partition
        before[r.part], seen = seen, seen + r["count"]
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in before.items() for x in kv)), F.col("part")) if before else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1 + offset
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    rows = keyed.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * most
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = cap <= F.lit(level) * F.col("weight")
        full, left = rows.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        new = (whole - full) / left if left else level
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def meet(part: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Pivotal rounding of fractions in one group, in the given order: the new fractions, all 0 or 1 but at most one, and its place or -1."""
    part = part.tolist()
    size = size.tolist()
    chance = rng.random(len(part)).tolist()
    held = -1
    for i, q in enumerate(part):
        if not 0 < q < 1:
            continue
        if held < 0:
            held = i
            continue
        p, w, v = part[held], size[held], size[i]
        up, down = min(w * (1 - p), v * q), min(w * p, v * (1 - q))  # words that the held one may gain or lose
        gain = chance[i] * (up + down) < down
        moved = up if gain else down
        held_done = moved == (w * (1 - p) if gain else w * p)
        other_done = moved == (v * q if gain else v * (1 - q))
        if gain:
            p, q = (1.0 if held_done else p + moved / w), (0.0 if other_done else q - moved / v)
        else:
            p, q = (0.0 if held_done else p - moved / w), (1.0 if other_done else q + moved / v)
        part[held], part[i] = p, q
        if held_done:
            held = -1 if other_done else i
    return np.array(part, float), held


def _round_groups(level: int):
    """Arrow rows sorted by (source, group, ...) to the same rows with ``part`` rounded; ``open`` marks a group's last fraction.

    A group is worked through as a stream: what is held is one document and the current batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rng, waiting = None, None, None  # waiting: the fractional row of the group so far
        for b in batches:
            names = b.schema.names
            rows = b.to_pydict()
            out = {n: [] for n in names}

            def put(row: tuple, part: float, is_open: bool, out=out, names=names) -> None:
                for n, x in zip(names, row, strict=True):
                    out[n].append(part if n == "part" else is_open if n == "open" else x)

            p_at = names.index("part")
            s_at = names.index("size")
            columns = [rows[n] for n in names]
            groups = list(zip(rows["source"], rows["group"], strict=True))
            start = 0
            while start < len(groups):
                stop = start
                while stop < len(groups) and groups[stop] == groups[start]:
                    stop += 1
                if groups[start] != key:
                    if waiting is not None:
                        put(waiting, waiting[p_at], True)
                    key, waiting = groups[start], None
                    name = (key[0] or "").encode() if isinstance(key[0], str) or key[0] is None else str(key[0]).encode()
                    rng = np.random.default_rng([SEED, level + 1, key[1], int(key[0] is None), *name])
                some = list(zip(*(c[start:stop] for c in columns), strict=True))
                if waiting is not None:
                    some.insert(0, waiting)
                part, held = meet(np.array([r[p_at] for r in some], float), np.array([r[s_at] for r in some], float), rng)
                for i, r in enumerate(some):
                    if i != held:
                        put(r, float(part[i]), False)
                waiting = tuple(float(part[held]) if n == "part" else x for n, x in zip(names, some[held], strict=True)) if held >= 0 else None
                start = stop
            yield pa.RecordBatch.from_pydict(out, schema=b.schema)
            schema = b.schema
        if waiting is not None:
            last = {n: [waiting[p_at] if n == "part" else True if n == "open" else x] for n, x in zip(names, waiting, strict=True)}
            yield pa.RecordBatch.from_pydict(last, schema=schema)

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, buckets: int = BUCKETS, fan_in: int = FAN_IN) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    return _mix(sized, weights, most, buckets, fan_in).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies")


def _numbered(counted: DataFrame) -> DataFrame:
    """(id, source, size, n) to n rows each, with ``nth`` from 0; a large n is dealt in blocks of ``REPEATS`` first."""
    last = lambda block: F.least(F.col("n"), (block + 1) * REPEATS) - 1
    one = F.lit(0).cast("long")
    few = counted.filter(F.col("n") <= REPEATS).withColumn("nth", F.explode(F.sequence(one, last(one))))
    many = counted.filter(F.col("n") > REPEATS).withColumn("block", F.explode(F.sequence(one, F.floor((F.col("n") - 1) / REPEATS))))
    many = many.repartition("id", "source", "size", "block").withColumn("nth", F.explode(F.sequence(F.col("block") * REPEATS, last(F.col("block")))))
    return few.unionByName(many.drop("block")).drop("n")


def _mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, buckets: int = BUCKETS, fan_in: int = FAN_IN) -> DataFrame:
    """(id, source, size, nth, source_size, target, copies) from (id, source, size); ``nth`` numbers equal rows from 0."""
    spark = sized.sparkSession
    base = scratch_dir(spark)
    counted = materialize(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), f"{base}/sizes")
    wanted = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    wanted = materialize(wanted, f"{base}/targets")
    wanted = F.broadcast(wanted) if wanted.count() <= SMALL_SOURCES else wanted.hint("merge")
    rows = _numbered(counted).join(wanted.withColumnRenamed("source", "same"), F.col("source").eqNullSafe(F.col("same"))).drop("same")
    rows = rows.withColumns({"group": F.lit(0), "open": F.lit(False)})

    def shared(df: DataFrame, words: F.Column, over: F.Column) -> DataFrame:
        """Whole copies and the fraction left, for documents that share ``words`` in proportion to their sizes."""
        rate = F.when((over > 0) & (F.col("size") > 0), F.least(F.greatest(words / over, F.lit(0.0)), F.lit(float(most)))).otherwise(0.0)
        return df.withColumn("rate", rate).withColumn("copies", F.floor("rate").cast("int")).withColumn("part", F.col("rate") - F.col("copies")).drop("rate")

    # the few documents that are a large part of their source are settled first; the others share what these leave of the target
    large = F.col("size") * LARGE > F.col("source_size")
    first = shared(rows.filter(large), F.col("target"), F.col("source_size"))
    first = first.repartition("source").sortWithinPartitions("source", F.desc("size"), "id", "nth")
    first = materialize(first.mapInArrow(_round_groups(-1), first.schema).withColumn("part", F.round("part")), f"{base}/large")
    took = first.groupBy(F.col("source").alias("same")).agg(F.sum((F.col("copies") + F.col("part")) * F.col("size")).alias("took"), F.sum("size").alias("held"))
    took = materialize(took, f"{base}/took")
    took = F.broadcast(took) if took.count() <= SMALL_SOURCES else took.hint("merge")
    rows = rows.filter(~large).join(took, F.col("source").eqNullSafe(F.col("same")), "left").na.fill(0, ["took", "held"])
    rows = shared(rows, F.col("target") - F.col("took"), F.col("source_size") - F.col("held")).drop("same", "took", "held")
    size_class = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(0)  # under 64
    rows = rows.withColumns({"group": (F.pmod(F.xxhash64("source", "id", "size", "nth"), F.lit(buckets)) * 64 + size_class).cast("int"), "open": F.lit(False)})
    done, level, groups = [first], 0, buckets
    while True:
        # larger documents meet first, so that what is left at the end is small
        ordered = rows.repartition("source", "group").sortWithinPartitions("source", "group", F.desc("size"), "id", "nth")
        rounded = materialize(ordered.mapInArrow(_round_groups(level), ordered.schema), f"{base}/level={level}")
        done.append(rounded.filter(~F.col("open")))
        rows = rounded.filter("open")
        if groups == 1:
            break
        groups, level = max(1, groups // fan_in), level + 1
        merged = F.pmod(F.floor(F.col("group") / 64), F.lit(groups)) * 64 + F.col("group") % 64 if groups > 1 else F.lit(0)
        rows = rows.withColumns({"group": merged.cast("int"), "open": F.lit(False)})
    out = rows.withColumn("part", F.round("part"))
    for d in done:
        out = out.unionByName(d)
    return out.select("id", "source", "size", "nth", "source_size", "target", (F.col("copies") + F.col("part")).cast("int").alias("copies"))


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed rows themselves, each repeated as often as it is taken; their columns stay as they are."""
    row = free_name(docs.columns, "row")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    sized = materialize(keyed.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")))
    mixed = materialize(_mix(sized.select("id", "source", "size")))
    # rows of one id, source and size are numbered within their partition, and partitions follow each other
    keys = ["id", "source", "size"]
    sized = sized.withColumn("part", F.shiftright("row", 33))
    within = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("row")) - 1
    before = sized.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = before.select(*(F.col(k).alias(f"_{k}") for k in (*keys, "part")), start.alias("start"))
    same = lambda names: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names]
    placed = sized.withColumn("within", within).join(before.hint("shuffle_merge"), same([*keys, "part"])).select("row", *keys, (F.col("within") + F.col("start")).alias("nth"))
    mixed = mixed.filter(F.col("copies") > 0).select(*(F.col(k).alias(f"_{k}") for k in (*keys, "nth")), "copies")
    taken = materialize(placed.join(mixed.hint("shuffle_merge"), same([*keys, "nth"])).select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("copies")).alias(free_name([*docs.columns, row], "times"))))
    times = taken.columns[1]
    taken = F.broadcast(taken) if taken.count() <= SMALL_ROWS else taken.hint("shuffle_merge")
    return keyed.join(taken, row).withColumn(times, F.explode(times)).select(docs.columns)


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op5_pivotal_mix": op5_pivotal_mix}
ORACLE_SQL: dict[str, str] = {}
