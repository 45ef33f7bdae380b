"""Registries that grow by batches: facts by key, in hash buckets that are rewritten only where a batch touches them.

A registry is a table of facts (key, kind, member, shown, first_use, last_use). A kind is ``use`` (the key was seen),
``field:x`` (the first value of a field that is not empty), ``flag:x`` (raised once) or ``set:x`` (one row for each member of a set).
Facts with equal key, kind and member merge into one: the first shown value, the first and the last use. That is the same
in any order and however often, so any split of the rows over batches, repeated batches included, gives the same registry.

A key's facts lie in the bucket of its hash; members of its sets are spread over ``spread`` buckets, so that a key with a million
dossiers is rows like any other, in no single file and in no array. Each bucket keeps the size of its part of each set beside the
fields: a listing adds these up and reads no member.

A merge reads and writes the touched buckets only; a version names the folder of each (``versions``). The version of a batch is
built on the newest one before it, so that a batch that comes again after a crash gives the same. Rows without a key are not
registered; a null member or an empty value is none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import present
from folio.sources.store import remove
from folio.sources.versions import Versions

COLUMNS = ("key", "kind", "member", "shown", "first_use", "last_use")


def facts(rows: DataFrame, key: str, used: str, fields: Sequence[str] = (), flags: Sequence[str] = (), sets: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Facts of rows; ``sets`` maps a name to (column of identity, shown column)."""
    text = lambda c: F.col(c).cast("string")
    one = lambda kind, member, shown, there: F.when(there, F.struct(F.lit(kind).alias("kind"), member.alias("member"), shown.alias("shown")))
    none = F.lit(None).cast("string")
    made = [one("use", F.lit(""), none, F.lit(True))]
    made += [one(f"field:{c}", F.lit(""), text(c), present(text(c)).isNotNull()) for c in fields]
    made += [one(f"flag:{c}", F.lit(""), none, F.coalesce(F.col(c).cast("boolean"), F.lit(False))) for c in flags]
    made += [one(f"set:{n}", text(identity), text(shown), text(identity).isNotNull()) for n, (identity, shown) in (sets or {}).items()]
    held = rows.filter(present(text(key)).isNotNull()).select(text(key).alias("key"), F.explode(F.array_compact(F.array(*made))).alias("f"), F.col(used).alias("first_use"))
    return held.select("key", "f.kind", "f.member", "f.shown", "first_use", F.col("first_use").alias("last_use"))


def merged(rows: DataFrame) -> DataFrame:
    """Facts that are equal in key, kind and member, as one; combined before the shuffle."""
    order = F.struct("first_use", "shown")
    return rows.groupBy("key", "kind", "member").agg(F.min_by("shown", order).alias("shown"), F.min("first_use").alias("first_use"), F.max("last_use").alias("last_use"))


class Keyed:
    """A registry below a path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, spread: int = 8, keep: int = 3) -> None:
        self.spark, self.versions, self.buckets, self.spread = spark, Versions(spark, path, keep), buckets, spread

    def bucket(self) -> Column:
        salt = F.when(F.col("kind").startswith("set:"), F.pmod(F.xxhash64("member"), F.lit(self.spread))).otherwise(0)
        return F.pmod(F.pmod(F.xxhash64("key"), F.lit(self.buckets)) + salt, F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Merges a batch of facts; the version of the batch is its id."""
        v, work = self.versions, f"{self.versions.path}/work/batch={batch_id}"
        before = v.pieces(batch_id)
        if before.get("buckets", str(self.buckets)) != str(self.buckets):
            raise ValueError(f"the registry has {before['buckets']} buckets")
        merged(batch).withColumn("bucket", self.bucket()).write.mode("overwrite").parquet(work)
        arrived = self.spark.read.parquet(work)
        touched = {r.bucket for r in arrived.select("bucket").distinct().collect()}  # one row a bucket
        old = v.read([f for p, f in before.items() if p != "buckets" and int(p.split("=")[-1]) in touched])
        rows = arrived
        if old is not None:
            rows = rows.unionByName(old.filter(~F.col("kind").startswith("size:")).select(*COLUMNS, "bucket"))
        part = F.when(F.col("kind").startswith("set:"), "set").otherwise("head")
        new, folder = merged(rows).withColumn("bucket", self.bucket()).withColumn("part", part), v.folder()
        # a bucket with many members is written by several tasks, many small ones by one
        new.hint("rebalance", "part", "bucket").write.partitionBy("part", "bucket").parquet(f"{v.path}/{folder}")
        made = v.parts_of(folder, 2)
        sets = v.read([f"{folder}/{p}" for p in made if p.startswith("part=set/")])
        if sets is not None:
            size = sets.groupBy("bucket", "key", F.concat(F.lit("size:"), F.substring("kind", 5, 1000)).alias("kind")).agg(F.count(F.lit(1)).cast("string").alias("shown"), F.min("first_use").alias("first_use"), F.max("last_use").alias("last_use"))
            size = size.select("key", "kind", F.col("bucket").cast("string").alias("member"), "shown", "first_use", "last_use", F.lit("head").alias("part"), "bucket")
            size.write.mode("append").partitionBy("part", "bucket").parquet(f"{v.path}/{folder}")
        v.commit(before | {p: f"{folder}/{p}" for p in v.parts_of(folder, 2)} | {"buckets": str(self.buckets)}, batch_id)
        remove(self.spark, work)

    def read(self, part: str, keys: Sequence[str] | None = None) -> DataFrame | None:
        """Facts of the newest version: ``head`` or ``set``; for some keys only their buckets are read."""
        pieces = {p: f for p, f in self.versions.pieces().items() if p.startswith(f"part={part}/")}
        if keys is not None:
            own = self.spark.createDataFrame([(k,) for k in keys], "key string").select(F.pmod(F.xxhash64("key"), F.lit(self.buckets)).alias("b"))
            near = {(r.b + s) % self.buckets for r in own.collect() for s in range(self.spread)}
            pieces = {p: f for p, f in pieces.items() if int(p.split("=")[-1]) in near}
        rows = self.versions.read(sorted(pieces.values()))
        return rows if rows is None or keys is None else rows.filter(F.col("key").isin(*keys))

    def entries(self, name: str, fields: Sequence[str] = (), flags: Sequence[str] = (), sets: Sequence[str] = (), keys: Sequence[str] | None = None) -> DataFrame | None:
        """A row for each key: fields, flags, sizes of the sets (``n_x``), first and last use; no member is read."""
        rows = self.read("head", keys)
        if rows is None:
            return None
        of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
        return rows.groupBy(F.col("key").alias(name)).agg(
            *(of(f"field:{c}", F.col("shown")).alias(c) for c in fields), *(F.coalesce(of(f"flag:{c}", F.lit(True)), F.lit(False)).alias(c) for c in flags),
            *(F.coalesce(F.sum(F.when(F.col("kind") == f"size:{s}", F.col("shown").cast("long"))), F.lit(0)).alias(f"n_{s}") for s in sets),
            of("use", F.col("first_use")).alias("first_use"), of("use", F.col("last_use")).alias("last_use"),
        )

    def members(self, name: str, set_name: str, most: int, keys: Sequence[str] | None = None) -> DataFrame | None:
        """(key, members): the first ``most`` members of a set by first use, then by name; more are never gathered."""
        rows = self.read("set", keys)
        if rows is None:
            return None
        nth = F.row_number().over(Window.partitionBy("key").orderBy("first_use", "member"))
        few = rows.filter(F.col("kind") == f"set:{set_name}").withColumn("nth", nth).filter(F.col("nth") <= most)
        return few.groupBy(F.col("key").alias(name)).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "shown"))), lambda m: m["shown"]).alias(set_name))


def merge_into(path: str, make: Callable[[DataFrame], DataFrame], **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: facts that ``make`` gives for a batch, merged into the registry."""

    def run(batch: DataFrame, batch_id: int) -> None:
        Keyed(batch.sparkSession, path, **options).merge(make(batch), batch_id)

    return run
