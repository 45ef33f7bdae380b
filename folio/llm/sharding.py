"""Sharding by fixed virtual slots.

Records hash into ``n_slots`` fixed slots, bytes are summed per slot, and a versioned slot-to-shard map
says where each slot lives. Version 1 deals the slots in equal ranges; rebalancing edits the newest version, moving
slots from the fullest to the emptiest shard until the bytes are near equal, and stores the next one. With a
``map_path`` the versions stay there, and a later run starts from the newest, whatever its number of shards: a shard that is new takes
slots from the fullest ones, the slots of a shard that goes are dealt to the emptiest, and only slots that must move do.
Only DataFrame functions touch the rows; the driver sees one total per slot.

Very long texts are sizes and checksums like any other. Within a slot rows are numbered by id, size and checksum; rows that are equal in all three
take their numbers in any order.

Nulls: a null text has 0 bytes (size 1) and checksum 0; a null id is hashed like any other. Repeated rows
are separate records. An empty table gives no rows. A slot that alone holds more than ``1 / (hot_parts *
n_shards)`` of the bytes or of the rows (one id repeated in a third of all rows, say) is split into ``salts`` sub-slots,
by a number that the written digest of the rows holds. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import materialize, scratch_dir, table

N_SLOTS = 4096
SALTS = 64


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[unit]`` for every slot, then for every sub-slot of the split slots; ``hot`` names these, in order."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    hot: tuple[int, ...] = ()
    moved: tuple[int, ...] = field(default=(), compare=False)


def initial_map(n_shards: int, n_slots: int = N_SLOTS, hot: tuple[int, ...] = (), salts: int = SALTS) -> SlotMap:
    units = n_slots + len(hot) * salts
    return SlotMap(1, n_shards, tuple([i * n_shards // n_slots for i in range(n_slots)] + [i % n_shards for i in range(units - n_slots)]), hot)


def rebalance(slot_map: SlotMap, load: list[int], movable: set[int] | None = None, into: range | None = None) -> SlotMap:
    """The next version of the map: moves one slot at a time from the fullest to the emptiest shard, the one
    nearest to half their difference, while that brings the two closer. Works on slot totals only. With ``movable`` other slots stay;
    with ``into`` other shards take none."""
    shard_of = list(slot_map.shard_of)
    total = [0] * slot_map.n_shards
    members: list[set[int]] = [set() for _ in total]
    for unit, shard in enumerate(shard_of):
        total[shard] += load[unit]
        if load[unit] and (movable is None or unit in movable):
            members[shard].add(unit)
    moved = []
    for _ in range(len(shard_of)):
        full, empty = max(range(len(total)), key=lambda s: (total[s], -s)), min(into or range(len(total)), key=lambda s: (total[s], s))
        gap = total[full] - total[empty]
        fits = [u for u in members[full] if load[u] < gap]
        if not fits:
            break
        unit = min(fits, key=lambda u: (abs(2 * load[u] - gap), u))
        members[full].discard(unit)
        members[empty].add(unit)
        total[full] -= load[unit]
        total[empty] += load[unit]
        shard_of[unit] = empty
        moved.append(unit)
    return replace(slot_map, version=slot_map.version + 1, shard_of=tuple(shard_of), moved=tuple(moved))


#: Totals of shards that differ by no more than this share of their mean are near equal.
NEAR = 0.02


def resize(slot_map: SlotMap, n_shards: int, load: list[int]) -> SlotMap:
    """The next version for another number of shards. New shards are filled from the fullest ones; the slots of shards that go, largest
    first, are dealt to the emptiest, and others move only if the totals are not near equal then."""
    shard_of = list(slot_map.shard_of)
    total = [0] * n_shards
    for unit, shard in enumerate(shard_of):
        if shard < n_shards:
            total[shard] += load[unit]
    homeless = [unit for unit, shard in enumerate(shard_of) if shard >= n_shards]
    for unit in sorted(homeless, key=lambda u: (-load[u], u)):
        shard_of[unit] = min(range(n_shards), key=lambda s: (total[s], s))
        total[shard_of[unit]] += load[unit]
    dealt = replace(slot_map, n_shards=n_shards, shard_of=tuple(shard_of))
    out = rebalance(dealt, load, set(homeless)) if homeless else rebalance(dealt, load, into=range(slot_map.n_shards, n_shards))
    total = [0] * n_shards
    for unit, shard in enumerate(out.shard_of):
        total[shard] += load[unit]
    if (max(total) - min(total)) * n_shards > NEAR * sum(total):
        out = replace(rebalance(out, load), version=out.version)
    return replace(out, moved=tuple(u for u, (a, b) in enumerate(zip(slot_map.shard_of, out.shard_of, strict=True)) if a != b))


def store(spark: SparkSession, slot_map: SlotMap, path: str, n_slots: int = N_SLOTS, salts: int = SALTS) -> str:
    """Writes one version of the map as a table (unit, slot, salt, n_shards, shard) below ``path``; a version is never changed later."""
    rows = spark.range(1).select(F.posexplode(_ints(slot_map.shard_of)).alias("unit", "shard"))
    nth = F.floor((F.col("unit") - n_slots) / salts).cast("int")
    split = F.col("unit") >= n_slots
    rows = rows.select("unit", F.when(split, F.try_element_at(_ints(slot_map.hot), nth + 1)).otherwise(F.col("unit")).alias("slot"), F.when(split, (F.col("unit") - n_slots) % salts).alias("salt"), F.lit(slot_map.n_shards).alias("n_shards"), "shard")
    out = f"{path}/version={slot_map.version}"
    rows.coalesce(1).write.parquet(out)
    return out


def load(spark: SparkSession, path: str) -> SlotMap | None:
    """The newest complete version stored below ``path``, or None."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    versions = [int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if not versions:
        return None
    rows = spark.read.parquet(f"{path}/version={max(versions)}").orderBy("unit").collect()  # a row for each slot and sub-slot
    return SlotMap(max(versions), rows[0].n_shards, tuple(r.shard for r in rows), tuple(r.slot for r in rows if r.salt == 0))


def widen(slot_map: SlotMap, hot: list[int], salts: int = SALTS) -> SlotMap:
    """The map with further slots split; their sub-slots start where the slot was."""
    new = [s for s in hot if s not in slot_map.hot]
    more = tuple((slot_map.shard_of[s] + i) % slot_map.n_shards for s in new for i in range(salts))
    return replace(slot_map, shard_of=slot_map.shard_of + more, hot=slot_map.hot + tuple(new))


def _ints(values, kind: str = "int") -> Column:
    """An array literal from one string literal; it is folded once, at planning."""
    if not len(values):
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, salts: int = SALTS) -> DataFrame:
    """One narrow row per record: id, size, checksum, slot, and the salt that is used only if its slot must be split."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(id_col), F.lit(n_slots)).cast("int").alias("vslot"),
        F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"),
    )


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, salts: int = SALTS, hot_parts: int = 20, map_path: str | None = None) -> DataFrame:
    """Every record with its shard and its gapless position there (``slot``); law ``bytes``.

    The texts are read once and never shuffled. The position is a number within the record's virtual slot
    plus the rows of the shard's earlier slots, so no task sorts a whole shard."""
    spark = docs.sparkSession
    rows = materialize(digest(docs, id_col, text_col, n_slots, salts))
    sums = [F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")]
    load_of, count = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("vslot").agg(*sums).collect():  # n_slots rows at most
        load_of[r.vslot], count[r.vslot] = r.b, r.n
    most_bytes, most_rows = (sum(of) / (hot_parts * n_shards) for of in (load_of, count))
    hot = [s for s in range(n_slots) if count[s] > 1 and (load_of[s] > most_bytes or count[s] > most_rows)]  # fewer than 2 * hot_parts * n_shards
    stored = load(spark, map_path) if map_path else None
    first = widen(stored or initial_map(n_shards, n_slots), hot, salts)
    hot = first.hot
    if hot:
        load_of += [0] * (len(hot) * salts)
        count += [0] * (len(hot) * salts)
        at = {s: n_slots + i * salts for i, s in enumerate(hot)}
        for r in rows.filter(F.col("vslot").isin(*hot)).groupBy("vslot", "salt").agg(*sums).collect():
            load_of[at[r.vslot] + r.salt], count[at[r.vslot] + r.salt] = r.b, r.n
        for s in hot:
            load_of[s] = count[s] = 0
    slot_map = rebalance(first, load_of) if first.n_shards == n_shards else resize(first, n_shards, load_of)
    path = map_path or scratch_dir(spark)
    if not stored:
        store(spark, initial_map(n_shards, n_slots), path, n_slots, salts)
    if not stored or slot_map.shard_of != stored.shard_of or slot_map.n_shards != stored.n_shards:
        store(spark, slot_map, path, n_slots, salts)
    start, filled = [0] * len(count), [0] * n_shards
    for unit, s in enumerate(slot_map.shard_of):
        start[unit], filled[s] = filled[s], filled[s] + count[unit]
    unit = F.col("vslot")
    if hot:
        place = [-1] * n_slots
        for i, s in enumerate(hot):
            place[s] = i
        nth = F.element_at(_ints(place), F.col("vslot") + 1)
        unit = F.when(nth < 0, F.col("vslot")).otherwise(n_slots + nth * salts + F.col("salt"))
    rows = rows.withColumn("unit", unit.cast("int"))
    order = Window.partitionBy("unit").orderBy(id_col, "size", "text_crc32")
    return rows.select(
        id_col, "size", "text_crc32",
        F.lit("bytes").alias("law"),
        F.element_at(_ints(slot_map.shard_of), F.col("unit") + 1).alias("shard"),
        (F.row_number().over(order) - 1 + F.element_at(_ints(start, "bigint"), F.col("unit") + 1)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot"),
    )


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op2_virtual_slots": op2_virtual_slots}
ORACLE_SQL: dict[str, str] = {}
