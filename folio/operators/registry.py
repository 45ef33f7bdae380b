"""Self-growing registries: bids, contracts, units. What rows say is turned into facts by key, which ``sources.keyed`` stores and merges;
``merge_registry`` groups a table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.functions.text import present
from folio.operators.reconcile import first_filled
from folio.operators.render import code_and_name
from folio.sources import keyed


def merge_registry(rows: DataFrame, key: str, order: str, seen: str, first: list[str] = (), sets: dict[str, str] | None = None, flags: list[str] = (), distinct_by: dict[str, tuple[str, str]] | None = None, sizes: dict[str, str] | None = None) -> DataFrame:
    """One row per key: first non-empty scalars in order, sorted distinct sets, raised flags, first and last use.

    ``distinct_by`` maps a name to (column of identity, shown column): of each identity the first shown value stays.
    Sets are aggregated on (key, value) first, so that a hot key is combined in parts; of ``sizes`` only the number of values is kept, as
    ``n_`` and the name, so that no task holds the members."""
    scalars = rows.groupBy(key).agg(*(first_filled(c, order).alias(c) for c in first), *(F.max(F.coalesce(F.col(f).cast("boolean"), F.lit(False))).alias(f) for f in flags), F.min(seen).alias("first_use"), F.max(seen).alias("last_use"))
    out = scalars
    for name, column in (sets or {}).items():
        values = rows.filter(F.col(column).isNotNull()).groupBy(key, column).agg(F.lit(1).alias("_one"))
        out = out.join(values.groupBy(key).agg(F.array_sort(F.collect_list(column)).alias(name)), key, "left")
    for name, column in (sizes or {}).items():
        values = rows.filter(F.col(column).isNotNull()).groupBy(key, column).agg(F.lit(1).alias("_one"))
        out = out.join(values.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}")), key, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    for name, (identity, shown) in (distinct_by or {}).items():
        values = rows.filter(F.col(identity).isNotNull()).groupBy(key, F.col(identity).alias("_id")).agg(F.min_by(shown, order).alias("_shown"), F.min(order).alias("_at"))
        pairs = F.array_sort(F.collect_list(F.struct("_at", "_id", "_shown")))
        out = out.join(values.groupBy(key).agg(F.transform(pairs, lambda p: p["_shown"]).alias(name)), key, "left")
    return out


def bid_facts(rows: DataFrame) -> DataFrame:
    """Facts of bids, by repaired number. Rows: bid, unit_code, unit_name, object, supplier, tax_id, item, proc_id, used.

    Suppliers are told apart by tax id, items by their text without regard to case, dossiers by id."""
    ready = rows.withColumns({"bid": S.bid_number(F.col("bid")), "supplier_id": S.tax_id(F.col("tax_id")), "item_id": F.upper(present(F.col("item"))), "supplier": F.concat_ws("|", "tax_id", "supplier")})
    return keyed.facts(ready, "bid", "used", ["unit_code", "unit_name", "object"], sets={"suppliers": ("supplier_id", "supplier"), "items": ("item_id", "item"), "dossiers": ("proc_id", "proc_id")})


def contract_facts(rows: DataFrame) -> DataFrame:
    """Facts of contracts, by normalised number. Rows: contract, contracted, tax_id, object, total, valid_from, valid_to, signed, proc_id, used."""
    ready = rows.withColumn("contract", S.contract_number(F.col("contract")))
    return keyed.facts(ready, "contract", "used", ["contracted", "tax_id", "object", "total", "valid_from", "valid_to"], ["signed"], {"dossiers": ("proc_id", "proc_id")})


def unit_facts(rows: DataFrame) -> DataFrame:
    """Facts of units, by code. Rows: unit_code, unit_name, used."""
    return keyed.facts(rows, "unit_code", "used", ["unit_name"])


def merge_units(rows: DataFrame, code: str = "unit_code", name: str = "unit_name", seen: str = "used") -> DataFrame:
    """Units by code: the first name, first and last use; rows without a code are not registered."""
    return merge_registry(rows.filter(present(F.col(code)).isNotNull()), code, seen, seen, [name])


def listing(registry: DataFrame, arrays: list[str], text: str, width: int = 80, unit: tuple[str, str] | None = None, validity: tuple[str, str] | None = None) -> DataFrame:
    """Registry rows with set sizes and a shortened text; ``unit`` (code, name) and ``validity`` (from, to) become one label each."""
    labels = []
    if unit:
        labels.append(code_and_name(F.col(unit[0]), F.col(unit[1])).alias("unit"))
    if validity:
        start, end = (present(F.col(c).cast("string")) for c in validity)
        labels.append(F.coalesce(F.concat(start, F.lit(" a "), end), F.concat(F.lit("até "), end), F.concat(F.lit("desde "), start), F.lit("—")).alias("validity"))
    gone = {*arrays, text, *(unit or ()), *(validity or ())}
    return registry.select(*(c for c in registry.columns if c not in gone), *labels, *(F.coalesce(F.size(a), F.lit(0)).alias(f"n_{a}") for a in arrays), F.substring(text, 1, width).alias(text))
