"""Filling gaps and merging records across the documents of a dossier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.functions.text import find, matches, present


def first_filled(column: str, order: str) -> Column:
    """The first value, in order, that is neither null nor an empty string."""
    c = F.col(column)
    return F.min_by(c, F.when(c.isNotNull() & (c.cast("string") != ""), F.col(order)))


def merge_records(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One record per key with the first non-empty value of each column; rows with a null in the last key stay as they are. One pass: these
    rows are groups of their own."""
    own = F.when(F.col(keys[-1]).isNull(), F.monotonically_increasing_id())
    return rows.withColumn("_own", own).groupBy(*keys, "_own").agg(*(first_filled(c, order).alias(c) for c in columns)).drop("_own")


def fill(left: Column, right: Column) -> Column:
    """The left value unless it is null or empty."""
    return F.coalesce(F.nullif(left, F.lit("")), F.nullif(right, F.lit("")))


#: Up to so many rows a dimension is broadcast; a longer one is joined by shuffle.
MOST_BROADCAST = 100_000


def dimension(rows: DataFrame) -> DataFrame:
    """A look-up table with the join strategy that its size allows; it is counted for that."""
    return F.broadcast(rows) if rows.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else rows.hint("shuffle_merge")


def with_fallback(rows: DataFrame, dim: DataFrame, exact: Sequence[str], generic_key: str, generic_value, value: str, name: str) -> DataFrame:
    """Looks a value up by all keys, else with ``generic_key`` set to its generic value."""
    first = dim.select(*exact, F.col(value).alias("_exact"))
    rest = [k for k in exact if k != generic_key]
    second = dim.filter(F.col(generic_key) == generic_value).select(*rest, F.col(value).alias("_generic"))
    out = rows.join(dimension(first), list(exact), "left").join(dimension(second), rest, "left")
    return out.withColumn(name, F.coalesce("_exact", "_generic")).drop("_exact", "_generic")


#: Up to so many aliases each distinct name is held against all of them; more are found by their grams.
FEW_ALIASES = 256


def _contained(inner: DataFrame, outer: DataFrame, size: int = 3) -> DataFrame:
    """(inner, outer): pairs of distinct texts of which one contains the other.

    A text lies in another only if each of its grams does. So every inner text is looked up by one gram, that which the fewest outer
    texts have, and what meets is tested; shorter texts are their own gram. Tables of rows (inner) and (outer)."""
    gram = lambda t, n: F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    short = F.least(F.char_length("inner"), F.lit(size))
    sizes = range(1, size + 1)
    own = inner.select("inner", F.explode(F.coalesce(*(F.when(short == n, gram(F.col("inner"), n)) for n in sizes))).alias("gram"))
    held = outer.select("outer", F.explode(F.flatten(F.array(*(gram(F.col("outer"), n) for n in sizes)))).alias("gram"))
    common = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = own.join(common.hint("shuffle_hash"), "gram").groupBy("inner").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rare.join(held.hint("shuffle_hash"), "gram").filter(F.contains("outer", F.col("inner"))).select("inner", "outer")


def alias_lookup(names: DataFrame, name: str, aliases: DataFrame, default: Column, out: str = "acronym", exact_first: bool = False) -> DataFrame:
    """The acronym of the first alias (by priority) contained in a name, or containing it; else ``default``.

    ``aliases(priority, alias, acronym)`` is a dimension; it is counted. Each distinct name meets a few aliases one by one; many are
    joined by their grams, both ways, so that a dimension that has grown costs no nested loop."""
    up = F.upper(F.trim(F.col(name)))
    distinct = names.select(F.col(name).alias("_name"), up.alias("_up")).filter((F.col("_up") != "")).distinct()
    known = aliases.select("priority", F.upper("alias").alias("_alias"), "acronym").filter(F.col("_alias") != "")
    if known.limit(FEW_ALIASES + 1).count() <= FEW_ALIASES:
        met = distinct.join(F.broadcast(known), F.contains(F.col("_up"), F.col("_alias")) | F.contains(F.col("_alias"), F.col("_up")))  # FEW_ALIASES rows at most
    else:
        texts, keys = distinct.select("_up").distinct(), known.select("_alias").distinct()
        within = _contained(keys.select(F.col("_alias").alias("inner")), texts.select(F.col("_up").alias("outer"))).select(F.col("outer").alias("_up"), F.col("inner").alias("_alias"))
        around = _contained(texts.select(F.col("_up").alias("inner")), keys.select(F.col("_alias").alias("outer"))).select(F.col("inner").alias("_up"), F.col("outer").alias("_alias"))
        pairs = within.unionByName(around)
        met = distinct.join(pairs.hint("shuffle_hash"), "_up").join(known.hint("shuffle_hash"), "_alias")
    rank = F.struct(F.when(F.col("_up") == F.col("_alias"), 0).otherwise(1 if exact_first else 0), F.col("priority"))
    found = met.groupBy("_name").agg(F.min_by("acronym", rank).alias("_acronym")).hint("shuffle_merge")
    return names.join(found, F.col(name) == F.col("_name"), "left").withColumn(out, F.coalesce("_acronym", default)).drop("_name", "_acronym")


def issuer_acronym(names: DataFrame, name: str, aliases: DataFrame, out: str = "acronym") -> DataFrame:
    """As ``alias_lookup``, without a leading do/da/de; else the acronym in parentheses, else the first 30 characters."""
    plain = F.regexp_replace(F.upper(F.trim(F.col(name))), r"\A(DO|DA|DE)\s+", "")
    rows = names.withColumn("_plain", plain)
    default = F.coalesce(find(F.col("_plain"), r"\(([A-Z]{2,10})\)", flags="(?d)"), F.substring("_plain", 1, 30))
    return alias_lookup(rows, "_plain", aliases, default, out).drop("_plain")


def official_name(rows: DataFrame, name: str, dim: DataFrame, out: str, title: bool = False) -> DataFrame:
    """The official name of a spelling, from ``dim(alias, official)``; else the name itself, optionally in title case."""
    key = F.upper(F.regexp_replace(F.trim(F.col(name)), r"\s+", " "))
    small = dim.select(F.col("alias").alias("_alias"), F.col("official").alias("_official"))
    own = F.initcap(F.col(name)) if title else F.col(name)
    return rows.join(dimension(small), key == F.col("_alias"), "left").withColumn(out, F.coalesce("_official", own)).drop("_alias", "_official")


def resolve(candidates: Sequence[tuple[str, Column]], valid: str = r"\A\d{6}\z") -> Column:
    """struct(value, source): the first candidate that is valid, and where it came from."""
    value = source = None
    for name, c in candidates:
        c = F.trim(c)
        good = F.regexp_like(c, F.lit(valid))
        value = F.when(good, c) if value is None else value.when(good, c)
        source = F.when(good, F.lit(name)) if source is None else source.when(good, F.lit(name))
    return F.struct(value.alias("value"), source.alias("source"))


def complete_notes(notes: DataFrame, requisitions: DataFrame, as_of: Column, key: str = "proc_id") -> DataFrame:
    """Credit notes with gaps filled from the dossier's requisition; "N DIAS" counts from the issue date; a missing balance is the total."""
    columns = ("nd", "ptres", "fonte", "ugr", "pi")
    side = requisitions.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    rows = notes.join(side, key, "left")
    rows = rows.withColumns({c: fill(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))
    relative = find(F.col("deadline"), r"\A(\d+)\s*DIAS?").try_cast("int")
    due = F.coalesce(S.flexible_date(F.col("deadline")), F.date_add(S.flexible_date(F.col("issue_date")), relative))
    rows = rows.withColumns({"due": due, "days_left": S.days_left(due, as_of)})
    return rows.withColumn("balance", F.coalesce("balance", "total")) if "balance" in rows.columns and "total" in rows.columns else rows


def complete_notes_from_mirror(notes: DataFrame, pages: DataFrame, key: str = "proc_id") -> DataFrame:
    """Nulls of every credit note of a dossier are filled from its machine-read copies."""
    from folio.operators.fields import is_mirror, mirror_fields
    from folio.operators.texts import joined_text

    text = joined_text(pages.filter((F.col("source") == "ocr") & is_mirror(F.col("text"))), [key], "page_no", blank="\n")
    side = text.select(key, *(c.alias(f"_{n}") for n, c in mirror_fields(F.col("text")).items()))
    rows = notes.join(side, key, "left")
    columns = [c[1:] for c in side.columns if c.startswith("_")]
    rows = rows.withColumns({c: fill(F.col(c) if c in notes.columns else F.lit(None).cast("string"), F.col(f"_{c}")) for c in columns})
    return rows.drop(*(f"_{c}" for c in columns))


def complete_supplier(ident: DataFrame, sicaf: DataFrame, key: str = "proc_id") -> DataFrame:
    side = sicaf.select(key, F.col("tax_id").alias("_tax_id"), F.col("name").alias("_name"))
    return ident.join(side, key, "left").withColumns({"tax_id": fill(F.col("tax_id"), F.col("_tax_id")), "supplier": fill(F.col("supplier"), F.col("_name"))}).drop("_tax_id", "_name")


#: Fields that the cover gives first, and those that the requisition overwrites (fixed values).
COVER_FIRST = ("nup", "unit_name", "sector", "commitment_type", "supplier", "tax_id")
REQUISITION_FIRST = ("number", "unit_code", "nc", "nc_date", "nc_issuer", "nd", "pi", "ptres", "ugr", "fonte", "bid", "contract", "participation", "inspector", "own_template", "bid_details")


def merge_identification(cover: DataFrame, requisition: DataFrame, key: str = "proc_id") -> DataFrame:
    """One identification row per dossier, with instrument text and type derived."""
    r = requisition.select(key, *(F.col(c).alias(f"_{c}") for c in requisition.columns if c != key))
    rows = cover.join(r, key, "full")
    have, other = set(cover.columns), {c[1:] for c in r.columns if c.startswith("_")}
    pick = {}
    for c in COVER_FIRST:
        if c in other:
            pick[c] = fill(F.col(c), F.col(f"_{c}")) if c in have else F.col(f"_{c}")
    for c in REQUISITION_FIRST:
        if c in other:
            pick[c] = F.coalesce(F.col(f"_{c}"), F.col(c)) if c in have else F.col(f"_{c}")
    if "subject" in other:
        pick["object"] = present(F.col("_subject"))
    rows = rows.withColumns(pick).drop(*(c for c in r.columns if c.startswith("_")))
    part = F.when(present(F.col("participation")).isNotNull(), F.concat(F.lit(" ("), F.col("participation"), F.lit(")"))).otherwise("")
    return rows.withColumns({
        "instrument": F.when(F.col("contract").isNotNull(), F.concat(F.lit("Contrato "), F.col("contract"))).when(F.col("bid").isNotNull(), F.concat(F.lit("PE "), F.col("bid"), part)),
        "type": F.when(F.col("contract").isNotNull(), "Contrato").when(F.col("bid").isNotNull(), "Licitação"),
    })


def unit_from_cover(origin: Column, interested: Column) -> Column:
    """The cover's origin; the interested party only if that is empty; either must look like a unit."""
    from folio.operators.fields import UNIT_LIKE

    pick = F.coalesce(present(origin), present(interested))
    return F.when(matches(pick, UNIT_LIKE), pick)


def fill_item_codes(items: DataFrame, ident: DataFrame, key: str = "proc_id") -> DataFrame:
    side = ident.select(key, F.col("nd").alias("_nd"))
    return items.join(side, key, "left").withColumn("nd_si", F.coalesce("nd_si", S.element_item(F.col("_nd")))).drop("_nd")


def matching_line(notes: DataFrame, lines: DataFrame, wanted: DataFrame, keys: Sequence[str], code: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Notes with the first line whose code is the wanted one; ``divergent`` where lines exist but none fits; all codes listed."""
    key = keys[0]
    rows = lines.join(wanted.select(key, F.col(code).alias("_wanted")).hint("shuffle_merge"), key)
    plain = lambda c: F.replace(c, F.lit("."), F.lit(""))
    fits = plain(F.col(code)) == plain(F.col("_wanted"))
    at = F.when(fits, F.col(order))
    best = rows.groupBy(*keys).agg(*(F.min_by(c, at).alias(f"_{c}") for c in columns), F.bool_or(fits).alias("_fits"), F.array_join(F.array_sort(F.collect_set(code)), ", ").alias("codes"), F.count_distinct(code).alias("n_codes"))
    out = notes.join(best.hint("shuffle_merge"), list(keys), "left")
    out = out.withColumns({c: F.when(F.coalesce("_fits", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c) if c in notes.columns else F.lit(None)) for c in columns})
    return out.withColumn("divergent", F.coalesce(~F.col("_fits"), F.lit(False))).drop("_fits", *(f"_{c}" for c in columns))


def fallback_rows(rows: DataFrame, parents: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """The rows, and for each parent without any one row made of its own columns."""
    lone = parents.join(rows.select(key).distinct(), key, "left_anti").select(key, *(c.alias(n) for n, c in defaults.items()))
    return rows.select(key, *defaults).withColumn("fallback", F.lit(False)).unionByName(lone.withColumn("fallback", F.lit(True)))


def closest_order(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")
