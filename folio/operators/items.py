"""Item tables: header rows, column maps, rows to items, machine-read texts to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.functions.text import cascade, filled, find, find_all, find_distinct, matches, once, squeeze

#: Column names by the header cell's text, tried in this order (fixed values).
HEADER_CELLS = {
    "item": r"\bITEM\b|\bÍTEM\b", "code": r"CATMAT|CATSERV|C[ÓO]D", "description": "DESCRI", "unit": r"\bUND\b|\bUN\b|UNID", "qty": r"\bQTD\b|\bQUANT\b", "nd_si": r"\bND\b.*S\.?I\.?|\bND\s*/\s*S",
    "unit_price": r"P[.\s]*UNT|UNIT[ÁA]RIO|V[.\s]*UNIT", "total": r"P[\s]*TOTAL|V[.\s]*TOTAL",
}
#: Column kinds by the shape of a data cell (fixed values).
CELL_SHAPES = {"price": r"R\$", "code": r"\A[134]\d{4,5}\z", "nd_si": r"\A(\d{2}\.\d{2}\.\d{2}\.\d{2}|\d{2}\.\d{2})\z", "unit": r"(?i)\A(und|un|kg|cx|unid|pc|mt|m|l|par)\z", "number": r"\A\d{1,4}\z", "text": r"(?s)\A(?=.*[^\d .]).{16,}\z"}


def clean_cell(cell: Column) -> Column:
    return F.trim(F.translate(F.coalesce(cell, F.lit("")), "\n", " "))


def is_header(cells: Column) -> Column:
    """A row that names the item column and one more."""
    text = F.upper(F.array_join(F.array_compact(cells), " "))
    other = F.lit(False)
    for word in ("QTD", "UND", "UNT", "TOTAL", "ND", "DESCRI"):
        other = other | F.contains(text, F.lit(word))
    return F.coalesce(F.contains(text, F.lit("TEM")) & other, F.lit(False))


def kind_of(cell: Column, kinds: dict[str, str]) -> Column:
    """The first kind whose pattern fits the cell; null if none does."""
    out = None
    for k, p in kinds.items():
        hit = F.regexp_like(cell, F.lit(f"(?dU){p}"))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


def header_kinds(cells: Column, kinds: dict[str, str] | None = None) -> Column:
    """The column name of each header cell, or null."""
    return F.transform(cells, lambda c: kind_of(F.upper(clean_cell(c)), kinds or HEADER_CELLS))


def cell_kinds(cells: Column) -> Column:
    """The kind of each data cell by its shape, or null."""
    return F.transform(cells, lambda c: kind_of(clean_cell(c), CELL_SHAPES))


def column_map(named: Column) -> Column:
    """Map of column name to 1-based index, the first cell of each kind, from the kinds of a header's cells."""
    names = F.array_distinct(F.array_compact(named))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_position(named, n).cast("int")))


#: Which cell of which kind is which column: prices by order (first unit, then total), the first small number is the item, the next the quantity.
SHAPED = (("item", "number", 1), ("qty", "number", 2), ("code", "code", 1), ("nd_si", "nd_si", 1), ("unit", "unit", 1), ("description", "text", 1), ("unit_price", "price", 1), ("total", "price", 2))
#: A table without header needs so many columns to be told by shape.
LEAST_COLUMNS = 3


def shape_map(named: Column) -> Column:
    """Column map guessed from the kinds of a data row's cells; null if it has fewer than ``LEAST_COLUMNS``."""
    at = lambda kind, nth: F.try_element_at(F.filter(F.transform(named, lambda n, i: F.when(n == kind, i + 1)), lambda i: i.isNotNull()), F.lit(nth)).cast("int")
    pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("k"), at(kind, nth).alias("v")) for n, kind, nth in SHAPED)), lambda p: p["v"].isNotNull())
    return F.map_from_entries(pairs)


def usable_shape(cells: Column) -> Column:
    """Whether a row can be the first of a table without header: a number first, a price, a long text."""
    first = clean_cell(F.try_element_at(cells, F.lit(1)))
    return matches(first, r"\A\d{1,5}\z", "(?d)") & F.exists(cells, lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit("R$"))) & F.exists(cells, lambda c: F.length(clean_cell(c)) > 15)


def continues_map(cells: Column, known: Column) -> Column:
    """Whether a first row goes on under known places: it reaches the item column, and its item cell is a small number, or some cell is an amount."""
    at = F.get(known, F.lit(list(HEADER_CELLS).index("item")))
    item = clean_cell(F.try_element_at(cells, at))
    fits = matches(item, r"\A\d{1,3}\z", "(?d)") | F.exists(cells, lambda c: F.regexp_like(F.coalesce(c, F.lit("")), F.lit(r"R\$|\d+[,.]\d{2}")))
    return F.coalesce((F.size(cells) >= at) & fits, F.lit(False))


def places(mapped: Column) -> Column:
    """A column map as an array, in the order of ``HEADER_CELLS``: it goes with every row of a table, and eight numbers are short."""
    return F.when(mapped.isNotNull(), F.array(*(F.try_element_at(mapped, F.lit(n)) for n in HEADER_CELLS)))


def cell_at(cells: Column, at: Column) -> Column:
    return filled(clean_cell(F.try_element_at(cells, at)))


def cell(cells: Column, mapped: Column, name: str) -> Column:
    return cell_at(cells, F.try_element_at(mapped, F.lit(name)))


def rows_to_items(page_rows: DataFrame, keys: tuple[str, ...] = ("proc_id", "page_no", "table_no"), order: str = "row_no") -> DataFrame:
    """Table rows (cells) to items. A header maps the columns of the rows below it; a table without one goes by shape, or, if that
    gives nothing and its first row fits, by the last header of an earlier table of the same first key.

    TOTAL and OBS rows are no items; rows without an item number continue the description above; code, unit and
    quantity missing on an item are taken from the next two rows, up to the next item."""
    w = Window.partitionBy(*keys).orderBy(order)
    up_to, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # each cell of a header is told once; its places are made of the names then
    rows = page_rows.withColumn("_head", is_header(F.col("cells")))
    rows = rows.withColumn("_names", F.when(F.col("_head"), header_kinds(F.col("cells"))))
    rows = rows.withColumn("_named", F.when(F.col("_head"), places(column_map(F.col("_names"))))).drop("_names")
    earlier = F.col("_named")
    if len(keys) > 1:  # the one shuffle, by the first key, serves the windows over single tables, too
        before = Window.partitionBy(keys[0]).orderBy(*keys[1:], order).rowsBetween(Window.unboundedPreceding, 0)
        earlier = F.last("_named", ignorenulls=True).over(before)
    rows = rows.withColumn("_earlier", earlier)
    # both frames have one order, so that rows go through one window
    rows = rows.withColumns({"_map": F.last("_named", ignorenulls=True).over(up_to), "_row": F.row_number().over(w), "_headed": F.max("_head").over(whole)}).drop("_named")
    # shapes are told only where no header stands, and whether a table goes on only at its first row
    bare = ~F.col("_headed")
    goes_on = F.when(bare & (F.col("_row") == 1), F.coalesce(continues_map(F.col("cells"), F.col("_earlier")), F.lit(False)))
    rows = rows.filter(bare | ~F.col("_head")).withColumns({"_shape": F.when(bare, usable_shape(F.col("cells"))), "_goes_on": goes_on, "_earlier": F.when(bare, F.col("_earlier"))}).drop("_row")
    rows = rows.withColumn("_kinds", F.when(F.col("_shape"), cell_kinds(F.col("cells"))))
    rows = rows.withColumn("_formed", F.when(F.col("_shape"), shape_map(F.col("_kinds")))).drop("_kinds")
    rows = rows.withColumn("_formed", F.when(F.size("_formed") >= LEAST_COLUMNS, places(F.col("_formed"))))
    rows = rows.withColumns({"_guess": F.first("_formed", ignorenulls=True).over(up_to), "_goes_on": F.first("_goes_on", ignorenulls=True).over(whole), "_shaped": F.max("_shape").over(whole)})
    mapped = F.when(F.col("_headed"), F.col("_map")).when(F.col("_shaped"), F.col("_guess")).when(F.col("_goes_on"), F.col("_earlier"))
    rows = rows.withColumn("_m", mapped).filter(~F.col("_head") & F.col("_m").isNotNull())
    rows = rows.select(*keys, order, *(cell_at(F.col("cells"), F.get("_m", F.lit(i))).alias(f"_{n}") for i, n in enumerate(HEADER_CELLS)))
    text = F.col("_item")
    item = F.when(~matches(text, "TOTAL|[IÍ]TEM|OBS"), F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))).try_cast("int")
    rows = rows.filter(~matches(F.coalesce(text, F.lit("")), r"\A(TOTAL|OBS)"))
    rows = rows.select(*keys, order, item.alias("item_no"), F.col("_code").alias("code"), F.col("_description").alias("description"), F.col("_unit").alias("unit"), S.quantity(F.col("_qty")).alias("qty"), S.element_item(F.col("_nd_si")).alias("nd_si"), S.money(F.col("_unit_price")).alias("unit_price"), S.money(F.col("_total")).alias("total"))
    rows = rows.withColumns({"_group": F.count("item_no").over(up_to), "_is": F.col("item_no").isNotNull()})
    filled = {}
    for name in ("code", "unit", "qty"):
        value, stopped = F.col(name), F.lit(False)
        for k in (1, 2):
            stopped = stopped | F.coalesce(F.lead("_is", k).over(w), F.lit(False))
            value = F.coalesce(value, F.when(~stopped, F.lead(name, k).over(w)))
        filled[name] = value
    rows = rows.withColumns(filled).filter(F.col("_group") > 0)
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("description").isNotNull(), F.struct(F.col(order).alias("o"), F.col("description").alias("d"))))), lambda p: p["d"])
    head = lambda n: F.first(F.when(F.col("_is"), F.col(n)), ignorenulls=True).alias(n)
    return rows.groupBy(*keys, "_group").agg(F.min(F.when(F.col("_is"), F.col(order))).alias(order), *(head(n) for n in ("item_no", "code", "unit", "qty", "nd_si", "unit_price", "total")), F.nullif(F.array_join(parts, " "), F.lit("")).alias("description")).drop("_group")


#: Item numbers, catalogue codes, units and budget codes as they are written (fixed values). Digits and blanks ahead of a unit are not given back
#: one by one, as no unit begins with either.
ITEM_START, CATALOGUE, UNITS = r"\b(\d{3,5}+)\s*+[-–]\s++[A-Z]", r"\b([134]\d{4,5})\b", r"KG|UN|UND|L|M2|M3|CX|PCT|LT|HR|SV|MÊS|M"
_AMOUNT, _QUANTITY = (rf"\b(\d{{{n},6}}+)\s*+(?=[CHKLMPSU])(?:{UNITS})\b" for n in (2, 1))
#: A word is tried as a unit only if it begins as one does; two odd letters fold to S and K.
_UNIT = rf"\b(?=(?-iu:[CGHJKLMPSUcghjklmpsu\u017f\u212a]))({UNITS}|PAR|JG|GL)\b"
#: The small letters of units and their capitals: for two or three letters shorter than a general change of case.
_CAPITALS = ("acdghjklmnprstuvxê\u017f", "ACDGHJKLMNPRSTUVXÊS")
_LONG_CODES = (r"\b(33\.90\.\d{2}\.\d{2})\b", r"\b(33\.90\.\d{2}/\d{2})\b", r"\b(3390\d{2}/\d{2})\b", r"\b(3390\d{4})\b")
_SIX_CODE, _SHORT_CODES = r"\b(3390\d{2})(?!\d)", (r"\b(\d{2}/\d{2})\b(?!\d)", r"\b(\d{2}\.\d{2})\b")


def _budget_code(s: Column) -> Column:
    """The budget code of a segment as it is written. Six digits from 339000 on are shaped as a catalogue code, too: the segment's first number of
    that shape is its catalogue code, and no budget code unless another one follows."""
    numbers = find_distinct(s, CATALOGUE, flags="(?d)")
    behind_code = F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0)))
    six = F.coalesce(F.try_element_at(F.filter(behind_code, lambda n: F.regexp_like(n, F.lit(rf"\A{_SIX_CODE}"))), F.lit(1)), F.when(F.size(numbers) > 1, find(s, _SIX_CODE, flags="(?d)")))
    # every long form holds one of the two
    long = F.when(F.contains(s, F.lit("3390")) | F.contains(s, F.lit("33.90.")), F.coalesce(cascade(s, *_LONG_CODES, flags="(?d)"), six))
    return F.coalesce(long, cascade(s, *_SHORT_CODES, flags="(?d)"))


def strategy(text: Column) -> Column:
    """How a machine-read text is cut: by item numbers if there are two or more, else by catalogue codes, else by quantities with a unit, else not at all."""
    numbers = F.size(find_distinct(text, ITEM_START, flags="(?d)"))
    amounts = F.size(find_all(text, _AMOUNT, flags="(?d)"))
    by_codes = once(F.size(find_distinct(text, CATALOGUE, flags="(?d)")), lambda n: F.when(n >= 2, "codes").when((n == 1) & (amounts >= 2), "quantities").otherwise("single"))
    return F.when(numbers >= 2, "numbers").otherwise(by_codes)


def text_segments(text: Column, how: Column) -> Column:
    """The parts of a machine-read text that hold an item each, cut as ``strategy`` says."""
    def by(p: str) -> Column:
        # each part behind a cut begins with what it was cut at, so that only the first may be no item
        return F.slice(F.split(text, f"(?={p})"), F.when(F.regexp_like(text, F.lit(rf"\A{p}")), 1).otherwise(2), F.length(text))

    return F.when(how == "numbers", by(ITEM_START)).when(how == "codes", by(CATALOGUE)).when(how == "quantities", by(_AMOUNT)).otherwise(F.array(text))


def texts_to_items(texts: DataFrame, keys: tuple[str, ...] = ("proc_id", "page_no", "image_no"), text: str = "text") -> DataFrame:
    """Machine-read texts to items, a row per segment that holds a code, a description or a total.

    What several columns read is a column of its own, worked out once: the text without runs of blanks, its strategy (once for each text, not for
    each segment), the segment's code, amounts and budget code."""
    plain = F.col("_plain")
    rows = texts.select(*keys, squeeze(F.col(text)).alias("_plain")).withColumn("strategy", strategy(plain))
    rows = rows.withColumn("_code", F.when(F.col("strategy") == "quantities", find(plain, CATALOGUE, flags="(?d)")))
    rows = rows.select(*keys, "strategy", "_code", F.posexplode(text_segments(plain, F.col("strategy"))).alias("seg_no", "_segment"))
    rows = rows.withColumn("_segment", F.trim("_segment"))
    s, amounts, whole = (F.col(n) for n in ("_segment", "_amounts", "_whole"))
    rows = rows.withColumns({
        "_number": find(s, CATALOGUE, flags="(?d)"), "_behind": F.coalesce(find(s, rf"{CATALOGUE}\s*\|?\s*(.*)", 2, "(?ds)"), s),
        "_amounts": F.array_compact(F.transform(find_all(s, r"R\$\s*([\d.]+,\d{2})", flags="(?d)"), S.money_strict)),
        "_whole": F.when(F.contains(s, F.lit("TOTAL")), find(s, r"TOTAL\s+FORNECEDOR\s+(?:R[$\s]?\s*)?([\d.,]+)", flags="(?d)")),
        "_budget": _budget_code(s),
    })
    total = S.money_strict(F.when(F.length(whole) - F.length(F.replace(whole, F.lit(","), F.lit(""))) >= 2, F.regexp_replace(whole, r",(?=.*,)", ".")).otherwise(whole))
    number = F.when(F.col("strategy") == "numbers", F.regexp_extract(s, r"\A(\d{3,5})", 1).try_cast("int")).otherwise(F.col("seg_no") + 1)
    named = F.when(F.contains("_behind", F.lit("TOTAL")), F.regexp_replace("_behind", r"TOTAL.*\z", "")).otherwise(F.col("_behind"))
    out = rows.select(
        *keys, "strategy", number.alias("item_no"), F.coalesce("_number", "_code").alias("code"), S.clean_description(F.regexp_replace(named, r"\b\d{2}[/.]\d{2}\b", " ")).alias("description"),
        F.translate(find(s, _UNIT), *_CAPITALS).alias("unit"), find(s, _QUANTITY, flags="(?d)").try_cast("decimal(18,4)").alias("qty"), S.element_item(F.col("_budget")).alias("nd_si"),
        F.when(F.size(amounts) >= 2, F.array_min(amounts)).alias("unit_price"), F.coalesce(total, F.array_max(amounts)).alias("total"), F.lit("ocr").alias("source"),
    )
    return out.filter(F.coalesce(F.col("code"), F.col("description"), F.col("total").cast("string")).isNotNull())


def declared_totals(page_rows: DataFrame, key: str = "proc_id") -> DataFrame:
    """(key, declared): the sum of the amounts that TOTAL rows state, the last amount of each."""
    text = F.upper(F.ltrim(F.array_join(F.array_compact("cells"), " ")))
    amounts = F.array_compact(F.transform("cells", lambda c: F.when(F.contains(F.coalesce(c, F.lit("")), F.lit("R$")), S.money(c))))
    rows = page_rows.filter(text.startswith("TOTAL")).select(key, F.try_element_at(amounts, F.lit(-1)).alias("amount"))
    return rows.groupBy(key).agg(F.sum("amount").alias("declared"))


def first_item(items: DataFrame, key: str = "proc_id", order: str = "item_no") -> DataFrame:
    """The first item with a quantity per dossier, with its sub-element: the last one or two digits after a slash or dot, no leading zero."""
    at = F.when(F.col("qty").isNotNull(), F.col(order))
    one = items.groupBy(key).agg(F.min_by(F.struct(*items.columns), at).alias("i"))
    sub = F.coalesce(find(F.col("i.nd_si"), r"/\s*(\d{1,2})\z"), find(F.col("i.nd_si"), r"\.\s*(\d{1,2})\z"))
    return one.filter(F.col("i.qty").isNotNull()).select(key, f"i.{order}", "i.qty", F.regexp_replace(sub, r"\A0(?=\d)", "").alias("sub"))
