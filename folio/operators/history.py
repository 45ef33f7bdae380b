"""Stored analyses: search, latest, look-up, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import scalars as S
from folio.operators.render import dash


def search(analyses: DataFrame, text: str | None = None, columns: Sequence[str] = ("nup", "supplier", "unit_name", "instrument"), result: str | None = None, result_col: str = "result", start: str | None = None, end: str | None = None, date_col: str = "created") -> DataFrame:
    """Rows that contain the text in any of the columns (``%`` and ``_`` are wildcards), with the result, within inclusive dates."""
    out = analyses
    if text:
        any_hit = F.lit(False)
        for c in columns:
            any_hit = any_hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        out = out.filter(any_hit)
    if result:
        out = out.filter(F.col(result_col) == result)
    if start:
        out = out.filter(F.to_date(date_col) >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.to_date(date_col) <= F.lit(end).cast("date"))
    return out


def period(rows: DataFrame, date_col: str, as_of: Column, days: int) -> DataFrame:
    return rows.filter(F.to_date(date_col) >= F.date_sub(as_of, days))


def latest(rows: DataFrame, n: int, order: str, tie: str) -> DataFrame:
    """The newest ``n`` rows; equal times are ordered by ``tie``."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(n)


def lookup(rows: DataFrame, column: str, value) -> DataFrame:
    return rows.filter(F.col(column) == value)


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def monthly(rows: DataFrame, date_col: str, result_col: str, results: dict[str, str], as_of: Column, months: int = 12) -> DataFrame:
    """Per month of the last ``months``: all rows and those of each result. The first month may be partial, so up to ``months`` + 1 appear."""
    recent = rows.filter(F.to_date(date_col) >= F.add_months(as_of, -months))
    return recent.groupBy(F.date_format(date_col, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(result_col) == v).alias(k) for k, v in results.items()))


def total(rows: DataFrame, column: str, name: str = "total", by: Sequence[str] = ()) -> DataFrame:
    """The sum of a column, 0 if there is nothing to add; for all rows, or by some columns."""
    return rows.groupBy(*by).agg(F.coalesce(F.sum(column), F.lit(0)).alias(name))


def completeness(rows: DataFrame, columns: Sequence[str], **extra: Column) -> DataFrame:
    """(field, found, n_rows) and any extra aggregates of all rows: how often each field is filled."""
    one = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in columns), *(c.alias(n) for n, c in extra.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("found"), F.col("n").alias("n_rows")) for c in columns))).alias("r"), *extra).select("r.*", *extra)


def summary(columns: dict[str, Column]) -> tuple[Column, Column]:
    """Names of the filled and of the missing fields of a row."""
    found = F.array_compact(F.array(*(F.when(c.isNotNull(), F.lit(n)) for n, c in columns.items())))
    missing = F.array_compact(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in columns.items())))
    return found, missing


def by_code(rows: DataFrame, code: str = "unit_code") -> DataFrame:
    """Units in order of their code."""
    return rows.orderBy(code)


def dispatch_order(dispatches: DataFrame, key: str = "proc_id", number: str = "number", page: str = "page_no") -> DataFrame:
    """``seq`` numbers a dossier's dispatches by number, those without one first, then by page."""
    w = Window.partitionBy(key).orderBy(F.coalesce(number, F.lit(0)), page)
    return dispatches.withColumn("seq", F.row_number().over(w))


#: What a stored analysis keeps as JSON text.
DETAIL = "identification struct<unit_code:string,instrument:string,tax_id:string,pi:string>, items array<struct<item_no:int,qty:string,sub:string,total:string>>, result struct<type:string,title:string,caveats:array<string>,ok:array<string>>"


def rebuild(rows: DataFrame, detail: str = "detail") -> DataFrame:
    """A stored analysis as it was shown: (its other columns, type, title, caveats, ok, unit_code, instrument, tax_id, pi, item, qty, sub, total).

    What is missing, or not readable, has a default: a caveat without texts, a dash for what is shown. The total adds up amounts
    in either written form and is null without any."""
    d = F.from_json(detail, DETAIL, {"mode": "PERMISSIVE"})
    none = F.array().cast("array<string>")
    listed = lambda n: dash(F.array_join(F.transform("_d.items", lambda i: F.coalesce(i[n].cast("string"), F.lit(""))), ", "))
    amounts = F.array_compact(F.transform("_d.items", lambda i: S.money(i["total"])))
    total = F.when(F.size(amounts) > 0, F.aggregate(amounts, F.lit(0).cast("decimal(18,2)"), lambda a, b: (a + b).cast("decimal(18,2)")))
    plain = {n: dash(F.col(f"_d.identification.{n}")) for n in ("unit_code", "instrument", "tax_id", "pi")}
    return rows.withColumn("_d", d).select(
        *(c for c in rows.columns if c != detail), F.coalesce("_d.result.type", F.lit("caveat")).alias("type"), dash(F.col("_d.result.title")).alias("title"), F.coalesce("_d.result.caveats", none).alias("caveats"), F.coalesce("_d.result.ok", none).alias("ok"),
        *(c.alias(n) for n, c in plain.items()), listed("item_no").alias("item"), listed("qty").alias("qty"), listed("sub").alias("sub"), total.alias("total"))
