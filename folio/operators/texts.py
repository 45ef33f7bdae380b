"""Joining and pairing of texts in order: page texts, neighbouring lines, continuations, look-ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import scalars as S


def joined_text(rows: DataFrame, keys: Sequence[str], order: str, text: str = "text", blank: str = "\n\n", condition: Column | None = None, name: str = "text") -> DataFrame:
    """The non-empty texts of each group in order. A group is one dossier's pages of one label, a few hundred at most."""
    keep = (F.col(text) != "") if condition is None else (F.col(text) != "") & condition
    pieces = F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), blank).alias(name))


def first_then_all(rows: DataFrame, key: str, order: str, text: str, first: int = 5) -> DataFrame:
    """Both texts of a group: that of its first rows and that of all, for look-ups that prefer the first."""
    early = F.col(order) < first
    pieces = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c & (F.col(text) != ""), F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))), lambda p: p["t"]), "\n\n")
    return rows.groupBy(key).agg(pieces(early).alias("first_text"), pieces(F.lit(True)).alias("all_text"))


def pair_following(rows: DataFrame, key: str, order: str, opens: Column, closes: Column, value: Column, within: int = 3) -> DataFrame:
    """Opening rows with ``paired``, the value of the first closing row among the next ``within`` rows; the next opening row ends the search."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumns({"_open": opens, "_value": F.when(closes, value)})
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    stopped = F.lit(False)
    for k in range(1, within + 1):
        stopped = stopped | F.coalesce(F.lead("_open", k).over(w), F.lit(False))
        hit = F.lead("_value", k).over(w)
        out = F.coalesce(out, F.when(~stopped, hit))
    return marked.withColumn("paired", out).filter("_open").drop("_open", "_value")


def continuation_groups(rows: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """``group_no``: 0 before the first start, then one more at each."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group_no", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))


def carried(rows: DataFrame, key: str, order: str, value: Column, name: str = "carried") -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def filled_ahead(rows: DataFrame, key: str, order: Sequence[str], column: str, ahead: int = 2, stops: Column | None = None, name: str | None = None) -> DataFrame:
    """A missing value is taken from the next ``ahead`` rows, not past a row where ``stops`` holds."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_stop", F.coalesce(stops, F.lit(False)) if stops is not None else F.lit(False))
    out, stopped = F.col(column), F.lit(False)
    for k in range(1, ahead + 1):
        stopped = stopped | F.coalesce(F.lead("_stop", k).over(w), F.lit(False))
        out = F.coalesce(out, F.when(~stopped, F.lead(column, k).over(w)))
    return marked.withColumn(name or column, out).drop("_stop")


def with_grid_text(pages: DataFrame, page_rows: DataFrame, label: str = "credit_note", enough: int = 100) -> DataFrame:
    """Labelled pages of one kind whose own text is short get the text of their grids, put together row by row, if that is longer.

    ``pages(proc_id, page_no, label, text)`` and ``page_rows(proc_id, page_no, table_no, row_no, cells)``; the rows of one page come together."""
    keys = ["proc_id", "page_no"]
    short = (F.col("label") == label) & (F.length(F.trim(F.coalesce("text", F.lit("")))) <= enough)
    bare = pages.filter(short)
    grids = page_rows.join(bare.select(*keys).distinct().hint("shuffle_hash"), keys, "left_semi")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("table_no", "row_no", "cells"))), lambda r: r["cells"])
    grids = grids.groupBy(*keys).agg(rows.alias("_rows")).hint("shuffle_hash")
    filled = bare.join(grids, keys, "left").withColumn("text", S.rebuilt_text(F.col("text"), F.col("_rows"), enough))
    return pages.filter(~short).unionByName(filled.drop("_rows"))
