"""The stored history: analyses by month, a delete log, counts that are kept beside it, and trigram postings for search.

Each batch is written to a folder of its own, by month and in order of time; a version names all folders (``versions``). Beside
its rows a batch leaves two small tables: counts and sums by month and result, and the postings (gram, month, hash of the id) of the texts that
are searched. A delete writes the ids with their months, and the counts to take off; readers of a month leave out its deleted
ids. ``fold`` rewrites only the months that have deletes and makes one table of the counts.

So statistics read no rows; the newest N read the newest months that hold them; a substring is looked up by its trigrams, and
only the months of the candidates are read; deleting an id rewrites one month at most. A batch that comes again is told by its id
and changes nothing. Rows need ``analysis_id``, ``created`` and ``month`` (``store.analysis_rows``); a null text has no grams; a null
result is counted as one of its own. Rows that are equal in their id are stored once within a batch.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import history
from folio.sources.versions import Versions

SEARCHED = ("nup", "supplier", "unit_name", "instrument")
_AMOUNT = "decimal(28,2)"
#: Bloom filters of the ids that are as large as a file's ids need; else each takes a megabyte, a file for each month.
_BLOOM = {"parquet.bloom.filter.enabled#analysis_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def grams(text: Column) -> Column:
    """Distinct runs of three symbols of the lower-cased text; one search, linear in its length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def _row(analysis_id: Column) -> Column:
    """What postings name a row by: four bytes for an id of 64. Two ids may share one; what is found is held against the text anyway."""
    return F.hash(analysis_id)


class Analyses:
    """A history below a path."""

    def __init__(self, spark: SparkSession, path: str, searched: Sequence[str] = SEARCHED, result: str = "result", total: str = "total", keep: int = 3) -> None:
        self.spark, self.versions, self.searched, self.result, self.total = spark, Versions(spark, path, keep), tuple(searched), result, total

    # --- writing

    def _counts(self, rows: DataFrame, sign: int) -> DataFrame:
        amount = F.coalesce(F.sum(F.col(self.total).cast(_AMOUNT)), F.lit(0).cast(_AMOUNT)) if self.total in rows.columns else F.lit(0)
        return rows.groupBy("month", F.col(self.result).cast("string").alias("result")).agg((sign * F.count(F.lit(1))).alias("n"), (sign * amount).cast(_AMOUNT).alias("total"))

    def _postings(self, rows: DataFrame) -> DataFrame:
        texts = [grams(F.col(c).cast("string")) for c in self.searched if c in rows.columns]
        every = F.array_distinct(F.flatten(F.array_compact(F.array(*texts)))) if texts else F.array().cast("array<string>")
        return rows.select("month", _row(F.col("analysis_id")).alias("row"), F.explode(every).alias("gram"))

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Stores a batch once, however often it comes."""
        v = self.versions
        pieces = v.pieces()
        if f"batch={batch_id}" in pieces:
            return
        folder = v.folder()
        order = [F.desc("created"), "analysis_id"]
        fresh = rows.dropDuplicates(["analysis_id"]).hint("rebalance", "month").sortWithinPartitions("month", *order)
        fresh.write.partitionBy("month").options(**_BLOOM).parquet(f"{v.path}/{folder}/rows")
        made = v.parts_of(f"{folder}/rows", 1)
        pieces |= {f"batch={batch_id}": folder} | {f"rows/{m}/{batch_id}": f"{folder}/rows/{m}" for m in made}
        if made:
            stored = v.read([f"{folder}/rows/{m}" for m in made])
            self._counts(stored, 1).write.parquet(f"{v.path}/{folder}/counts")
            self._postings(stored).hint("rebalance", "gram").sortWithinPartitions("gram").write.parquet(f"{v.path}/{folder}/grams")
            pieces |= {f"counts/{batch_id}": f"{folder}/counts", f"grams/{batch_id}": f"{folder}/grams"}
        v.commit(pieces)

    def delete(self, ids: DataFrame) -> bool:
        """Notes ids as deleted; whether any was there. No row of the history is rewritten."""
        v, rows = self.versions, self.read()
        if rows is None:
            return False
        folder, name = v.folder(), uuid.uuid4().hex
        gone = rows.join(ids.select("analysis_id").distinct(), "analysis_id", "left_semi")
        gone.select("analysis_id", "month", F.col(self.result).alias(self.result), *([self.total] if self.total in rows.columns else [])).write.partitionBy("month").parquet(f"{v.path}/{folder}/ids")
        made = v.parts_of(f"{folder}/ids", 1)
        if not made:
            return False
        self._counts(v.read([f"{folder}/ids/{m}" for m in made]), -1).write.parquet(f"{v.path}/{folder}/counts")
        v.commit(v.pieces() | {f"deleted/{m}/{name}": f"{folder}/ids/{m}" for m in made} | {f"counts/{name}": f"{folder}/counts"})
        return True

    def fold(self) -> list[str]:
        """Rewrites the months that have deletes without the deleted rows, and adds up the counts; the months that were rewritten."""
        v = self.versions
        pieces = v.pieces()
        months = sorted({p.split("/")[1] for p in pieces if p.startswith("deleted/")})
        folder, name = v.folder(), uuid.uuid4().hex
        self._added(pieces).write.parquet(f"{v.path}/{folder}/counts")
        kept = {p: f for p, f in pieces.items() if not p.startswith("counts/") and (p.split("/")[0] not in ("rows", "deleted") or p.split("/")[1] not in months)}
        if months:
            own = self.read([m.split("=")[1] for m in months])
            own.hint("rebalance", "month").sortWithinPartitions("month", F.desc("created"), "analysis_id").write.partitionBy("month").options(**_BLOOM).parquet(f"{v.path}/{folder}/rows")
            kept |= {f"rows/{m}/{name}": f"{folder}/rows/{m}" for m in v.parts_of(f"{folder}/rows", 1)}
        v.commit(kept | {f"counts/{name}": f"{folder}/counts"})
        return [m.split("=")[1] for m in months]

    # --- reading

    def read(self, months: Sequence[str] | None = None) -> DataFrame | None:
        """The rows of all or some months that are not deleted; files of other months are not opened."""
        pieces = self.versions.pieces()
        own = {kind: [f for p, f in sorted(pieces.items()) if p.startswith(f"{kind}/") and (months is None or p.split("/")[1].split("=")[1] in months)] for kind in ("rows", "deleted")}
        rows, gone = self.versions.read(own["rows"]), self.versions.read(own["deleted"])
        if rows is not None:
            rows = rows.withColumn("month", F.col("month").cast("string"))
        return rows if rows is None or gone is None else rows.join(gone.select("analysis_id").hint("shuffle_hash"), "analysis_id", "left_anti")

    def _added(self, pieces: dict[str, str]) -> DataFrame:
        found = self.versions.read([f for p, f in sorted(pieces.items()) if p.startswith("counts/")])
        if found is None:
            found = self.spark.createDataFrame([], f"month string, result string, n long, total {_AMOUNT}")
        return found.groupBy(F.col("month").cast("string").alias("month"), "result").agg(F.sum("n").alias("n"), F.sum("total").cast(_AMOUNT).alias("total")).filter(F.col("n") != 0)

    def counts(self) -> DataFrame:
        """(month, result, n, total) of what is stored and not deleted; reads the kept counts alone."""
        return self._added(self.versions.pieces())

    def monthly(self, results: dict[str, str], since: str | None = None) -> DataFrame:
        """Per month, from the month ``since`` (yyyy-MM) on: all rows, those of each result, and the sum."""
        rows = self.counts() if since is None else self.counts().filter(F.col("month") >= since)
        of = lambda v: F.coalesce(F.sum(F.when(F.col("result") == v, F.col("n"))), F.lit(0))
        return rows.groupBy("month").agg(F.sum("n").alias("n"), *(of(v).alias(k) for k, v in results.items()), F.sum("total").alias("total"))

    def newest_months(self, n: int) -> list[str]:
        """The newest months that hold ``n`` rows between them, from the counts: a row for each month of the history."""
        out, held = [], 0
        for r in self.counts().groupBy("month").agg(F.sum("n").alias("n")).orderBy(F.desc("month")).collect():
            if held >= n:
                break
            out.append(r.month)
            held += r.n
        return out

    def latest(self, n: int) -> DataFrame | None:
        """The newest ``n`` rows, from the newest months that hold as many."""
        rows = self.read(self.newest_months(n))
        return None if rows is None else history.latest(rows, n, "created", "analysis_id")

    def period(self, as_of: Column, days: int) -> DataFrame | None:
        """The rows of the last days; older months are not opened."""
        first = self.spark.range(1).select(F.date_format(F.date_sub(as_of, days), "yyyy-MM").alias("m")).first().m
        rows = self.read([r.month for r in self.counts().select("month").distinct().collect() if r.month >= first])
        return None if rows is None else history.period(rows, "created", as_of, days)

    def lookup(self, analysis_id: str) -> DataFrame | None:
        """The row of an id; row groups are told apart by their Bloom filters."""
        rows = self.read()
        return None if rows is None else history.lookup(rows, "analysis_id", analysis_id)

    def search(self, text: str, **more) -> DataFrame | None:
        """As ``history.search``: the months of the rows that hold every trigram of the text are read, and what matches stays.

        A text without three symbols in a row between wildcards is searched for in all months."""
        parts = [p for p in re.split(r"\\.|[%_]", text) if len(p) > 2]
        months = ids = None
        if parts:
            need = sorted({g for r in self.spark.createDataFrame([(p,) for p in parts], "p string").select(grams(F.col("p")).alias("g")).collect() for g in r.g})
            held = self.versions.read([f for p, f in sorted(self.versions.pieces().items()) if p.startswith("grams/")])
            if held is None:
                return self.read()
            if "analysis_id" in held.columns:  # postings of batches that were stored before rows were named shortly
                held = held.withColumn("row", F.coalesce(*(["row"] if "row" in held.columns else []), _row(F.col("analysis_id"))))
            found = held.filter(F.col("gram").isin(need)).groupBy("month", "row").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(need))
            ids = found.select("row", F.col("month").cast("string").alias("month"))
            months = [r.month for r in ids.select("month").distinct().collect()]  # a row for each month
        rows = self.read(months)
        if rows is None:
            return None if months is None else self.read().limit(0)
        if ids is not None:
            rows = rows.withColumn("row", _row(F.col("analysis_id"))).join(ids.select("row").hint("shuffle_hash"), "row", "left_semi").drop("row")
        return history.search(rows, text, [c for c in self.searched if c in rows.columns], result_col=self.result, **more)
