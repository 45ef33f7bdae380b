"""Rows that arrive in batches: registries and history by ``foreachBatch``, and dossiers that arrive in pieces."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.versions import Versions

Work = Callable[[DataFrame, int], None]


def run_available(stream: DataFrame, checkpoint: str, work: Work) -> None:
    """Works off what has arrived, batch by batch, and stops."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()




def whole(path: str, work: Work, key: str = "proc_id", page: str = "page_no", declared: str = "n_pages", arrived: str = "arrived", limit: datetime.timedelta = datetime.timedelta(days=7), keep: int = 3) -> Work:
    """A ``foreachBatch`` function that holds pages back until their dossier is whole, and hands whole dossiers to ``work``.

    A dossier is whole when it has as many pages as any of its pages declares, or, if it never has, when its newest page is older
    by ``limit`` than the newest page of all. The table of pages that wait is a version of its own for each batch, built on the one
    before, so that a batch that comes again gives the same; it holds open dossiers only. Of a page that comes twice the first
    arrival counts. Pages of a dossier that was handed on within the last ``limit`` are late, or repeats, and are left out. Rows without a key, page or time of
    arrival are no pages."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        v = Versions(spark, path, keep)
        before = v.pieces(batch_id)
        rows = batch.filter(F.col(key).isNotNull() & F.col(page).isNotNull() & F.col(arrived).isNotNull())
        waiting = v.read([f for p, f in before.items() if p == "waiting"])
        if waiting is not None:
            rows = waiting.drop("whole").unionByName(rows)
        released = v.read([f for p, f in before.items() if p.startswith("released/")])
        if released is not None:
            rows = rows.join(released.select(key).distinct().hint("shuffle_hash"), key, "left_anti")
        others = [c for c in rows.columns if c not in (key, page)]
        rows = rows.groupBy(key, page).agg(F.min(F.struct(arrived, *(c for c in others if c != arrived))).alias("_p")).select(key, page, *(F.col("_p")[c].alias(c) for c in others))
        folder = v.folder()
        rows.write.parquet(f"{v.path}/{folder}/all")
        rows = v.read([f"{folder}/all"])
        now = rows.agg(F.max(arrived).alias("now")).first().now
        own = Window.partitionBy(key)
        is_whole = (F.count(F.lit(1)).over(own) >= F.max(declared).over(own)) | (F.max(arrived).over(own) < F.lit(None if now is None else now - limit))
        rows.select(*rows.columns, F.coalesce(is_whole, F.lit(False)).alias("whole")).write.partitionBy("whole").parquet(f"{v.path}/{folder}/parts")
        parts = v.parts_of(f"{folder}/parts", 1)
        kept = {p: f for p, f in before.items() if p.startswith("released/") and (now is None or datetime.datetime.fromisoformat(p.split("/")[2]) >= now - limit)}
        if "whole=false" in parts:
            kept["waiting"] = f"{folder}/parts/whole=false"
        ready = v.read([f"{folder}/parts/whole=true"]) if "whole=true" in parts else None
        if ready is not None:
            ready.select(key).distinct().write.parquet(f"{v.path}/{folder}/keys")
            kept[f"released/{batch_id}/{now.isoformat()}"] = f"{folder}/keys"
        v.commit(kept, batch_id)
        if ready is not None:
            work(ready.drop("whole", declared, arrived), batch_id)

    return run
