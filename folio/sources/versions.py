"""Versions of a stored table: which folder holds each of its pieces.

Data is written to folders of their own, and a version, a small table of (piece, folder), names them last. Readers take the newest
finished version, so that a crash before the switch changes nothing, and what no kept version names can be deleted. The table has
a row for each piece (a bucket, or a month of a batch), never one for each row of data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folio.sources.store import remove

SCHEMA = "piece string, folder string"


class Versions:
    def __init__(self, spark: SparkSession, path: str, keep: int = 3) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _names(self, folder: str) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def ids(self) -> list[int]:
        """Finished versions; a writer leaves ``_SUCCESS`` last."""
        found = [n for n in self._names(f"{self.path}/versions") if n.startswith("v=")]
        return sorted(int(n[2:]) for n in found if "_SUCCESS" in self._names(f"{self.path}/versions/{n}"))

    def pieces(self, before: int | None = None) -> dict[str, str]:
        """The folder of each piece in the newest version, or the newest before one."""
        ids = [i for i in self.ids() if before is None or i < before]
        if not ids:
            return {}
        return {r.piece: r.folder for r in self.spark.read.schema(SCHEMA).parquet(f"{self.path}/versions/v={ids[-1]}").collect()}

    def folder(self) -> str:
        """A new folder for data."""
        return f"data/{uuid.uuid4().hex}"

    def parts_of(self, folder: str, depth: int) -> list[str]:
        """The partition folders that a writer has made, ``depth`` levels down."""
        found = [""]
        for _ in range(depth):
            found = [f"{f}/{n}" for f in found for n in self._names(f"{self.path}/{folder}{f}") if "=" in n]
        return [f[1:] for f in found]

    def commit(self, pieces: dict[str, str], version: int | None = None) -> None:
        """Names a version's pieces; then old versions and what they alone name go."""
        ids = self.ids()
        version = (ids[-1] + 1 if ids else 0) if version is None else version
        rows = self.spark.createDataFrame(sorted(pieces.items()), SCHEMA)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/v={version}")
        ids = [i for i in self.ids() if i <= version]
        named = {f.split("/")[1] for i in self.ids()[-self.keep :] for f in self.pieces(i + 1).values() if "/" in f}
        for old in ids[: -self.keep]:
            remove(self.spark, f"{self.path}/versions/v={old}")
        for folder in self._names(f"{self.path}/data"):
            if folder not in named:
                remove(self.spark, f"{self.path}/data/{folder}")

    def read(self, folders: list[str]) -> DataFrame | None:
        """The rows of some pieces' folders, partition columns included; older ones without newer columns, too."""
        if not folders:
            return None
        roots = sorted({"/".join(f.split("/")[:2]) for f in folders})
        out = None
        for root in roots:  # one batch's folder each
            own = [f"{self.path}/{f}" for f in folders if f.startswith(f"{root}/") or f == root]
            part = self.spark.read.option("basePath", f"{self.path}/{root}").parquet(*own)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out
