"""Shared pieces of the training-data operators: scratch tables and byte-bounded Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share. Where that is unset, a temporary folder serves a
    local session, as in tests; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/folio-{uuid.uuid4().hex}")
    return _made[-1]


#: Scratch folders of this session, in order.
_made: list[str] = []


def made() -> int:
    """How many scratch folders there were so far: a mark for ``clear``."""
    return len(_made)


def clear(spark: SparkSession, mark: int, keep: str) -> None:
    """Deletes the scratch folders made since a mark, but for ``keep``: for jobs whose result is written."""
    for path in _made[mark:]:
        if path != keep:
            remove(spark, path)
    _made[mark:] = [keep] if keep in _made[mark:] else []


def narrow_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Rows go to Python in Arrow batches of up to ``most`` bytes, in this session from now on: operators over texts work on slices smaller
    than that, and what a task holds twice, here and there, is so much less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > most:
        spark.conf.set(name, str(most))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder whose tables nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores in front as it takes to differ from all columns, however they are capitalised."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends here, sizes are real, a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_holder: tuple[str, Callable[[], None] | None] = ("", None)


def hold(name: str, forget: Callable[[], None] | None = None) -> None:
    """Tells that an operator runs in this Python worker; what another one remembered is forgotten, so that stages do not add up."""
    global _holder
    if _holder[0] != name and _holder[1]:
        _holder[1]()
    _holder = (name, forget)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns freed memory to the system: a Python worker that has done its task stays for a while and waits for the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` (string or binary) holds about ``most`` bytes at once; a longer row comes alone."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
    give_back()


def n_words(text: F.Column) -> F.Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts 0. Words are runs between separators: one more than the runs of separators inside."""
    trimmed = F.trim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0).cast("long")).otherwise(
        (F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")
    )
