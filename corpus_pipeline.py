"""The training-data pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that the next one gets, written as Parquet and
read again; all but the last keep the columns of ``documents``, and any others, as they are.

Nulls: a null text fails the quality rules; a null id or source stays one. Rows that share an id are rows each. Texts are read whole,
however long. Ties: of a group of near copies the row with the smallest id stays, the first of them if it is repeated; a stage's
docstring tells the rest. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import mixing, neardup, packing, pii, quality
from folio.llm.common import clear, made, materialize, narrow_batches, scratch_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or look anomalous go."""
    narrow_batches(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    narrow_batches(spark)
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    narrow_batches(spark)
    out = pii.masked(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    narrow_batches(spark)
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece."""
    narrow_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]

#: Forest, random field and random rounding have no SQL form; the tests check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage has written for itself is deleted once its result is a table."""
    docs, mark = table(spark, sf_dir, "documents"), made()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_dir(spark)
            docs = materialize(docs, path)
            clear(spark, mark, path)
    return docs
