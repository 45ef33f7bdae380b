"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt into blocks, and every block is indexed once, by a forest of ``trees`` sorted arrays of ``BITS``-bit
hash strings (signs of random projections around the block's mean). Queries are streamed past the blocks. A query
descends each tree to its longest matching prefix by binary search; then all trees ascend together, one bit at a time,
until the ranges under the current prefix length hold enough rows in sum. The candidates are measured exactly, each
block gives its ``k`` nearest, and a top-k per query over blocks ends it. Every vector is indexed, every block answers
every query.

How many rows are enough is calibrated in each block: ``PROBES`` of its own vectors are looked up, and the least number is
taken at which ``recall`` of their true nearest in the block (twice as many as a block is due of ``k``) are candidates. Vectors with clusters need few candidates.
Hash prefixes separate poorly where vectors have no structure (independent directions in 64 dimensions, as in the test
tables: a tenth neighbour at 64 degrees shares a bit with probability 0.64, any row with 0.5); there about a third of
a block is measured.

The vectors are shuffled once, the queries once for each block of up to ``block_rows`` rows and ``BLOCK_BYTES`` bytes.

Rows take part if the id is not null and the vector is neither null, empty nor zero and holds no null, NaN or
infinity; vectors are compared within one dimension only. Repeated rows are candidates each, rows with the query's id
are none, ties go to the smaller id. Of several vectors under one query id the least, compared number by number, asks. An
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import materialize, scratch_dir, table

TREES, BITS = 96, 32
RECALL, PROBES = 0.94, 64
#: A block's bounds; with fewer rows than ``SPREAD`` blocks of the largest size there are smaller blocks, down to ``LEAST_ROWS``.
BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS, SPREAD = 65_536, 64 << 20, 4096, 64
SEED = 11


class Forest:
    """Sorted arrays of hash strings over the rows of one block."""

    def __init__(self, rows: np.ndarray, k: int, recall: float, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng([seed, rows.shape[1]])
        self.center = rows.mean(0)
        self.planes = rng.standard_normal((rows.shape[1], trees * BITS)).astype(np.float32)
        self.trees, self.n = trees, len(rows)
        own = self.strings(rows)
        self.order = np.argsort(own, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(own, self.order, 1)
        self.enough = self._calibrate(rows, own, k, recall)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """Hash strings as numbers, a row per tree; the first bit is the highest."""
        parts = []
        for at in range(0, len(x), 4096):
            signs = ((x[at : at + 4096] - self.center).astype(np.float32) @ self.planes > 0).reshape(-1, self.trees, BITS)
            parts.append(np.packbits(signs, axis=2).view(">u4")[:, :, 0].astype(np.int64))
        return np.ascontiguousarray(np.concatenate(parts).T)

    def ranges(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the rows that share each number of leading bits, by depth, tree and query."""
        width = np.int64(1) << np.arange(BITS, -1, -1)[:, None]
        low = np.zeros((BITS + 1, self.trees, strings.shape[1]), np.int32)
        high = np.zeros_like(low)
        for t in range(self.trees):
            first = strings[t] // width * width
            low[:, t] = np.searchsorted(self.sorted[t], first)
            high[:, t] = np.searchsorted(self.sorted[t], first + width)
        return low, high

    @staticmethod
    def _depth(held: np.ndarray, enough: float) -> np.ndarray:
        """The longest prefix at which a query's ranges hold enough rows in sum (the whole block, if need be)."""
        return np.where(held >= enough, np.arange(BITS + 1)[:, None], 0).max(0)

    def _calibrate(self, rows: np.ndarray, own: np.ndarray, k: int, recall: float) -> float:
        probes = np.unique(np.linspace(0, self.n - 1, PROBES).astype(int))
        low, high = self.ranges(own[:, probes])
        held = (high.astype(np.int64) - low).sum(1)
        reach = np.zeros((len(probes), min(k, self.n - 1)), int)  # leading bits that each true neighbour shares in its best tree
        for i, p in enumerate(probes):
            distance = ((rows - rows[p]) ** 2).sum(1)
            distance[p] = np.inf
            near = np.argsort(distance, kind="stable")[: reach.shape[1]]
            apart = (own[:, near] ^ own[:, [p]]).min(0)
            reach[i] = BITS - np.ceil(np.log2(apart.astype(float) + 1)).astype(int)
        enough = float(4 * k)
        while enough < self.trees * self.n:
            if (reach >= self._depth(held, enough)[:, None]).mean() >= recall:
                return enough
            enough *= 1.15
        return enough

    def candidates(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the candidate rows (a mask) after the synchronous ascent."""
        low, high = self.ranges(self.strings(x))
        depth = self._depth((high.astype(np.int64) - low).sum(1), self.enough)
        for q in range(len(x)):
            mask = np.zeros(self.n, bool)
            for t in range(self.trees):
                mask[self.order[t, low[depth[q], t, q] : high[depth[q], t, q]]] = True
            yield mask

    def nearest(self, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query id, ids, distances) of each query's k nearest candidates in the block."""
        for own, query, mask in zip(query_ids, queries, self.candidates(queries), strict=True):
            place = np.flatnonzero(mask & (ids != own))
            if not len(place):
                continue
            distance = np.sqrt(((rows[place] - query) ** 2).sum(1))
            if len(place) > k:
                keep = distance <= np.partition(distance, k - 1)[k - 1]
                place, distance = place[keep], distance[keep]
            best = np.lexsort((ids[place], distance))[:k]
            yield own, ids[place[best]], distance[best]


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score): up to ``k`` found neighbours of each query among ``vectors``."""
    base = scratch_dir(vectors.sparkSession)
    rows = materialize(_valid(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), f"{base}/rows")
    asked = _valid(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n, dim = rows.agg(F.count(F.lit(1)), F.max("dim")).first()
    largest = max(1, min(block_rows, BLOCK_BYTES // (8 * (dim or 1))))
    blocks = max(math.ceil(n / largest), min(SPREAD, math.ceil(n / LEAST_ROWS)), 1)
    near = min(k, math.ceil(2 * k / blocks))  # rows are dealt at random: a block holds about k / blocks of a query's nearest
    left = rows.select("dim", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v")
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, forest = None, None
        ids, parts = [], []
        for b in batches:
            keys = np.column_stack([b.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
            for start, stop in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                some = b.slice(start, stop - start)
                dim, block, asks = keys[start].tolist()
                if (dim, block) != key:
                    key, forest, ids, parts = (dim, block), None, [], []
                x = some.column(4).flatten().to_numpy().reshape(-1, dim)
                if not asks:
                    ids.append(some.column(3).to_numpy())
                    parts.append(x)
                    continue
                if not parts:
                    continue
                if forest is None:
                    ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                    forest = Forest(parts[0], near, recall)
                for at in range(0, len(x), 256):
                    found = list(forest.nearest(ids[0], parts[0], some.column(3).to_numpy()[at : at + 256], x[at : at + 256], k))
                    sizes = [len(i) for _, i, _ in found]
                    columns = [np.repeat(np.array([f[0] for f in found], np.int64), sizes), *(np.concatenate([f[c] for f in found] or [[]]) for c in (1, 2))]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(float))], ["query_id", "id", "score"])

    # the vectors of a block come before its queries
    dealt = left.unionByName(right).repartition(4 * blocks, "dim", "block").sortWithinPartitions("dim", "block", "asks")
    found = dealt.mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


QUERIES = {"op1_prefix_forest": op1_prefix_forest}
ORACLE_SQL: dict[str, str] = {}
