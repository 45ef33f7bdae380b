"""Clusters around centroids, in integers and by JVM expressions alone.

Vectors become arrays of integers once and are written. A round is one pass: ``zip_with`` and ``aggregate`` give a vector's
distances to the centroids, which stand in the plan as literal arrays, ``array_min`` over structs (distance, number) takes the
nearest, and sums of columns by cluster, combined before the shuffle, give the next centroids. ``k * dim`` sums a round are all
that the driver sees; a cluster of any size is a handful of partial sums. All arithmetic is exact.

Rows take part if the vector has exactly ``dim`` components, none null, NaN or infinite. Rows with equal ids, or with a null id
(hashed as an empty one), take part each; where start vectors tie in their hash the smaller id, then the smaller vector, is first.
Equal distances go to the smaller centroid. With fewer rows than ``k`` there are as many centroids. An empty table gives no rows.
Other columns are ignored, whatever their names. A component beyond ``LARGEST / scale`` is an error: its squared distance might
not fit a long.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import materialize, scratch_dir, table

K, DIM, ROUNDS, SCALE, SALT = 40, 64, 5, 256, "2"
#: Bound of the magnitude of an integer component: ``DIM * (2 * LARGEST) ** 2`` is below ``2 ** 63``.
LARGEST = 1 << 27


def integers(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v, norm): the rows that take part, with their components times ``scale``, rounded down, and the sum of their squares."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.size("v") == dim)
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    small = F.forall("v", lambda x: F.abs(x) < LARGEST / scale)
    checked = F.when(small, F.col("v")).otherwise(F.raise_error(F.lit(f"a vector has a component beyond {LARGEST / scale:g}")).cast("array<double>"))
    rows = rows.select("id", F.transform(checked, lambda x: F.floor(x * scale)).alias("v"))
    return rows.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))


def start(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors whose ids hash lowest."""
    drawn = F.sha2(F.concat_ws(":", F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in rows.withColumn("drawn", drawn).orderBy("drawn", "id", "v").limit(k).collect()]


def nearest(centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the centroid nearest to ``v``, whose own squares sum to ``norm``: norm - 2 v c + c c."""
    there = ", ".join("struct(array({}) AS c, {}L AS cc)".format(", ".join(f"{x}L" for x in c), sum(x * x for x in c)) for c in centroids)
    product = "aggregate(zip_with(v, t.c, (a, b) -> a * b), 0L, (s, x) -> s + x)"
    return F.expr(f"array_min(transform(array({there}), (t, i) -> struct(norm - 2 * {product} + t.cc AS distance, i AS cluster)))")


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: means of their vectors, rounded down; an empty one stays."""
    dim = len(centroids[0])
    dealt = rows.select(nearest(centroids)["cluster"].alias("cluster"), *(F.col("v")[i].alias(f"x{i}") for i in range(dim)))
    sums = dealt.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"x{i}") for i in range(dim)))
    out = list(centroids)
    for r in sums.collect():  # a row for each centroid
        out[r.cluster] = [r[f"x{i}"] // r.n for i in range(dim)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """Rows (id, cluster, distance), written, and the centroids."""
    base = scratch_dir(vectors.sparkSession)
    rows = materialize(integers(vectors, id_col, vec_col, dim, scale), f"{base}/rows")
    centroids = start(rows, k, salt)
    if not centroids:
        none = F.lit(None)
        return rows.select(F.col("id").alias(id_col), none.cast("int").alias("cluster"), none.cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    last = rows.select("id", nearest(centroids).alias("near"))
    return materialize(last.select(F.col("id").alias(id_col), F.col("near.cluster").alias("cluster"), F.col("near.distance").alias("distance")), f"{base}/dealt"), centroids


def described(dealt: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The rows with their cluster's inertia, that of all, and the hash of their centroid: a look-up in literal arrays of ``k`` entries."""
    inertia = [0] * max(len(centroids), 1)
    for r in dealt.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect():
        inertia[r.cluster] = r.inertia
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    own = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    return dealt.select("*", own(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), own(named, "string").alias("centroid_sha256"))


def op13_integer_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*cluster(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    dot = f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    near = lambda step: f"(SELECT row_no, arg_min(number, (d, number)) AS number, min(d) AS d FROM (SELECT row_no, number, {dot} AS d FROM kept CROSS JOIN c{step}) GROUP BY 1)"
    parts = [
        f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true))""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS number, v AS c FROM (SELECT sha256('{SALT}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, vec_id, v FROM kept ORDER BY 1, 2, 3 LIMIT {K}))",
    ]
    for step in range(ROUNDS):
        parts.append(f"""m{step} AS MATERIALIZED (SELECT number, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM
  (SELECT number, i, sum(v[i]) AS s, count(*) AS n FROM {near(step)} JOIN kept USING (row_no) CROSS JOIN (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY ALL) GROUP BY 1)""")
        parts.append(f"c{step + 1} AS MATERIALIZED (SELECT number, coalesce(m{step}.c, c{step}.c) AS c FROM c{step} LEFT JOIN m{step} USING (number))")
    parts.append(f"dealt AS MATERIALIZED (SELECT * FROM {near(ROUNDS)})")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(number AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM dealt JOIN kept USING (row_no) JOIN c{ROUNDS} USING (number)"""


QUERIES = {"op13_integer_centroids": op13_integer_centroids}
ORACLE_SQL = {"op13_integer_centroids": _sql()}
