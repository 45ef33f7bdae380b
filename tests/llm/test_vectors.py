"""Whitening and centroids against brute force in numpy and SQL."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import cluster, whiten

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, cluster string, x string, v string, distance string, cell string"


def table_of(spark, vectors, base=None):
    """Vectors with columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, v, "a", "b", "c", None, "d") for i, v in vectors], SCHEMA)
    if base:
        df.write.mode("overwrite").parquet(f"{base}/embeddings.parquet")
    return df


BAD = [(9001, None), (9002, []), (9003, [1.0] * 63 + [None]), (9004, [NAN] + [0.0] * 63), (9005, [0.0] * 63 + [INF])]


# --- centroids ----------------------------------------------------------------------------------------------------------------


def lloyd(vectors, k, rounds):
    """The contract by hand, in Python integers."""
    ids = [i for i, _ in vectors]
    x = np.floor(256 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(np.int64)
    order = sorted(range(len(ids)), key=lambda r: (hashlib.sha256(f"2:{'' if ids[r] is None else ids[r]}".encode()).hexdigest(), x[r].tolist()))
    c = [x[r].tolist() for r in order[:k]]
    for step in range(rounds + 1):
        d = np.array([((x - np.array(m)) ** 2).sum(1) for m in c])
        near = d.argmin(0)
        if step < rounds:
            c = [[int(s) // int((near == j).sum()) for s in x[near == j].sum(0)] if (near == j).any() else m for j, m in enumerate(c)]
    own = d.min(0)
    return sorted((-1 if i is None else i, int(j), int(e), int(own[near == j].sum()), int(own.sum()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, e in zip(ids, near, own, strict=True))


def clustered(rows):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows)


def test_centroids_of_the_contract(spark, tmp_path):
    rng = np.random.default_rng(4)
    good = [(i, (rng.normal(size=64) * 0.2 + (i % 7) * 0.1).astype(np.float32).tolist()) for i in range(400)]
    good += [(5, good[5][1]), (5, good[6][1]), (401, [0.0] * 64), (402, [0.0] * 64)]  # a repeated row, a repeated id, equal vectors
    table_of(spark, good + BAD + [(9006, [1.0] * 65)], tmp_path)
    out = cluster.op13_integer_centroids(spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    got = clustered(out.collect())
    assert got == lloyd(good, 40, 5)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT vec_id, embedding FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        assert sorted(db.sql(cluster.ORACLE_SQL["op13_integer_centroids"]).fetchall()) == got


def test_fewer_vectors_than_centroids_null_ids_and_ties(spark):
    """Two vectors as far from both centroids go to the first; negative sums are rounded down."""
    rows = [(None, [-0.5, 0.0]), (1, [-0.01, 0.02]), (2, [0.5, 0.0]), (3, [0.0, 0.0]), (3, [0.0, 0.0])]
    got = clustered(cluster.described(*cluster.cluster(table_of(spark, rows), k=2, rounds=3, dim=2)).collect())
    assert got == lloyd(rows, 2, 3)
    assert clustered(cluster.described(*cluster.cluster(table_of(spark, rows), k=50, rounds=2, dim=2)).collect()) == lloyd(rows, 50, 2)


def test_no_vectors_give_no_rows(spark):
    for rows in ([], BAD):
        assert cluster.described(*cluster.cluster(table_of(spark, rows))).collect() == []


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="component beyond"):
        cluster.cluster(table_of(spark, [(1, [1e9, 0.0])]), dim=2)


# --- whitening ----------------------------------------------------------------------------------------------------------------


def by_hand(vectors, k):
    """(ids, deviations, whitened, shares) from the whole covariance."""
    x = np.floor(64 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (x - s // n) - (s % n) / n
    values, vectors_ = np.linalg.eigh(c.T @ c / n)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return dev, (c @ vectors_) / np.sqrt(values), values / np.trace(c.T @ c / n)


def compare(out, vectors, k):
    frame = out.toPandas().sort_values(["vec_id", "component"])
    dev, z, share = by_hand(vectors, k)
    order = np.argsort([i for i, _ in vectors], kind="stable")
    assert len(frame) == len(vectors) * k and set(frame.component) == set(range(1, k + 1)) and set(frame.n) == {len(vectors)}
    got = frame.whitened.to_numpy().reshape(-1, k)
    assert np.abs(got * np.sign((got * z[order]).sum(0)) - z[order]).max() < 1e-8
    assert frame.deviation.to_numpy().reshape(-1, k)[:, 0].tolist() == [dev[i] for i in order]
    assert np.allclose(frame.explained.to_numpy()[:k], share, rtol=1e-12) and frame.identity_error.nunique() == 1 and frame.identity_error.max() < 1e-10


def test_whitening_of_the_contract(spark, tmp_path):
    rng = np.random.default_rng(9)
    vectors = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(900, 64)) * np.linspace(0.1, 0.2, 64) + 3 * (rng.integers(0, 9, 900) == 4)[:, None]).astype(np.float32))]
    vectors.append((1000, vectors[7][1]))
    table_of(spark, vectors + BAD, tmp_path)
    out = whiten.op12_chebyshev_whitening(spark, str(tmp_path))
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    compare(out, vectors, 32)


@pytest.mark.parametrize("spectrum", ["flat", "steep", "gap", "equal", "deficient"])
@pytest.mark.parametrize("dim", [64, 300])
def test_the_iteration_finds_the_largest_eigenpairs(spectrum, dim):
    rng = np.random.default_rng(dim)
    u = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    values = {"flat": np.linspace(1, 0.9, dim), "steep": 0.7 ** np.arange(dim), "gap": np.r_[np.full(3, 100.0), np.linspace(2, 1, dim - 3)], "equal": np.ones(dim), "deficient": np.r_[np.linspace(5, 4, 10), np.zeros(dim - 10)]}[spectrum]
    v = (u * values) @ u.T
    passes = []

    def times(q):
        passes.append(q.shape[1])
        return v @ q

    got, components = whiten.eigenpairs(times, dim, 32)
    assert np.abs(got - values[:32]).max() < 1e-11 * values[0] and np.abs(components.T @ components - np.eye(32)).max() < 1e-12
    assert np.linalg.norm(v @ components - components * got, axis=0).max() < 1e-10 * values[0] and len(passes) < 200
    if dim > 100:
        assert max(passes) < dim  # never the whole covariance


def test_short_vectors_lengths_apart_and_components_without_variance(spark):
    two = [(1, [0.5, 1.0]), (2, [1.0, 1.0]), (None, [2.0, 1.0]), (2, [1.0, 1.0])]
    three = [(7, [0.1, 0.2, 0.3])]
    rows = whiten.whiten(table_of(spark, two + three + BAD[:2])).collect()
    a = [r for r in rows if r.vec_id != 7]
    assert len(a) == 4 * 2 and {r.n for r in a} == {4} and all((r.whitened is None) == (r.component == 2) for r in a)
    assert all(abs(r.explained - (r.component == 1)) < 1e-12 for r in a) and abs(sum(r.whitened for r in a if r.component == 1)) < 1e-12
    b = [r for r in rows if r.vec_id == 7]
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(b, key=lambda r: r.component)] == [(c, 1, 0, None, None) for c in (1, 2, 3)]


def test_no_vectors_to_whiten(spark):
    for rows in ([], BAD[:2]):
        out = whiten.whiten(table_of(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []


def test_deviations_are_exact_beyond_doubles():
    m = whiten.Moments(3_000_000_001, [3_000_000_001 * 1_000_007 + 5], None)
    x = np.array([[1_000_003], [1_000_400]])
    assert m.deviations(x) == [(3_000_000_001 * int(v) - m.sums[0]) ** 2 if (3_000_000_001 * int(v) - m.sums[0]) ** 2 < 2**63 else None for v in x[:, 0]]
    small = whiten.Moments(11, [11 * 1_000_007 + 5], None)
    assert small.deviations(x) == [(11 * int(v) - small.sums[0]) ** 2 for v in x[:, 0]]
