import math

import numpy as np
import pytest

from uttera.llm import catalog
from uttera.llm import whitening as wh


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64])
@pytest.mark.parametrize("kind", ["full", "clustered", "graded", "diagonal", "low rank"])
def test_principal_axes_against_the_library(d, kind):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    q, _ = np.linalg.qr(a)
    spectrum = {"clustered": np.where(np.arange(d) < d // 2, 3.0, 1.0), "graded": 10.0 ** -np.arange(d), "low rank": np.where(np.arange(d) < max(1, d // 3), 2.0, 0.0)}
    m = a @ a.T if kind == "full" else np.diag(np.arange(d) + 1.0) if kind == "diagonal" else (q * spectrum[kind]) @ q.T
    m = (m + m.T) / 2
    values, vectors = wh.principal_axes(m, 32)
    want = np.linalg.eigvalsh(m)[::-1][: len(values)]
    assert len(values) == min(32, d) or kind in ("graded", "low rank")
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() <= 1e-13
    assert np.abs(m @ vectors.T - vectors.T * values).max() <= 1e-13 * want[0]


def test_sturm_counts_and_reflections():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    diagonal, off, _ = wh.tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)), values)
    shifts = rng.uniform(values[0] - 1, values[-1] + 1, 50)
    assert (wh.below(diagonal, off, shifts) == (values[None, :] < shifts[:, None]).sum(axis=1)).all()


def plain(vectors, k=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    y = ((n * x - s) / n).astype(float)
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, [sum(int(v) ** 2 for v in row) for row in n * x - s], y @ axes / np.sqrt(values), values / np.trace(cov)


def test_query_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 40)) * np.linspace(1, 3, 40) + rng.normal(size=40)).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(vectors)]
    broken = [(900, None, 1), (901, [1.0] * 39 + [None], 1), (902, [float("nan")] * 40, 1), (903, [float("inf")] * 40, 1)]
    spark.createDataFrame([*rows, *broken], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.op12_householder_whitening(spark, str(tmp_path)).collect()
    n, deviation, whitened, explained = plain(vectors)
    assert len(got) == 300 * 32 and {r["n"] for r in got} == {n}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in got)
    w = np.zeros((300, 32))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-12
    assert np.abs(np.abs(w) - np.abs(whitened)).max() < 1e-8
    assert (np.abs((w * whitened).mean(axis=0)) > 0.999).all()  # one sign for a whole component
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_odd_vectors_have_defined_results(spark):
    rows = [(1, [0.0, 1.0], "a", 0), (2, [1.0, 1.0], "b", 0), (2, [1.0, 1.0], "b", 0), (None, [0.5, 1.0], "c", 0), (3, [], "d", 0), (4, [7.0], "e", 0), (5, None, "f", 0), (6, [1.0, 2.0, 3.0], "g", 0), (7, [1.0, 2.0, 3.5], "h", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, n int")
    axes = wh.fit(df)
    assert {d: (a.n, len(a.eigenvalues)) for d, a in axes.items()} == {1: (1, 0), 2: (4, 1), 3: (2, 1)}
    got = wh.whiten(df, axes).select("record.vec_id", "record.whitened", "n", "deviation", "whitened").collect()
    assert sorted((str(r[0]), r[1], r[2], len(r[4])) for r in got) == [("1", "a", 4, 1), ("2", "b", 4, 1), ("2", "b", 4, 1), ("4", "e", 1, 0), ("6", "g", 2, 1), ("7", "h", 2, 1), ("None", "c", 4, 1)]
    assert all(e < 1e-12 for e in wh.identity_errors(df, axes).values())
    assert wh.fit(df.limit(0)) == {} and wh.whiten(df, {}).count() == 0


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [3e15, 2.0]), (4, [1e300, 0.0])]
    df = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    axes = wh.fit(df)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows[:3]]
    assert axes[2].sums == tuple(map(sum, zip(*x, strict=True)))
    assert {r["deviation"] for r in wh.whiten(df, axes).collect()} == {None}  # beyond the range of longs
    whole = wh.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert whole[2].sums[0] == sum(r[0] for r in x) + wh.LONGEST + wh.SHIFT
