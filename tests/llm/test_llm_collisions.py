import numpy as np
import pytest
from pyspark.sql import functions as F

from uttera.llm import collisions

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"


def brute(ids, vectors, every, k):
    out = {}
    for i, x in zip(ids, vectors, strict=True):
        if i % every == 0:
            rest = [(float(np.sqrt(((np.asarray(v, float) - x) ** 2).sum())), j) for j, v in zip(ids, vectors, strict=True) if j != i and len(v) == len(x)]
            out[i] = sorted(rest)[:k]
    return out


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 0, 0.0, "x") for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_recall_against_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, spread, (15, 24))
    vectors = (centres[rng.integers(0, 15, 1200)] + rng.normal(0, 1, (1200, 24))).astype(np.float32)
    vectors[300:700] = vectors[5]  # a crowd of equal vectors
    ids = np.arange(1200)
    want = brute(ids, vectors, 20, 10)
    got = {}
    for r in collisions.neighbours(frame(spark, ids, vectors), every=20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert got.keys() == want.keys()
    assert all(sorted(g) == list(range(1, 11)) and [g[k] for k in sorted(g)] == sorted(g.values()) for g in got.values())
    hits = sum(len({i for _, i in got[q].values()} & {i for _, i in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.97
    exact = {i: v for i, v in zip(ids, vectors.astype(float), strict=True)}
    assert all(abs(s - np.linalg.norm(exact[q] - exact[i])) < 1e-9 for q in got for s, i in got[q].values())


def test_crowd_of_equal_vectors_is_ranked_by_id(spark):
    vectors = [[1.0, 2.0]] * 40 + [[1.0, 2.1]]
    got = collisions.neighbours(frame(spark, range(41), vectors), every=20, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 3), (20, 0), (20, 1), (20, 2), (40, 0), (40, 1), (40, 2)]


def test_unusable_vectors_few_candidates_and_dimensions(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]),
            (100, [0.0, 0.0]), (200, [5.0, 5.0, 5.0]), (8, [3e38, -3e38]), (300, [1e-38, 0.0]), (1, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in collisions.neighbours(df).collect())
    assert got == [(0, 1, 1), (0, 2, 300), (0, 3, 1), (0, 4, 8), (300, 1, 0), (300, 2, 1), (300, 3, 1), (300, 4, 8)]
    assert collisions.neighbours(df.limit(0)).count() == 0
    assert collisions.neighbours(df.filter("vec_id = 1")).count() == 0


def test_queries_and_arrays_in_blocks_give_the_same(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, range(400), rng.normal(size=(400, 8)))
    asked = df.filter(F.col("vec_id") % 20 == 0)
    whole = sorted(map(tuple, collisions.nearest(df, asked).collect()))
    parts = sorted(map(tuple, collisions.nearest(df, asked, index_rows=50, block=7).collect()))
    assert len(whole) == 200 and len(set(whole) & set(parts)) >= 198


def test_sample_table_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, vectors = [r["vec_id"] for r in table], [r["embedding"] for r in table]
    want = brute(ids, [np.asarray(v, float) for v in vectors], 100, 10)
    got = {}
    for r in collisions.neighbours(frame(spark, ids, vectors)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) / sum(map(len, want.values())) >= 0.9
