"""Block-wise operators against plain Python, with blocks small enough to matter."""

import random

import pytest
from pyspark.sql import functions as F

from uttera.operators import batching, ranking, sequence


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # key "hot" holds more than a third of all rows; null is a key too
    data = [(rng.choice(["hot", "hot", "b", "c", None]), i * 3, rng.randint(0, 5)) for i in range(500)]
    return data, spark.createDataFrame(data, "k string, i bigint, v int").repartition(7).cache()


def test_rank_in_group(rows):
    data, df = rows
    got = {r["i"]: r["rank"] for r in sequence.rank_in_group(df, ["k"], "i", chunk=50).collect()}
    seen = {}
    for k, i, _ in data:
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == seen[k]


def test_dense_position(rows):
    data, df = rows
    out = sequence.dense_position(df, "i", total="n", chunk=64).collect()
    assert sorted((r["i"], r["pos"], r["n"]) for r in out) == [(i, p, 500) for p, (_, i, _) in enumerate(data)]


def test_running_sum_and_min(rows):
    data, df = rows
    sums = {r["i"]: r["s"] for r in sequence.running_sum(df, ["k"], "i", F.col("v"), "s", chunk=40).collect()}
    best = {r["i"]: (r["best"], r["improved"]) for r in ranking.best_so_far(df, "k", "i", "v", chunk=40).collect()}
    total, low = {}, {}
    for k, i, v in data:
        total[k] = total.get(k, 0) + v
        better = k not in low or v < low[k]
        low[k] = min(low.get(k, v), v)
        assert sums[i] == total[k]
        assert best[i] == (low[k], better)


@pytest.mark.parametrize("step", [-1, 1])
def test_neighbour(spark, step):
    data = [(u, f, (u * 7 + f * 5) % 4) for u in range(3) for f in range(33)]
    df = spark.createDataFrame(data, "u int, f bigint, v int").repartition(5)
    got = {(r["u"], r["f"]): r["x"] for r in sequence.neighbour(df, ["u"], "f", {"v": "x"}, step, chunk=8).collect()}
    want = {(u, f): v for u, f, v in data}
    assert len(got) == len(data)
    for u, f, _ in data:
        assert got[u, f] == want.get((u, f + step))


def naive(items, cost):
    """Row-by-row greedy packing; ``cost(batch)`` must stay within 1.0 unless it holds one row."""
    batches = [[]]
    for item in items:
        if batches[-1] and cost([*batches[-1], item]) > 1.0:
            batches.append([])
        batches[-1].append(item)
    return {item[0]: b for b, batch in enumerate(batches) for item in batch}


@pytest.mark.parametrize("seed", range(4))
def test_packing_equals_row_by_row(spark, seed):
    rng = random.Random(seed)
    hot = rng.randint(1, 40)
    data = [
        (i * 2, hot if rng.random() < 0.4 else rng.randint(0, 40), rng.choice([0, 160, 1600, 4800]), rng.randint(0, 9))
        for i in range(300)
    ]
    df = spark.createDataFrame(data, "row_index bigint, estimated_frames bigint, num_samples bigint, token_length bigint")
    df = df.withColumn("sample_rate", F.lit(16000)).repartition(6)
    budget = rng.randint(30, 200)

    def got(out):
        return {r["row_index"]: r["batch_id"] for r in out.collect()}

    by_frames = sorted(data, key=lambda r: (r[1], r[0]))
    by_time = sorted(data, key=lambda r: (r[2], r[1], r[0]))
    by_both = sorted(data, key=lambda r: (r[1], r[3], r[0]))
    size = rng.randint(2, 9)
    assert got(batching.batch_max_frames(df, budget)) == naive(
        by_frames, lambda b: len(b) * max(max(1, r[1]) for r in b) / budget
    )
    assert got(batching.batch_length(df, size)) == naive(by_frames, lambda b: len(b) / size)
    assert got(batching.batch_duration(df, 0.5)) == naive(by_time, lambda b: sum(r[2] for r in b) / 8000)
    assert got(batching.batch_adaptive(df, "tokens", 25)) == naive(by_both, lambda b: sum(max(1, r[3]) for r in b) / 25)
    assert got(batching.batch_adaptive(df, "frames", budget)) == naive(
        by_both, lambda b: sum(max(1, r[1]) for r in b) / budget
    )
    assert got(batching.batch_fixed(df, size, chunk=64)) == naive(sorted(data), lambda b: len(b) / size)


def test_packing_of_a_million_different_lengths(spark):
    n, budget = 1_000_000, 50_000_000
    df = spark.range(n).select(
        F.col("id").alias("row_index"), (F.col("id") * 7919 % n + 1).alias("num_samples"), F.lit(16000).alias("sample_rate"),
        F.lit(10).cast("bigint").alias("estimated_frames"),
    )
    out = batching.batch_duration(df, budget / 16000)
    per = out.groupBy("batch_id").agg(F.min("num_samples").alias("low"), F.max("num_samples").alias("high"), F.sum("num_samples").alias("s"))
    rows = sorted(map(tuple, per.collect()))
    want, start = [], 1
    while start <= n:
        end = start
        while end < n and (start + end + 1) * (end + 2 - start) // 2 <= budget:
            end += 1
        want.append((len(want), start, end, (start + end) * (end + 1 - start) // 2))
        start = end + 1
    assert rows == want


def test_packing_of_odd_tables(spark):
    schema = "row_index bigint, estimated_frames bigint, num_samples bigint, sample_rate int, token_length bigint"
    zeros = spark.createDataFrame([(i, 0, 0, 0, 0) for i in range(50)], schema).repartition(4)
    assert {r["batch_id"] for r in batching.batch_duration(zeros, 1.0).collect()} == {0}
    huge = spark.createDataFrame([(i, 10**6, 10**9, 16000, 10**6) for i in range(30)], schema).repartition(4)
    for out in (batching.batch_duration(huge, 1.0), batching.batch_adaptive(huge, "tokens", 5), batching.batch_max_frames(huge, 5)):
        assert sorted(r["batch_id"] for r in out.collect()) == list(range(30))
    assert batching.batch_duration(huge.limit(0), 1.0).count() == 0


def test_golden_budgets(spark):
    rows = [(0, 45), (1, 20), (2, 40), (3, 25)]
    df = spark.createDataFrame(rows, "row_index bigint, estimated_frames bigint")
    out = {r["row_index"]: r["batch_id"] for r in batching.batch_max_frames(df, 90).collect()}
    assert out == {1: 0, 3: 0, 2: 1, 0: 1}


@pytest.mark.parametrize(
    "n, mode, want",
    [
        (9, "uneven", [[0, 3, 6], [1, 4, 7], [2, 5, 8]]),
        (10, "uneven", [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]),
        (10, "drop_last", [[0, 3, 6], [1, 4, 7], [2, 5, 8]]),
        (10, "pad", [[0, 3, 6, 9], [1, 4, 7, 0], [2, 5, 8, 1]]),
    ],
)
def test_sharding(spark, n, mode, want):
    df = spark.range(n).withColumnRenamed("id", "row_index").repartition(3)
    out = batching.shard_rows(df, 3, mode, chunk=4).collect()
    ranks = [[r["row_index"] for r in sorted(out, key=lambda r: r["slot"]) if r["rank"] == w] for w in range(3)]
    assert ranks == want


def test_epoch_shuffle_is_a_repeatable_permutation(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("utterance_id"))
    first = {r["utterance_id"]: r["pos"] for r in ranking.epoch_shuffle(df, 1, 0).collect()}
    again = {r["utterance_id"]: r["pos"] for r in ranking.epoch_shuffle(df.repartition(9), 1, 0).collect()}
    other = {r["utterance_id"]: r["pos"] for r in ranking.epoch_shuffle(df, 1, 1).collect()}
    assert sorted(first.values()) == list(range(200)) and first == again != other


def test_collate(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0, 2.0, 3.0]), (1, [5.0]), (1, None)], "batch_id int, x array<double>")
    got = sorted((r["batch_id"], r["length"], r["x"]) for r in batching.collate(df, "x", pad=-1.0).collect())
    assert got == [(0, 1, [1.0, -1.0, -1.0]), (0, 3, [1.0, 2.0, 3.0]), (1, 1, [5.0])]


def test_progress_interval(spark):
    df = spark.createDataFrame([(0,), (10,), (100_000,), (10**9,)], "n bigint")
    assert [r[0] for r in df.select(ranking.progress_interval(F.col("n"))).collect()] == [1, 1000, 5000, 50000]
    watched, watch = ranking.observed(df, "rows")
    watched.collect()
    assert watch.get["rows"] == 4


def test_hardest_prefers_small_gaps(spark):
    rows = [("a", "abc", "abc"), ("b", "abcdef", "a"), ("c", "abc", "abd"), ("d", "abcd", "abc")]
    df = spark.createDataFrame(rows, "utterance_id string, ref string, hyp string")
    assert [r[0] for r in ranking.hardest(df, 3).collect()] == ["c", "d", "b"]
