import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttera.functions import arrays
from uttera.operators import ctc, decode, features, ngram, vectors

SCHEMA = "utterance_id int, frame bigint, logits array<double>"


def logs(*probs):
    return [math.log(p) if p > 0 else -1e9 for p in probs]


def test_logit_golden(spark):
    df = spark.createDataFrame([(0, 0, [3.0, 1.0, 0.0]), (0, 1, [0.5, 2.0, 1.0])], SCHEMA)
    row = ctc.logit_stats(df).first()
    assert (row["avg_top_logit"], row["avg_top2_margin"], row["avg_blank_logit"], row["avg_blank_nonblank_margin"]) == (
        2.5, 1.5, 1.75, 0.25,
    )
    assert ctc.logit_stats(df.limit(0)).first()["decoded_frames"] == 0


def test_infinite_gap_does_not_overflow(spark):
    df = spark.createDataFrame([(0, 0, [1000.0, -1000.0])], SCHEMA)
    assert ctc.log_softmax(df).first()["log_probs"] == [0.0, -2000.0]


def test_encoder_golden(spark):
    df = spark.createDataFrame([(0, 0, [1.0 - math.sqrt(2), 1.0 + math.sqrt(2)])], SCHEMA)
    row = ctc.encoder_stats(df).first()
    assert row["avg_mean"] == pytest.approx(1.0) and row["avg_std"] == pytest.approx(math.sqrt(2))


def test_feasibility(spark):
    rows = [(0, [5, 5], 1), (1, [5, 5], 2), (2, [5, 5], 3), (3, [5], 1), (4, [], 0)]
    df = spark.createDataFrame(rows, "utterance_id int, ids array<int>, n int")
    got = {r["utterance_id"]: (r["min_frames"], r["impossible"], r["tight"]) for r in ctc.ctc_feasible(df).collect()}
    assert got == {0: (3, True, True), 1: (3, True, True), 2: (3, False, True), 3: (1, False, True), 4: (0, False, True)}
    two = ctc.ctc_length_summary(df.filter("utterance_id < 2")).first()
    assert (two["impossible_sample_fraction"], two["tight_sample_fraction"]) == (1.0, 1.0)


@pytest.fixture(scope="module")
def labels(spark):
    data = {0: [0, 1, 1, 0, 1, 2, 2, 2, 0], 1: [0, 0, 0], 2: [3], 3: [1] * 40 + [2] * 30}
    rows = [(u, f, x) for u, xs in data.items() for f, x in enumerate(xs)]
    return data, spark.createDataFrame(rows, "utterance_id int, frame bigint, label int").repartition(5).cache()


def test_greedy_and_segments(spark, labels):
    data, df = labels
    vocab = spark.createDataFrame([(i, chr(96 + i)) for i in (1, 2, 3)], "id int, token string")
    got = {r["utterance_id"]: r["hyp"] for r in ctc.ctc_greedy(df, vocab, chunk=4).collect()}
    assert got == {0: "aab", 1: "", 2: "c", 3: "ab"}
    runs = sorted((r["utterance_id"], r["start"], r["end"], r["label"]) for r in ctc.ctc_segments(df, chunk=4).collect())
    assert runs == [(0, 1, 3, 1), (0, 4, 5, 1), (0, 5, 8, 2), (2, 0, 1, 3), (3, 0, 40, 1), (3, 40, 70, 2)]
    marks = sorted((r["utterance_id"], r["frame"]) for r in ctc.boundaries(df, chunk=4).filter("boundary = 1.0").collect())
    want = [(u, f) for u, xs in data.items() for f in range(len(xs) - 1) if xs[f] != xs[f + 1]]
    assert marks == want
    ids = spark.createDataFrame([(u, xs) for u, xs in data.items()], "u int, ids array<int>")
    kept = {r["u"]: r["k"] for r in ids.select("u", arrays.collapse_ids(F.col("ids")).alias("k")).collect()}
    assert kept == {0: [1, 1, 2], 1: [], 2: [3], 3: [1, 2]}


def test_compress(spark, labels):
    _, df = labels
    frames = df.withColumn("logits", F.array(F.col("frame") * 1.0, F.col("label") * 1.0))
    out = ctc.compress_segments(frames, 2, chunk=4).collect()
    got = sorted((r["utterance_id"], -1 if r["start"] is None else r["start"], r["vector"]) for r in out)
    assert got == [
        (0, 1, [1.5, 1.0]), (0, 4, [4.0, 1.0]), (0, 5, [6.0, 2.0]), (1, -1, [0.0, 0.0]), (2, 0, [0.0, 3.0]),
        (3, 0, [19.5, 1.0]), (3, 40, [54.5, 2.0]),
    ]


def test_uniform_alignment_and_ranges(spark):
    df = spark.createDataFrame([([7, 8], 10), ([], 3), ([7], 0)], "ids array<int>, n int")
    got = [r[0] for r in df.select(arrays.uniform_alignment(F.col("ids"), F.col("n"))).collect()]
    states = [0, 7, 0, 8, 0]
    assert got == [[states[t * 5 // 10] for t in range(10)], [0, 0, 0], []]


def test_stacking(spark):
    df = spark.createDataFrame([(0, i, [float(i)]) for i in range(3)], SCHEMA)
    got = [r["stacked"] for r in ctc.stack_frames(df, 2, pad=9.0).orderBy("slot").collect()]
    assert got == [[0.0, 1.0], [2.0, 9.0]]


def frames_of(spark, tables):
    rows = [(u, f, [float(x) for x in p]) for u, ps in tables.items() for f, p in enumerate(ps)]
    return spark.createDataFrame(rows, "utterance_id int, frame bigint, log_probs array<double>").repartition(3)


def test_beam_golden(spark):
    tables = {0: [logs(0.1, 0.8, 0.1), logs(0.7, 0.2, 0.1), logs(0.6, 0.3, 0.1)], 1: [logs(0.6, 0.4, 0.0)]}
    frames = frames_of(spark, tables)
    plain = {r["utterance_id"]: r["hyp"] for r in decode.beam_decode(frames, ["", "a", "b"]).collect()}
    assert plain == {0: "a", 1: ""}
    bonus = {r["utterance_id"]: r["hyp"] for r in decode.beam_decode(frames, ["", "a", "b"], length_bonus=2.0).collect()}
    assert bonus[1] == "a"


def test_beam_equals_full_search(spark):
    """With a wide beam the best text has the highest summed path probability."""
    import itertools

    rng = np.random.default_rng(4)
    probs = {u: rng.dirichlet(np.ones(3), size=4) for u in range(6)}
    frames = frames_of(spark, {u: np.log(p) for u, p in probs.items()})
    got = {r["utterance_id"]: r["hyp"] for r in decode.beam_decode(frames, ["", "a", "b"], width=200).collect()}
    for u, p in probs.items():
        totals = {}
        for path in itertools.product(range(3), repeat=4):
            text = "".join("_ab"[x] for i, x in enumerate(path) if x and (i == 0 or path[i - 1] != x))
            totals[text] = totals.get(text, 0.0) + math.prod(p[i][x] for i, x in enumerate(path))
        assert got[u] == max(totals, key=totals.get)


def test_beam_with_scorer(spark):
    frames = frames_of(spark, {0: [logs(0.02, 0.49, 0.49)]})
    out = decode.beam_decode(frames, ["", "a", "b"], scorer=lambda t: 5.0 if t.endswith("b") else 0.0, lm_weight=1.0)
    assert out.first()["hyp"] == "b"


def test_alignment_equals_full_search(spark):
    import itertools

    rng = np.random.default_rng(5)
    tables = {u: np.log(rng.dirichlet(np.ones(3), size=5)) for u in range(5)}
    ids = {0: [1], 1: [1, 2], 2: [1, 1], 3: [], 4: [2, 1]}
    targets = spark.createDataFrame(list(ids.items()), "utterance_id int, ids array<int>")
    out = decode.viterbi_align(frames_of(spark, tables), targets).collect()
    for u, p in tables.items():
        path = [r["label"] for r in sorted((r for r in out if r["utterance_id"] == u), key=lambda r: r["frame"])]
        fits = [
            x for x in itertools.product(range(3), repeat=5)
            if [t for i, t in enumerate(x) if t and (i == 0 or x[i - 1] != t)] == ids[u]
        ]
        best = max(fits, key=lambda x: sum(p[i][t] for i, t in enumerate(x)))
        assert path == list(best), u


def test_scorer_plugin(spark):
    df = spark.createDataFrame([("abc",), ("",)], "t string")
    got = [r[0] for r in df.select(decode.scorer_column("uttera.catalog.decoding:length_scorer:2", F.col("t"))).collect()]
    assert got == [6.0, 0.0]
    with pytest.raises(TypeError):
        decode.resolve_scorer("uttera.operators.decode:NEG")
    with pytest.raises(ModuleNotFoundError):
        decode.resolve_scorer("no_such_module:x")


def test_nbest(spark):
    rows = [(0, [1], -800.0), (0, [1], -800.0), (0, [2], -799.8), (0, [1, 2], -1500.0), (0, [3], -2000.0)]
    df = spark.createDataFrame(rows, "utterance_id int, tokens array<int>, log_prob double")
    merged = ngram.merge_nbest(df, 3)
    top = merged.orderBy("rank").collect()
    assert [r["tokens"] for r in top] == [[1], [2], [1, 2]]
    assert top[0]["log_prob"] == pytest.approx(-800.0 + math.log(2))
    assert ngram.best_hypothesis(merged).first()["tokens"] == [1, 2]


def test_log_add_exp(spark):
    inf = float("-inf")
    df = spark.createDataFrame([(0.0, 0.0), (inf, 1.0), (inf, inf), (1000.0, -1000.0)], "a double, b double")
    got = [r[0] for r in df.select(arrays.log_add_exp(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(math.log(2)), 1.0, inf, 1000.0]


def test_latest_state_ways_agree(spark):
    rows = [("a", 1, False, 1.0), ("a", 2, True, None), ("b", 1, True, None), ("b", 3, False, 3.0), ("c", 1, False, 5.0)]
    log = spark.createDataFrame(rows, "key string, version bigint, deleted boolean, value double")
    want = [("b", 3, 3.0), ("c", 1, 5.0)]
    assert sorted(map(tuple, features.latest_state(log, ["value"]).collect())) == want
    assert sorted(map(tuple, features.latest_wide(log).collect())) == want


def test_latest_state_on_equal_versions(spark, tmp_path):
    plain = spark.createDataFrame([("a", 1, False, 1.0), ("a", 1, True, None), ("b", 2, False, 2.0)], "key string, version bigint, deleted boolean, value double")
    want = [("b", 2, 2.0)]
    assert sorted(map(tuple, features.latest_state(plain, ["value"]).collect())) == want
    path = str(tmp_path / "log")
    features.append_features(spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 3.0)], "key string, value double").coalesce(1), path, 7, shards=2)
    log = spark.read.parquet(path)
    want = [("x", 7, 2.0), ("y", 7, 3.0)]
    assert sorted(map(tuple, features.latest_state(log, ["value"]).collect())) == want
    assert sorted(map(tuple, features.latest_wide(log).select("key", "version", "value").collect())) == want


def test_spec_augment_masks_whole_bands(spark):
    rows = [(u, f, [1.0] * 20) for u in range(4) for f in range(60)]
    df = spark.createDataFrame(rows, "u int, f bigint, x array<double>")
    lengths = df.groupBy("u").agg(F.count("*").alias("length"))
    args = ("u", "f", "x", 20, 13, 0)
    out = vectors.spec_augment(df, lengths, *args, freq_width=6).orderBy("u", "f")
    got = np.array([r["x"] for r in out.collect()]).reshape(4, 60, 20)
    again = vectors.spec_augment(df.repartition(7), lengths, *args, freq_width=6).orderBy("u", "f")
    assert (np.array([r["x"] for r in again.collect()]).reshape(4, 60, 20) == got).all()
    for m in got:
        rows_off, cols_off = (m == 0).all(axis=1), (m == 0).all(axis=0)
        assert ((m == 0) == (rows_off[:, None] | cols_off[None, :])).all()
        assert rows_off.sum() <= 5 * 3 and cols_off.sum() <= 12
