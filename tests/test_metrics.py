import pytest
from pyspark.sql import functions as F

from uttera.operators import metrics
from uttera.plans import evaluate as plan


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


PAIRS = [
    ("u1", "це короткий тест", "це тест", "s1"),
    ("u2", "a b c d e f", "a x c d f f", "s1"),
    ("u3", "same text", "same text", "s2"),
    ("u4", "", "extra words", "s2"),
    ("u5", "all gone", "", None),
    ("u6", " ".join(f"w{i}" for i in range(400)), " ".join(f"w{i}" for i in range(0, 800, 2)), ""),
    ("u7", "😀 b", "b 😀", "s3"),
]


@pytest.fixture(scope="module")
def edits(spark):
    df = spark.createDataFrame(PAIRS, "utterance_id string, ref string, hyp string, speaker_id string")
    return metrics.with_edits(df.withColumn("has_speaker_id", F.col("speaker_id").isNotNull())).cache()


def test_edits(edits):
    got = {r["utterance_id"]: r for r in edits.collect()}
    for name, ref, hyp, _ in PAIRS:
        row = got[name]
        assert row["word_edits"] == distance(ref.split(), hyp.split()), name
        assert row["char_edits"] == distance(ref, hyp), name
        assert (row["ref_words"], row["ref_chars"]) == (len(ref.split()), len(ref))


def test_more_words_than_one_plane_of_characters(spark):
    """Over 55,296 different words: codes jump over the surrogate range."""
    ref = " ".join(f"w{i}" for i in range(57000))
    assert len(set(ref.split())) > 0xD800 - 0x100
    df = spark.createDataFrame([("a b " + ref, "a " + ref)], "ref string, hyp string").select(
        F.expr("array_distinct(split(ref, ' '))").alias("d")
    )
    coded = df.select(metrics._as_characters(F.slice("d", 55000, 600), F.col("d")).alias("c")).first()["c"]
    assert len(set(coded)) == 600


def test_rates(edits):
    words = sum(distance(r.split(), h.split()) for _, r, h, _ in PAIRS)
    total = sum(len(r.split()) for _, r, _, _ in PAIRS)
    row = metrics.eval_rollup(edits).filter("scope = 'overall'").first()
    assert row["wer"] == pytest.approx(words / total) and row["samples"] == len(PAIRS)


def test_speakers(edits):
    per = {r["speaker_id"]: r["wer"] for r in metrics.speaker_metrics(edits).collect()}
    assert set(per) == {"s1", "s2", "s3"}
    row = metrics.speaker_summary(edits).first()
    assert row["speaker_count"] == 3 and row["missing_speaker_id_samples"] == 2
    assert row["speaker_id_available"] is False
    assert row["speaker_macro_wer"] == pytest.approx(sum(per.values()) / 3)


def test_nothing_to_evaluate(spark, edits):
    none = edits.limit(0)
    assert metrics.wer(none.select("ref", "hyp")).first()["wer"] == 0.0
    assert metrics.speaker_summary(none).first()["speaker_macro_wer"] == 0.0
    row = metrics.bucket_metrics(none).first()
    assert row["samples_short"] == 0 and row["wer_short"] is None
    assert metrics.decode_debug(none).first()["decoded_empty_fraction"] == 0.0


def pairing(spark, refs, hyps):
    return spark.createDataFrame(refs, "utterance_id string, ref string"), spark.createDataFrame(hyps, "utterance_id string, hyp string")


def test_strict_pairing(spark):
    refs, hyps = pairing(spark, [("a", "x"), ("b", "y"), ("c", "z"), ("c", "z")], [("a", "x"), ("c", "z"), ("d", "q")])
    states = {r["utterance_id"]: r["state"] for r in metrics.pair_ref_hyp(refs, hyps, strict=False).collect()}
    assert states == {"a": "paired", "b": "ref_only", "c": "repeated", "d": "hyp_only"}


@pytest.mark.parametrize(
    ("refs", "hyps", "told"),
    [
        ([("a", "x"), ("b", "y")], [("a", "x")], "unpaired utterance: b"),
        ([("a", "x")], [("a", "x"), ("b", "y")], "unpaired utterance: b"),
        ([("a", "x"), ("b", "y")], [("a", "x"), ("b", "y"), ("b", "y")], "repeated utterance: b"),
        ([("a", "x"), (None, "y")], [("a", "x"), (None, "y")], "unpaired utterance: null"),
    ],
)
def test_strict_pairing_fails_whatever_is_read_of_it(spark, refs, hyps, told):
    for report in (metrics.wer, metrics.cer, metrics.decode_debug):
        with pytest.raises(Exception, match=told):
            report(metrics.pair_ref_hyp(*pairing(spark, refs, hyps))).collect()


def test_a_missing_text_is_empty(spark):
    rows = [("x y z", None), (None, "q r"), (None, None), ("same", "same")]
    df = spark.createDataFrame(rows, "ref string, hyp string")
    got = [(r["word_edits"], r["ref_words"], r["char_edits"], r["ref_chars"]) for r in metrics.with_edits(df).collect()]
    assert got == [(3, 3, 5, 5), (2, 0, 3, 0), (0, 0, 0, 0), (0, 1, 0, 4)]
    assert metrics.wer(df).first()["wer"] == 5 / 4 and metrics.cer(df).first()["cer"] == 8 / 9


def test_word_distance_against_brute_force(spark):
    import random

    random.seed(4)
    some = lambda: " ".join(random.choices("abcd", k=random.randint(0, 9)))
    rows = [(some(), some()) for _ in range(300)] + [("a a", "a"), ("a", "a a"), ("a b a", "a"), ("a  b", "a b")]
    df = spark.createDataFrame(rows, "ref string, hyp string")
    for r in metrics.with_word_edits(df).collect():
        assert r["word_edits"] == distance(r["ref"].split(), r["hyp"].split()), r


def test_each_rate_pays_for_its_own_side_only(spark):
    df = spark.createDataFrame([("a", "b")], "ref string, hyp string")
    for report, other in ((metrics.wer, "levenshtein(ref"), (metrics.cer, "__wa")):
        assert other not in report(df)._jdf.queryExecution().optimizedPlan().toString()


def test_shard_losses(spark):
    shards = spark.createDataFrame([(2.0, 1), (18.0, 3)], "loss double, n bigint")
    assert metrics.merge_partials(shards, ["loss"], "n").first()["loss"] == 5.0
    assert metrics.merge_partials(shards.limit(0), ["loss"], "n").first()["loss"] is None


def test_starvation_rule(spark):
    rows = [(0, 0.1, 0.0, 0.9), (1, 0.1, 0.0, 0.9), (500, 0.5, 0.001, 0.9), (2, 0.1, 0.01, 0.9), (501, 0.1, 0.0, 0.9), (3, 0.1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "s int, b double, a double, t double")
    got = [r[0] for r in df.select(metrics.starvation_rule(F.col("s"), F.col("b"), F.col("a"), F.col("t"))).collect()]
    assert got == [False, True, False, False, False, False]


def test_evaluation_plan(spark, tmp_path):
    refs = spark.createDataFrame([(u, r, s, s is not None) for u, r, _, s in PAIRS], "utterance_id string, ref string, speaker_id string, has_speaker_id boolean")
    hyps = spark.createDataFrame([(u, h) for u, _, h, _ in PAIRS], "utterance_id string, hyp string")
    reports = plan.evaluate(refs, hyps, str(tmp_path / "report"), examples=3)
    assert reports["examples"].count() == 6
    import json

    text = spark.read.text(str(tmp_path / "report" / "speaker_summary")).first()[0]
    assert json.loads(text)["speaker_count"] == 3
