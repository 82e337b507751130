import math

import pytest
from pyspark.sql import functions as F

from uttera.config import BatchConfig, FilterConfig, FrontendConfig, SplitConfig
from uttera.functions import audio
from uttera.operators import audit, quality, splits


def judge(spark, rows, schema, cfg=FilterConfig(), **kw):
    df = spark.createDataFrame(rows, schema).withColumn("row_index", F.monotonically_increasing_id())
    return quality.with_rejection(df, cfg, **kw)


def test_first_failing_check_wins(spark):
    good = "привіт світе"
    rows = [
        ("ok", good, "a.wav", 1.0),
        ("no text", "  ", None, None),
        ("no audio", good, None, None),
        ("no duration", good, "a.wav", None),
        ("zero", good, "a.wav", 0.0),
        ("nan", good, "a.wav", math.nan),
        ("short", good, "a.wav", 0.001),
        ("long", good, "a.wav", 31.0),
        ("symbols", "a!!!", "a.wav", 1.0),
        ("no letters", "--", "a.wav", 1.0),
        ("too long", "x" * 401, "a.wav", 1.0),
    ]
    got = {r["utterance_id"]: r["reject_reason"] for r in judge(spark, rows, "id string, sentence string, path string, duration double").collect()}
    assert got == {
        "ok": None, "no text": "missing_transcript", "no audio": "missing_audio", "no duration": "missing_duration",
        "zero": "missing_duration", "nan": "missing_duration", "short": "audio_too_short", "long": "audio_too_long",
        "symbols": "symbol_ratio", "no letters": "no_alnum", "too long": "too_long",
    }


def test_too_short_text(spark):
    rows = [("a", "hi", "p", 1.0)]
    out = judge(spark, rows, "id string, text string, path string, duration double", FilterConfig(min_chars=3)).first()
    assert out["reject_reason"] == "too_short"


def test_alignment_outliers(spark):
    rows = [("utt0", "hello world", "a", 1.5), ("utt1", "hello world", "b", 0.2), ("utt2", "hello world", "c", 8.0)]
    cfg = FilterConfig(min_chars_per_second=2.0, max_chars_per_second=20.0)
    out = judge(spark, rows, "id string, sentence string, path string, duration double", cfg)
    assert [r["utterance_id"] for r in quality.usable(out).collect()] == ["utt0"]


def test_derived_columns(spark):
    rows = [(None, "Текст", "clip.wav", "1.0", "spk")]
    out = judge(
        spark, rows, "id string, sentence string, path string, duration string, speaker string", base=F.lit("/data/")
    ).first()
    assert (out["num_samples"], out["estimated_frames"]) == (16000, 101)
    assert out["audio_path"] == out["utterance_id"] == "/data/clip.wav"
    assert (out["speaker_id"], out["has_speaker_id"], out["transcript"]) == ("spk", True, "текст")


def test_embedded_audio_and_urls(spark):
    rows = [
        ("a", "t t", None, (bytearray(b"x"), "in.wav"), 1.0),
        ("b", "t t", "http://h/c.wav", (bytearray(b"x"), None), 1.0),
        ("c", "t t", None, (None, None), 1.0),
    ]
    schema = "id string, text string, path string, audio struct<bytes:binary,path:string>, duration double"
    out = {r["utterance_id"]: r for r in judge(spark, rows, schema, base=F.lit("base")).collect()}
    assert out["a"]["audio_path"] == "base/in.wav" and bytes(out["a"]["audio_bytes"]) == b"x"
    assert out["b"]["audio_path"] == "http://h/c.wav" and out["b"]["audio_bytes"] is None
    assert out["c"]["reject_reason"] == "missing_audio"


def test_bare_binary_audio(spark):
    out = judge(spark, [("a", "t t", bytearray(b"x"), 1.0)], "id string, text string, audio binary, duration double").first()
    assert out["reject_reason"] is None and bytes(out["audio_bytes"]) == b"x"


def test_half_even_rounding_and_floors(spark):
    rows = [(0.5 / 16000,), (1.5 / 16000,), (2.5 / 16000,), (0.0,)]
    got = [r[0] for r in spark.createDataFrame(rows, "d double").select(audio.num_samples(F.col("d"))).collect()]
    assert got == [1, 2, 2, 1]


def test_summary_counts_every_row(spark):
    rows = [("a", "hello", "p", 1.0, "s"), ("b", "", "p", 1.0, "s"), ("c", "hello", None, 1.0, "s")]
    out = judge(spark, rows, "id string, sentence string, path string, duration double, source string")
    row = audit.loader_summary(splits.assign_split(out, SplitConfig(validation=0.0, test=0.0))).first()
    assert row["scanned"] == 3 and row["selected"] == 1
    assert sum(row[f"skipped_{r}"] for r in quality.REASONS) == 2


def test_audit(spark):
    rows = [("train", "s1", True, 16000), ("train", None, False, 32000), ("validation", "s1", True, 0), ("test", "s2", True, 8000)]
    df = spark.createDataFrame(rows, "split string, speaker_id string, has_speaker_id boolean, num_samples bigint").withColumn(
        "sample_rate", F.lit(16000)
    )
    overlap = {r["pair"]: r["shared_speakers"] for r in audit.speaker_overlap(df).collect()}
    assert overlap == {"train_vs_validation": 1, "train_vs_test": 0, "validation_vs_test": 0}
    table = audit.split_audit(df)
    assert audit.speaker_balance(table).first()[0] == 1.0
    assert audit.split_totals(table).first()["speaker_id_available"] is False
    hours = {r["split"]: r["hours"] for r in table.collect()}
    assert hours["train"] == 3 / 3600 and hours["validation"] == 0.0


def test_frames_count_where_samples_are_unknown(spark):
    rows = [("a", 0, 0, 200), ("a", 16000, 16000, 101), ("b", 16000, 16000, 101)]
    df = spark.createDataFrame(rows, "split string, num_samples bigint, sample_rate int, estimated_frames bigint")
    got = {r["split"]: round(r["hours"] * 3600, 6) for r in audit.duration_hours(df, ["split"]).collect()}
    assert got == {"a": 3.01, "b": 1.0}


def test_external_validation(spark):
    a = spark.createDataFrame([("u1", None), ("u2", None)], "utterance_id string, speaker_id string")
    plan = splits.split_plan(a, a.limit(1))
    assert sorted(r["split"] for r in plan.collect()) == ["train", "train", "validation"]


@pytest.mark.parametrize(
    "make",
    [
        lambda: FilterConfig(min_chars=-1),
        lambda: FilterConfig(max_symbol_ratio=1.5),
        lambda: FilterConfig(min_duration=2.0, max_duration=1.0),
        lambda: FilterConfig(max_chars_per_second=math.nan),
        lambda: SplitConfig(validation=0.6, test=0.6),
        lambda: SplitConfig(validation=-0.1),
        lambda: FrontendConfig(win_length=512, n_fft=400),
        lambda: BatchConfig(batch_size=0),
        lambda: BatchConfig(max_frames=10, max_duration_sec=1.0),
        lambda: BatchConfig(adaptive_budget=10, adaptive_unit="words"),
    ],
)
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_batch_mode_order():
    assert BatchConfig(adaptive_budget=5).mode == "adaptive"
    assert BatchConfig(max_duration_sec=5.0, bucket_by_length=True).mode == "duration"
    assert BatchConfig(max_frames=5).mode == "frames"
    assert BatchConfig(bucket_by_length=True).mode == "length"
    assert BatchConfig().mode == "fixed"


def test_refusals_of_parameter_rows_are_those_of_the_config(spark):
    import itertools
    import math

    names = ["min_chars", "max_chars", "max_symbol_ratio", "min_duration", "max_duration", "min_words_per_second"]
    rows = list(itertools.product([-1.0, 2.0], [1.0, 5.0], [0.5, 1.5, math.nan], [None, -1.0, 3.0], [math.nan, 2.0, math.inf], [None, math.nan, 1.0]))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    told = df.select(*names, quality.refusal(df).alias("told")).collect()

    def by_config(row):
        try:
            FilterConfig(**{n: v for n, v in zip(names, row, strict=True) if v is not None})
        except ValueError as error:
            return str(error)
        return None

    assert len(told) == len(rows)
    assert all(r["told"] == by_config(tuple(r)[:-1]) for r in told)
    plain = spark.range(1)
    assert plain.select(quality.refusal(plain)).first()[0] is None
