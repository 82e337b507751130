import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttera.config import RAW_FRONTEND, FrontendConfig
from uttera.functions import audio
from uttera.operators import features, signal
from uttera.plans import warm
from uttera.sources import records


def wav(samples, rate=16000, width=2, channels=1):
    out = io.BytesIO()
    scale = {1: 127, 2: 32767, 4: 2147483647}[width]
    kind = {1: "<u1", 2: "<i2", 4: "<i4"}[width]
    data = np.round(np.asarray(samples) * scale) + (128 if width == 1 else 0)
    with wave.open(out, "wb") as clip:
        clip.setnchannels(channels)
        clip.setsampwidth(width)
        clip.setframerate(rate)
        clip.writeframes(data.astype(kind).tobytes())
    return out.getvalue()


def sine(seconds=0.3, hz=440.0, rate=16000):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.fixture(scope="module")
def clips(spark):
    rows = [
        ("mono", wav(sine())), ("byte", wav(sine(), width=1)), ("wide", wav(sine(), width=4)),
        ("stereo", wav(np.repeat(sine(), 2), channels=2)), ("slow", wav(sine(rate=8000), rate=8000)),
        ("broken", b"RIFFxxxxWAVE"), ("text", b"hello"), ("cut", wav(sine())[:1000]),
    ]
    return spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "utterance_id string, audio_bytes binary").cache()


def test_probe(clips):
    got = {r["utterance_id"]: (r["num_samples"], r["sample_rate"], r["status"]) for r in signal.probe_audio(clips).collect()}
    assert got["mono"] == got["byte"] == got["wide"] == got["stereo"] == (4800, 16000, "pcm")
    assert got["slow"] == (2400, 8000, "pcm") and got["cut"] == (478, 16000, "pcm")
    assert got["broken"] == (0, 0, "broken") and got["text"] == (0, 0, "unknown")
    assert signal.prevalidate(clips).count() == 7 and signal.prevalidate(clips, known=True).count() == 6
    assert signal.prevalidate(clips).columns == clips.columns


def test_probe_walks_chunks_of_any_kind(spark):
    plain = wav(sine())
    form, rest = plain[12:36], plain[36:]
    chunk = lambda kind, body: kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    extensible = chunk(b"fmt ", form[8:] + (22).to_bytes(2, "little") + b"\0" * 22)
    files = {
        "list": plain[:36] + chunk(b"LIST", b"INFOodd") + rest,
        "fmt18": plain[:12] + chunk(b"fmt ", form[8:] + b"\0\0") + rest,
        "fmt40": plain[:12] + extensible + chunk(b"fact", b"\0" * 4) + chunk(b"LIST", b"x" * 5000) + rest,
        "before": plain[:12] + chunk(b"JUNK", b"j" * 28) + plain[12:],
        "stereo8": wav(np.repeat(sine(), 2), width=1, channels=2)[:36] + chunk(b"bext", b"b") + wav(np.repeat(sine(), 2), width=1, channels=2)[36:],
        "streamed": plain[:40] + b"\xff\xff\xff\xff" + plain[44:],
    }
    bad = {
        "no data": plain[:36], "no fmt": plain[:12] + rest, "no rate": plain[:24] + b"\0" * 4 + plain[28:], "no sound": plain[:40] + b"\0" * 4,
    }
    other = {"flac": b"fLaC" + plain, "empty": b"", "riff": b"RIFF\0\0\0\0AVI " + plain[12:], "crowded": plain[:36] + chunk(b"note", b"") * 100 + rest}
    rows = [(k, bytearray(b)) for k, b in {**files, **bad, **other}.items()] + [("null", None)]
    df = spark.createDataFrame(rows, "utterance_id string, audio_bytes binary")
    got = {r["utterance_id"]: (r["num_samples"], r["sample_rate"], r["status"]) for r in signal.probe_audio(df).collect()}
    assert {k: got[k] for k in files} == {k: (4800, 16000, "pcm") for k in files}
    assert {k: got[k] for k in bad} == {k: (0, 0, "broken") for k in bad}
    assert {k: got[k] for k in [*other, "null"]} == {k: (0, 0, "unknown") for k in [*other, "null"]}
    assert {r[0] for r in signal.prevalidate(df).select("utterance_id").collect()} == {*files, *other, "null"}


def test_decode(clips):
    good = signal.prevalidate(clips, known=True).filter("utterance_id <> 'cut'")
    got = {r["utterance_id"]: np.array(r["samples"]) for r in signal.decode_wav(good).collect()}
    for name, error in (("mono", 1e-4), ("byte", 1e-2), ("wide", 1e-6), ("stereo", 1e-4)):
        assert np.abs(got[name] - sine()).max() < error, name


def test_log_mel(clips):
    decoded = signal.decode_wav(signal.prevalidate(clips, known=True).filter("utterance_id in ('mono', 'slow')"))
    out = signal.log_mel(decoded, RAW_FRONTEND).collect()
    for name in ("mono", "slow"):
        m = np.array([r["features"] for r in sorted((r for r in out if r["utterance_id"] == name), key=lambda r: r["frame"])])
        assert m.shape == (31, 80)
        # 440 Hz lies in the filter whose centre is nearest
        centres = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 82)[1:-1] / 2595) - 1)
        assert abs(int(np.median(m.argmax(axis=1))) - int(np.abs(centres - 440).argmin())) <= 1
    spread = signal.log_mel(decoded)
    m = np.array([r["features"] for r in spread.filter("utterance_id = 'mono'").collect()])
    assert np.abs(m.mean(axis=0)).max() < 1e-4 and np.abs(m.std(axis=0) - 1).max() < 1e-2
    per_frame = signal.log_mel(decoded, FrontendConfig(normalize_per_frame=True)).first()["features"]
    assert abs(np.mean(per_frame)) < 1e-5


def test_frame_estimate_agrees_with_the_job(spark):
    for n in (1, 100, 399, 400, 401, 1600, 16000, 16001):
        m = signal.log_mel_matrix(np.random.default_rng(n).standard_normal(n), 16000, RAW_FRONTEND, signal.mel_filters(RAW_FRONTEND))
        want = spark.range(1).select(audio.estimate_frames(F.lit(n), F.lit(16000))).first()[0]
        assert len(m) == want


def test_fbank(clips):
    decoded = signal.decode_wav(signal.prevalidate(clips, known=True).filter("utterance_id = 'mono'"))
    m = np.array([r["features"] for r in signal.fbank_stacked(decoded).orderBy("frame").collect()])
    frames = 1 + (4800 - 400) // 160
    assert m.shape == (-(-frames // 2), 160)
    m = signal.fbank_matrix(np.random.default_rng(2).standard_normal(4800) * 0.1, 16000)
    flat = m.reshape(-1, 80)[:frames]
    assert np.abs(flat.mean(axis=0)).max() < 1e-4 and np.abs(flat.var(axis=0, ddof=1) - 1).max() < 1e-2
    odd = signal.fbank_matrix(sine()[: 400 + 160 * 2], 16000)
    assert (odd[-1, 80:] == 1.0).all()
    assert signal.fbank_matrix(sine()[:399], 16000).shape == (0, 160)


def test_augmentation_repeats(clips):
    decoded = signal.decode_wav(signal.prevalidate(clips, known=True).filter("utterance_id <> 'cut'"))
    first = {r["utterance_id"]: r["samples"] for r in signal.augment_waveform(decoded).collect()}
    again = {r["utterance_id"]: r["samples"] for r in signal.augment_waveform(decoded.repartition(5)).collect()}
    other = {r["utterance_id"]: r["samples"] for r in signal.augment_waveform(decoded, epoch=1).collect()}
    assert first == again and first != other
    assert all(len(first[k]) == len(again[k]) and max(map(abs, first[k])) <= 1.0 for k in first)
    same = {r["utterance_id"]: r["samples"] for r in signal.augment_waveform(decoded, speed_prob=0, noise_prob=0, reverb_prob=0).collect()}
    assert same["mono"] == decoded.filter("utterance_id = 'mono'").first()["samples"]


def test_noise_level_and_echo():
    x = sine(1.0) * 0.5
    noisy = signal.add_noise(x, 20.0, np.random.default_rng(1))
    assert 10 * np.log10(np.mean(x**2) / np.mean((noisy - x) ** 2)) == pytest.approx(20.0, abs=0.5)
    pulse = np.zeros(1000)
    pulse[0] = 1.0
    echo = signal.add_reverb(pulse, 16000, 0.5, 10.0)
    assert np.flatnonzero(echo).tolist() == [0, 160, 320, 480]
    assert echo.sum() == pytest.approx(1.0) and echo[160] / echo[0] == pytest.approx(0.5)


def counts(df):
    out = {}
    for r in df.collect():
        out[r["outcome"]] = out.get(r["outcome"], 0) + r["n"]
        assert (r["error"] is not None) == (r["outcome"] == "failed")
    return out


def test_warming(spark, clips, tmp_path):
    path = str(tmp_path / "feats")
    assert counts(warm.extract_features(clips, path, 1)) == {"written": 6, "failed": 2}
    assert counts(warm.extract_features(clips, path, 2)) == {"hit": 6, "failed": 2}
    log = spark.read.schema(warm.LOG).parquet(path)
    row = log.filter("rows = 31").first()
    assert (row["cols"], len(row["values"])) == (80, 31 * 80)
    gone = log.filter("not deleted").select("key").distinct().orderBy("key").limit(2)
    features.append_features(gone.withColumn("values", F.lit(None).cast("array<float>")), path, 3, deleted=True)
    assert counts(warm.extract_features(clips, path, 4)) == {"written": 2, "hit": 4, "failed": 2}
    assert counts(warm.extract_features(clips, path, 5, overwrite=True)) == {"written": 6, "failed": 2}
    with pytest.raises(Exception):
        warm.extract_features(clips, str(tmp_path / "strict"), 1, fail_fast=True).collect()


def test_warming_does_implausible_features_again(spark, clips, tmp_path):
    path = str(tmp_path / "feats")
    warm.extract_features(clips, path, 1)
    log = spark.read.schema(warm.LOG).parquet(path)
    bad = log.filter("not deleted").select("key").distinct().orderBy("key").limit(1).withColumns(
        {"rows": F.lit(10**6), "cols": F.lit(80), "values": F.array(F.lit(0.0).cast("float")), "error": F.lit(None).cast("string")}
    )
    features.append_features(bad, path, 2)
    assert counts(warm.extract_features(clips, path, 3)) == {"written": 1, "hit": 5, "failed": 2}
    assert counts(warm.extract_features(clips, path, 4)) == {"hit": 6, "failed": 2}


def test_warming_of_hits_moves_no_bytes(spark, clips, tmp_path):
    plan = warm.cache_hits(
        signal.probe_audio(clips.withColumnRenamed("utterance_id", "key")).select("key", "num_samples", "sample_rate"),
        spark.createDataFrame([], warm.LOG), FrontendConfig(),
    )._jdf.queryExecution().executedPlan().toString()
    assert all("audio_bytes" not in line for line in plan.splitlines() if "Exchange" in line)


def test_audio_files(spark, clips, tmp_path):
    for name in ("a.wav", "b.wav", "c.txt"):
        (tmp_path / name).write_bytes(wav(sine()))
    found = records.read_audio(spark, str(tmp_path), "*.wav")
    assert found.count() == 2
    assert signal.probe_audio(found).select("num_samples").distinct().collect()[0][0] == 4800


def test_opus(spark):
    rows = [("a.OPUS", None), ("a.bin", b"x" * 65000 + b"OpusHead"), ("a.bin", b"x" * 65536 + b"OpusHead"), (None, b"none")]
    df = spark.createDataFrame([(p, None if b is None else bytearray(b)) for p, b in rows], "p string, b binary")
    assert [r[0] for r in df.select(audio.is_opus(F.col("p"), F.col("b"))).collect()] == [True, True, False, False]


def test_opus_behind_a_url_and_refused(spark):
    paths = ["http://h/a.opus?x=1", "https://h/a.OPUS#t", "http://h/a.wav?f=b.opus", "dir.opus/a", "a.opus?x"]
    df = spark.createDataFrame([(p, None) for p in paths], "audio_path string, audio_bytes binary")
    assert [r[0] for r in df.select(audio.is_opus(F.col("audio_path"), F.col("audio_bytes"))).collect()] == [True, True, False, False, False]
    assert audio.refuse_opus(df.filter("audio_path like 'dir%'")).count() == 1
    with pytest.raises(Exception, match="Opus cannot be decoded here: http://h/a.opus"):
        audio.refuse_opus(df.limit(1)).count()
