import json

import pytest
from pyspark.sql import functions as F

from uttera.config import FilterConfig
from uttera.operators import features
from uttera.plans import prepare as plan
from uttera.sources import manifests, records


def write_tsv(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join("\t".join(r) for r in [header, *rows]) + "\n", encoding="utf-8")


@pytest.fixture()
def corpus(tmp_path):
    root = tmp_path / "corpus"
    write_tsv(root / "b" / "two.tsv", ["path", "text", "speaker"], [["c.wav", "третій  текст", "s1"]])
    write_tsv(root / "a" / "one.TSV", ["path", "sentence", "id", "duration"], [["a.wav", " Це   Тест ", "utt0", "1.0"], ["b.wav", "«інший»", "utt1", "2"]])
    return root


def test_discovery_prefers_tsv(spark, corpus):
    spark.range(3).write.parquet(str(corpus / "z.parquet"))
    found = manifests.discover(spark, str(corpus))
    assert [p.rsplit("/", 1)[1] for p in found] == ["one.TSV", "two.tsv"]
    assert len(manifests.discover(spark, str(corpus / "z.parquet"))) >= 1
    with pytest.raises(FileNotFoundError):
        manifests.read_manifests(spark, str(corpus.parent / "corpus" / "z.parquet" / "_SUCCESS"))


def test_tsv_with_different_columns(spark, corpus):
    rows = {r["path"]: r for r in manifests.read_manifests(spark, str(corpus)).collect()}
    assert set(rows) == {"a.wav", "b.wav", "c.wav"}
    assert rows["a.wav"]["sentence"] == " Це   Тест " and rows["a.wav"]["duration"] == "1.0"
    assert rows["c.wav"]["speaker"] == "s1" and rows["c.wav"]["id"] is None


def test_row_index_over_many_files(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = [f"r{i:05d}" for i in range(3000)]
        for n, part in enumerate((lines[:1200], lines[1200:1210], lines[1210:])):
            write_tsv(tmp_path / f"f{n}.tsv", ["id"], [[x] for x in part])
        df = manifests.with_row_index(manifests.read_tsv(spark, str(tmp_path)))
        got = sorted((r["row_index"], r["id"]) for r in df.collect())
        assert got == list(enumerate(lines))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_optional_parquet_columns(spark, tmp_path):
    spark.createDataFrame([("a", 1.0)], "id string, duration double").write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([("b", "s")], "id string, speaker string").write.parquet(str(tmp_path / "y"))
    df = manifests.read_parquet(spark, [str(tmp_path / "x"), str(tmp_path / "y")])
    assert set(df.columns) == {"id", "duration", "speaker"} and df.count() == 2


def test_sources_in_order_with_global_limit(spark):
    a = spark.createDataFrame([("utt0",), ("utt1",)], "id string").withColumn("row_index", F.monotonically_increasing_id())
    b = spark.createDataFrame([("utt2",), ("utt3",)], "id string").withColumn("row_index", F.monotonically_increasing_id())
    from uttera.operators.ranking import limit_selected

    union = manifests.union_sources([a.coalesce(1), b.coalesce(1), a], ["a", "b", "a"])
    assert union.count() == 4
    assert sorted(r["id"] for r in limit_selected(union, 3).collect()) == ["utt0", "utt1", "utt2"]


def test_corpus(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" one \n\n \t\ntwo\n", encoding="utf-8")
    assert [r["text"] for r in manifests.read_lines(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]
    df = spark.createDataFrame([(3, "це тест"), (1, " Це   Тест "), (2, ""), (0, "x")], "row_index int, sentence string")
    texts = manifests.corpus_texts(df, dedup=True).orderBy("row_index").collect()
    assert [(r["row_index"], r["text"]) for r in texts] == [(0, "x"), (1, "це тест")]
    assert manifests.corpus_texts(df, dedup=False, n=2).count() == 2
    assert manifests.corpus_texts(df, dedup=True, lowercase=False).count() == 3


def test_record_table_is_reused_only_if_whole(spark, tmp_path):
    path, built = str(tmp_path / "records"), []

    def build():
        built.append(1)
        return spark.range(20).withColumn("split", F.when(F.col("id") < 5, "test").otherwise("train"))

    for _ in range(2):
        assert records.open_or_build(spark, path, build).count() == 20
    assert len(built) == 1
    old = records.read_records(spark, path)
    assert records.open_or_build(spark, path, build, {"seed": 1}).count() == 20 and len(built) == 2
    assert old.count() == 20  # a reader of the version before is not disturbed
    assert records.open_or_build(spark, path, build, {"seed": 1}).count() == 20 and len(built) == 2
    folder = records.current(spark, path)["folder"]
    next((tmp_path / "records" / folder / "split=test").glob("*.parquet")).unlink()
    assert not records.is_complete(spark, path, {"seed": 1})
    assert records.open_or_build(spark, path, build, {"seed": 1}).count() == 20 and len(built) == 3
    (tmp_path / "records" / records.CURRENT).write_text("{")
    assert not records.is_complete(spark, path, {"seed": 1})


def test_a_failed_build_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "records")
    records.write_records(spark.range(3).withColumn("split", F.lit("train")), path)
    bad = spark.range(5).withColumn("split", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        records.write_records(bad, path)
    assert records.read_records(spark, path).count() == 3 and records.is_complete(spark, path)


def test_preview_takes_what_can_be_decoded(spark, tmp_path):
    from test_signal import sine, wav

    rows = [(i, bytearray(b"x" if i % 2 else wav(sine())), f"a/{i}.wav", f"u{i}", "t") for i in range(10)]
    df = spark.createDataFrame(rows, "row_index int, audio_bytes binary, audio_path string, utterance_id string, transcript string")
    out = records.write_preview(df.withColumn("source_ord", F.lit(0)), 3, str(tmp_path / "p"))
    assert sorted((r["index"], r["row_index"], r["file"]) for r in out.collect()) == [(0, 0, "sample_000000_a_0"), (1, 2, "sample_000001_a_2"), (2, 4, "sample_000002_a_4")]
    listed = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "p" / "manifest")).collect()]
    assert [x["utterance_id"] for x in sorted(listed, key=lambda x: x["index"])] == ["u0", "u2", "u4"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", None, [1, 2])], "k string, n int, xs array<int>")
    records.write_report(df, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"k": "a", "n": None, "xs": [1, 2]}


def test_feature_shards(spark, tmp_path):
    keys = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit(1.0).alias("value"))
    path = str(tmp_path / "log")
    features.append_features(keys, path, 1, shards=8)
    for r in spark.read.parquet(path).select("key", "shard").limit(50).collect():
        assert int(r["key"][:8], 16) % 8 == r["shard"]
    assert features.latest_state(spark.read.parquet(path), ["value"]).count() == 500


def test_payload(spark):
    df = spark.createDataFrame([("k", 2, 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.5])], "key string, rows int, cols int, values array<float>")
    cell = features.encode_payload(df, ["key"])
    raw = bytes(cell.first()["payload"])
    assert raw[:16] == b"SFCF32L1" + (2).to_bytes(4, "little") + (3).to_bytes(4, "little") and len(raw) == 40
    assert features.decode_payload(cell, ["key"]).collect() == df.collect()
    for damaged in (raw[:-1], b"other" + raw, raw[:10]):
        with pytest.raises(Exception, match="payload"):
            features.decode_payload(spark.createDataFrame([("k", bytearray(damaged))], "key string, payload binary"), ["key"]).collect()


def test_vocab_export(spark):
    table = spark.createDataFrame([("<blank>", 0), ("b", 2), ("a", 1)], "token string, id int")
    assert json.loads(records.export_vocab(table).first()[0]) == {"type": "character", "symbols": ["a", "b"]}


def test_first_hit(spark):
    feats = spark.createDataFrame([("k1", 1.0), ("k2", 2.0)], "key string, value double")
    recs = spark.createDataFrame([(1, ["x", "k2", "k1"]), (2, ["x"]), (3, ["k1"])], "id int, keys array<string>")
    got = {r["id"]: (r["hit_key"], r["value"]) for r in features.join_first_hit(recs, feats, "id", "keys", "value").collect()}
    assert got == {1: ("k2", 2.0), 2: (None, None), 3: ("k1", 1.0)}


def test_preparation_plan(spark, tmp_path):
    rows = [[f"c{i}.wav", f"текст номер {i}", f"spk{i % 12}", "1.0"] for i in range(24)] + [["x.wav", "", "spk", "1"]]
    write_tsv(tmp_path / "data" / "m.tsv", ["path", "sentence", "client_id", "duration"], rows)
    out = plan.prepare(spark, [str(tmp_path / "data")], str(tmp_path / "out"), FilterConfig())
    assert out["records"].count() == 24
    assert sum(r["shared_speakers"] for r in out["overlap"].collect()) == 0
    assert out["summary"].first()["skipped_missing_transcript"] == 1
    assert out["vocab"].filter("id = 0").first()["token"] == "<blank>"
    assert out["records"].first()["audio_path"].endswith(".wav")
    again = plan.prepare(spark, [str(tmp_path / "data")], str(tmp_path / "out"), FilterConfig())
    assert again["records"].count() == 24
    few = plan.prepare(spark, [str(tmp_path / "data")], str(tmp_path / "few"), FilterConfig(), max_samples=5)
    assert sorted(r["row_index"] for r in few["records"].collect()) == [0, 1, 2, 3, 4]


def test_preparation_checks_audio_and_takes_a_validation_source(spark, tmp_path):
    from test_signal import sine, wav

    audio = tmp_path / "audio"
    audio.mkdir()
    for i in range(8):
        (audio / f"c{i}.wav").write_bytes(b"RIFF\0\0\0\0WAVE" if i == 3 else b"OggS" if i == 4 else wav(sine()))
    rows = [[str(audio / f"c{i}.wav"), f"text number {i}", f"spk{i}", "1.0"] for i in range(10)]
    write_tsv(tmp_path / "train" / "m.tsv", ["path", "sentence", "client_id", "duration"], rows)
    write_tsv(tmp_path / "valid" / "m.tsv", ["path", "sentence", "client_id", "duration"], rows[:2])
    out = plan.prepare(
        spark, [str(tmp_path / "train")], str(tmp_path / "out"), validation_roots=[str(tmp_path / "valid")], audio_root=str(audio)
    )
    got = sorted((r["split"], r["audio_path"][-6:], r["num_samples"], r["sample_rate"]) for r in out["records"].collect())
    want = [("train", f"c{i}.wav", 16000 if i == 4 else 4800, 16000) for i in (0, 1, 2, 4, 5, 6, 7)]
    assert got == want + [("validation", f"c{i}.wav", 4800, 16000) for i in (0, 1)]
    assert plan.prepare(spark, [str(tmp_path / "train")], str(tmp_path / "out"), embedded_only=True)["records"].count() == 0
    plain = plan.prepare(spark, [str(tmp_path / "train")], str(tmp_path / "out"), FilterConfig(min_chars=99))
    assert plain["records"].count() == 0 and plain["summary"].first()["skipped_too_short"] == 10


def test_scratch_is_removed_on_demand(spark):
    from pathlib import Path

    from uttera.session import clear_scratch, scratch_path

    clear_scratch(spark)
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    scratch_path(spark, "never-written")
    assert clear_scratch(spark) == 1 and not Path(path.removeprefix("file://").removeprefix("file:")).exists()
    assert clear_scratch(spark) == 0


def test_no_machine_local_scratch_on_a_cluster(monkeypatch):
    from uttera import session

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_audio_listing_reads_no_bytes_and_pushes_the_size(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.wav").write_bytes(bytes(10 * i + 1))
    found = records.read_audio(spark, str(tmp_path), "*.wav")
    small = found.filter("size < 15")
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThan(length,15)]" in plan or "LessThan(length,15)" in plan
    listing = found.select("path", "size")
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert sorted(r["size"] for r in listing.collect()) == [1, 11, 21, 31]
    assert sorted(len(r["audio_bytes"]) for r in small.collect()) == [1, 11]


def test_first_hit_sorts_nothing_at_crowded_keys(spark):
    """rows of a key that very many records name are neither sorted nor aggregated where the key lies."""
    feats = spark.createDataFrame([("k1", 1.0), ("k2", 2.0)], "key string, value double")
    recs = spark.createDataFrame([(1, ["x", "k2", "k1"]), (2, ["x"]), (3, ["k1"]), (4, None)], "id int, keys array<string>")
    joined = features.join_first_hit(recs, feats, "id", "keys", "value")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [key" in plan and "SortAggregate" not in plan
    assert joined.columns == ["id", "keys", "hit_key", "value"]
    assert {r["id"]: r["hit_key"] for r in joined.collect()} == {1: "k2", 2: None, 3: "k1", 4: None}
