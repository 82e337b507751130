"""The bucketed feature log: results of the plain log, and plans that leave the log where it lies."""

import pytest
from pyspark.sql import functions as F

from uttera.operators import feature_log, features

SCHEMA = "key string, version bigint, row bigint, deleted boolean, rows int, values array<float>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log_rows(n=600):
    rows = []
    for i in range(n):
        gone = i % 7 == 3
        rows.append((f"k{i * i % 97}", i // 5, i, gone, None if gone else i % 50, None if gone else [float(i)]))
    return rows


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "log")
    feature_log.create(spark, path, "rows int, values array<float>", 8)
    rows = log_rows()
    for start in range(0, len(rows), 200):
        feature_log.append(spark.createDataFrame(rows[start : start + 200], SCHEMA), path)
    return path, spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_state_needs_no_exchange_and_equals_the_plain_log(spark, stored):
    path, plain = stored
    found = feature_log.latest(spark, path, ["rows", "values"])
    assert "Exchange" not in plan_of(found) and "Bucketed: true" in plan_of(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, features.latest_state(plain, ["rows", "values"]).collect()))
    assert "Exchange" in plan_of(features.latest_state(plain, ["rows", "values"]))


def test_joins_move_the_records_alone(spark, stored, no_broadcast):
    path, plain = stored
    items = spark.range(500).select("id", F.concat(F.lit("k"), F.col("id") % 120).alias("key"))
    state = features.latest_state(plain, ["values"])
    pairs = (
        (feature_log.lookup(items, path, ["values"]), features.join_features(items, state.drop("version"))),
        (feature_log.missing(items, path), features.cache_miss(items, state)),
    )
    for found, want in pairs:
        plan = plan_of(found)
        assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(key" in plan  # that of the records
        assert plan.split("Exchange hashpartitioning")[0].count("Bucketed: true") + plan.split("Exchange hashpartitioning")[1].count("Bucketed: true") == 1
        assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        below = plan.split("Exchange hashpartitioning")[1]
        assert "Range" in below.split("Bucketed: true")[0]


def test_tables_of_equal_buckets_are_joined_without_any_exchange(spark, stored, tmp_path, no_broadcast):
    path, _ = stored
    items = spark.range(300).select("id", F.concat(F.lit("k"), F.col("id") % 120).alias("key"))
    beside = feature_log.write_beside(items, path, str(tmp_path / "items"))
    for found in (feature_log.lookup(beside, path, ["values"]), feature_log.missing(beside, path)):
        assert "Exchange" not in plan_of(found)
    assert feature_log.lookup(beside, path, ["values"]).count() == 300


def test_a_file_for_each_bucket_and_append(spark, stored, tmp_path):
    path, _ = stored
    names = feature_log.read(spark, path).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(names) <= 3 * 8


def test_compaction_moves_the_pointer_and_later_versions_win(spark, stored):
    path, plain = stored
    want = sorted(map(tuple, features.latest_state(plain, ["values"]).collect()))
    old = feature_log.read(spark, path)
    assert feature_log.compact(spark, path) == len(want) == feature_log.read(spark, path).count()
    assert old.count() == 600  # readers of the files before go on
    assert sorted(map(tuple, feature_log.latest(spark, path, ["values"]).collect())) == want
    feature_log.append(spark.createDataFrame([("k0", [1.0]), ("new", [2.0]), ("new", [3.0])], "key string, values array<float>").coalesce(1), path, 10**6)
    feature_log.append(spark.createDataFrame([("k1",)], "key string"), path, 10**6, deleted=True)
    now = {r["key"]: r["values"] for r in feature_log.latest(spark, path, ["values"]).collect()}
    assert now["k0"] == [1.0] and now["new"] == [3.0] and "k1" not in now


def test_another_session_opens_the_log_in_its_buckets(spark, stored):
    path, plain = stored
    for known in spark.catalog.listTables(pattern="uttera_*"):
        spark.sql(f"DROP TABLE {known.name}")  # as in an application that has not seen it
    other = spark.newSession()
    found = feature_log.latest(other, path, ["rows"])
    assert "Exchange" not in plan_of(found)
    assert found.count() == features.latest_state(plain, ["rows"]).count()


def test_refusals_and_empty_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    with pytest.raises(FileNotFoundError):
        feature_log.read(spark, path)
    with pytest.raises(ValueError):
        feature_log.create(spark, path, "value double", 0)
    feature_log.create(spark, path, "value double", 4)
    with pytest.raises(FileExistsError):
        feature_log.create(spark, path, "value double")
    assert feature_log.latest(spark, path, ["value"]).count() == 0
    items = spark.createDataFrame([("a",), (None,)], "key string")
    assert feature_log.missing(items, path).count() == 2 and feature_log.lookup(items, path, ["value"]).filter("hit").count() == 0
    with pytest.raises(Exception, match="no key"):
        feature_log.append(spark.createDataFrame([(None, 1.0)], "key string, value double"), path, 1)
    assert feature_log.compact(spark, path) == 0 and feature_log.latest(spark, path, ["value"]).count() == 0
