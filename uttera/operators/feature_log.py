"""A feature log that is read without shuffling it.

Rows are kept in files by the hash of their key (Spark buckets, sorted by key inside a file). Whatever is worked out
by key - the latest state, a join with records, the records without features - then takes the log as it lies: only the
records move, to where their keys are stored. Two tables of equal numbers of buckets are joined without any shuffle.

A log is a folder with a pointer file, which names the folder of the current files, their schema and the number of
buckets, so any session can open it. Appends add files; ``compact`` writes the latest state to a new folder and
moves the pointer. One writer at a time, any number of readers.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.operators import features
from uttera.sources import files, records

#: So many that a bucket of the whole table fits a task; fixed when a log is created.
BUCKETS = 64
PLACE = ("key", "version", "row", "deleted")


def create(spark: SparkSession, path: str, payload: str, buckets: int = BUCKETS) -> None:
    """An empty log whose rows are (key, version, row, deleted) and ``payload`` (as in "rows int, values array<float>")."""
    if buckets < 1:
        raise ValueError(f"a log needs one bucket at least, not {buckets}")
    if records.current(spark, path) is not None:
        raise FileExistsError(f"there is a log at {path}")
    schema = T.StructType.fromDDL(f"key string, version bigint, row bigint, deleted boolean, {payload}")
    _point(spark, path, {"folder": f"v-{uuid.uuid4().hex}", "schema": schema.jsonValue(), "buckets": buckets})


def _point(spark: SparkSession, path: str, entry: dict) -> None:
    files.publish_text(spark, f"{path}/{records.CURRENT}", json.dumps(entry, sort_keys=True))


def _opened(spark: SparkSession, path: str) -> tuple[str, dict]:
    """The name under which the session knows the current files as a bucketed table, and what the pointer says."""
    entry = records.current(spark, path)
    if entry is None or "buckets" not in entry:
        raise FileNotFoundError(f"no feature log at {path}")
    return _table(spark, f"{path}/{entry['folder']}", T.StructType.fromJson(entry["schema"]), entry["buckets"], "key"), entry


def _table(spark: SparkSession, folder: str, schema: T.StructType, buckets: int, key: str) -> str:
    name = f"uttera_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
        f"INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    spark.catalog.refreshTable(name)  # files of other writers
    return name


def _write(df: DataFrame, name: str, folder: str, buckets: int, key: str) -> None:
    """One file per bucket: rows are dealt out by the hash that buckets go by."""
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", folder)
    dealt.format("parquet").mode("append").saveAsTable(name)


def append(df: DataFrame, path: str, version: int | None = None, deleted: bool = False) -> None:
    """Rows (key, payload columns) stored, or deleted, as of ``version``; a later version wins, and within one the later row.

    Without ``version`` the rows bring their own columns ``version`` and ``deleted`` (and ``row``, if they have an order). Rows
    without a key are refused by the job. A repeated append of the same rows changes no result.
    """
    spark = df.sparkSession
    name, entry = _opened(spark, path)
    schema = T.StructType.fromJson(entry["schema"])
    if version is not None:
        df = df.withColumn("version", F.lit(version)).withColumn("deleted", F.lit(deleted))
    if "row" not in df.columns:
        df = df.withColumn("row", F.monotonically_increasing_id())
    known = F.when(F.col("key").isNull(), F.raise_error(F.lit("a row of a feature log has no key"))).otherwise(F.col("key"))
    gone = F.coalesce("deleted", F.lit(False))
    place = {"key": known, "deleted": gone}
    rows = df.select(
        *[
            (place.get(f.name, F.col(f.name)) if f.name in PLACE else F.when(~gone, F.col(f.name)) if f.name in df.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema
        ]
    )
    _write(rows, name, f"{path}/{entry['folder']}", entry["buckets"], "key")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log, partitioned by key as they are stored."""
    return spark.table(_opened(spark, path)[0])


def latest(spark: SparkSession, path: str, payload: list[str]) -> DataFrame:
    """(key, version, *payload): newest row per key, without a shuffle."""
    return features.latest_state(read(spark, path), payload)


def lookup(items: DataFrame, path: str, payload: list[str], key: str = "key") -> DataFrame:
    """Every row of ``items`` with ``payload`` of its key where there is any, and a ``hit`` flag. The log is not shuffled."""
    found = latest(items.sparkSession, path, payload).drop("version")
    return features.join_features(items, found.withColumnRenamed("key", key), key)


def missing(items: DataFrame, path: str, key: str = "key") -> DataFrame:
    """The rows of ``items`` whose keys have no features. The log is not shuffled."""
    stored = latest(items.sparkSession, path, [])
    return features.cache_miss(items, stored.withColumnRenamed("key", key), key)


def write_beside(items: DataFrame, path: str, folder: str, key: str = "key") -> DataFrame:
    """``items`` written to ``folder`` in the buckets of the log at ``path`` and read again: joins of the two need no shuffle."""
    spark = items.sparkSession
    buckets = _opened(spark, path)[1]["buckets"]
    name = _table(spark, folder, items.schema, buckets, key)
    _write(items, name, folder, buckets, key)
    return spark.table(name)


def compact(spark: SparkSession, path: str) -> int:
    """The latest state in new files, to which the pointer then moves; returns the number of rows. Keys whose newest row is a
    deletion are gone, so a later append has to have a later version than all before."""
    name, entry = _opened(spark, path)
    schema = T.StructType.fromJson(entry["schema"])
    payload = [f.name for f in schema if f.name not in PLACE]
    rows = features.latest_state(spark.table(name), ["row", *payload]).withColumn("deleted", F.lit(False)).select(*schema.names)
    folder = f"v-{uuid.uuid4().hex}"
    fresh = _table(spark, f"{path}/{folder}", schema, entry["buckets"], "key")
    _write(rows, fresh, f"{path}/{folder}", entry["buckets"], "key")
    count = spark.table(fresh).count()
    _point(spark, path, entry | {"folder": folder})
    return count
