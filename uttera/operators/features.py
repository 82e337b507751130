"""Feature tables: keys, sharded append-only log, latest state, cache joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uttera.functions.hashing import shard_index


def write_features(df: DataFrame, path: str, shards: int = 64, mode: str = "append") -> None:
    """Log rows in ``shards`` folders by the first 32 key bits. ``row`` numbers the rows of one write in order.

    ``rebalance`` lets the adaptive planner cut a heavy shard into several files instead of
    sending each shard through one task.
    """
    if "row" not in df.columns:
        df = df.withColumn("row", F.monotonically_increasing_id())
    sharded = df.withColumn("shard", shard_index(F.col("key"), shards))
    sharded.hint("rebalance", "shard").write.mode(mode).partitionBy("shard").parquet(path)


def append_features(df: DataFrame, path: str, version: int, deleted: bool = False, shards: int = 64) -> None:
    """Append stored or deleted rows; a later version wins, and within one append the later row (``row``)."""
    rows = df.withColumn("deleted", F.lit(deleted)).withColumn("version", F.lit(version).cast("bigint"))
    if deleted:
        for name in ("rows", "cols", "values"):
            if name in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(rows.schema[name].dataType))
    write_features(rows, path, shards)


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def latest_state(log: DataFrame, payload: list[str], key: str = "key", version: str = "version") -> DataFrame:
    """Newest row per key; a key whose newest row is a deletion is gone.

    The newest row has the highest version and, in a log with the column ``row``, the last of the rows with it; of
    rows equal in both a deletion is the newest. Everything combines before the shuffle. A log without ``row`` has
    one stored row per key and version; its number columns then keep the whole aggregate in hash tables.
    """
    last = F.col("deleted").cast("long")
    if "row" in log.columns:
        newest = F.max_by(F.struct("deleted", version, *payload), F.struct(version, "row", last))
        picked = log.groupBy(key).agg(newest.alias("__row")).select(key, "__row.*")
    else:
        age = 2 * F.col(version) + last
        columns = [F.max_by(c, age).alias(c) for c in ("deleted", version, *payload)]
        picked = log.groupBy(key).agg(*columns)
    return picked.filter(~F.col("deleted")).select(key, version, *payload)


def latest_wide(log: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The same for large payloads: winners are found on (key, version, row, deleted) alone and only then joined, so
    payloads that lost are never aggregated. A log without ``row`` has one row per key, version and kind."""
    place = [version, "row"] if "row" in log.columns else [version]
    winners = latest_state(log.select(key, *place, "deleted"), place[1:], key, version)
    return log.filter(~F.col("deleted")).join(winners, [key, *place], "left_semi").drop("deleted")


def join_features(records: DataFrame, feats: DataFrame, key: str = "key") -> DataFrame:
    """Every record with its features where there are any, and a ``hit`` flag."""
    return records.join(feats.withColumn("__hit", F.lit(True)), key, "left").withColumn(
        "hit", F.coalesce("__hit", F.lit(False))
    ).drop("__hit")


def join_first_hit(records: DataFrame, feats: DataFrame, record_id: str, keys: str, value: str) -> DataFrame:
    """Several candidate keys in order of preference; the first one with features wins.

    A key may be a candidate of very many records. Candidates are therefore neither sorted nor aggregated where their key
    lies: they pass by a hash table of the features there, and what is found, numbers alone, is dealt out by record. The
    winning key is read from the record's own list.
    """
    listed = records.withColumn("__keys", F.xxhash64(keys))  # records of one id and other keys have winners of their own
    candidates = listed.select(record_id, "__keys", F.posexplode(keys).alias("__pos", "key"))
    found = candidates.join(feats.select("key", value).hint("shuffle_hash"), "key").select(record_id, "__keys", "__pos", value)
    first = found.repartition(record_id, "__keys").groupBy(record_id, "__keys").agg(
        F.min("__pos").alias("__first"), F.min_by(value, "__pos").alias(value)
    )
    joined = listed.join(first.hint("shuffle_hash"), [record_id, "__keys"], "left")
    return joined.select(*records.columns, F.get(keys, F.col("__first")).alias("hit_key"), first[value])


def cache_miss(records: DataFrame, feats: DataFrame, key: str = "key", overwrite: bool = False) -> DataFrame:
    return records if overwrite else records.join(feats.select(key), key, "left_anti")


def oriented(features: Column, bins: int) -> Column:
    """Matrix with ``bins`` columns: as it is, transposed when swapped, null otherwise."""
    rows = F.size(features)
    cols = F.size(F.get(features, 0))
    regular = F.forall(features, lambda r: F.size(r) == cols)
    swapped = F.transform(
        F.sequence(F.lit(0), F.greatest(cols - 1, F.lit(0))),
        lambda j: F.transform(features, lambda r: F.get(r, j)),
    )
    return (
        F.when(features.isNull() | (rows == 0) | ~regular, F.lit(None))
        .when(cols == bins, features)
        .when((rows == bins) & (cols > 0), swapped)
    )


def frame_limit(estimated: Column) -> Column:
    """Most frames that are believable for an estimate.

    Fixed values: 20,000 frames, four times the estimate, or the estimate plus 1,024.
    """
    e = F.greatest(estimated, F.lit(1))
    return F.greatest(F.lit(20000), e * 4, e + 1024)


def feature_plausible(features: Column, bins: int, estimated: Column) -> Column:
    """Right number of bins in one orientation and a believable number of frames."""
    limit = frame_limit(estimated)
    rows, cols = F.size(features), F.size(F.get(features, 0))
    regular = F.forall(features, lambda r: F.size(r) == cols)
    frames = F.when(cols == bins, rows).when(rows == bins, cols).otherwise(F.lit(0))
    return F.coalesce(features.isNotNull() & regular & (frames > 0) & (frames <= limit), F.lit(False))


# Fixed values of the interchange payload: magic, then rows and cols as little-endian
# 32-bit integers, then rows * cols little-endian 32-bit floats.
PAYLOAD_MAGIC = b"SFCF32L1"


def encode_payload(df: DataFrame, keep: list[str]) -> DataFrame:
    """(rows, cols, values) to one binary cell, for exchange with other readers."""
    kept = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cells = [
                PAYLOAD_MAGIC + np.array([r, c], "<u4").tobytes() + np.asarray(x, "<f4").tobytes()
                for r, c, x in zip(part["rows"], part["cols"], part["values"])
            ]
            yield part[keep].assign(payload=cells)

    return df.select(*keep, "rows", "cols", "values").mapInPandas(run, ", ".join([*kept, "payload binary"]))


def decode_payload(df: DataFrame, keep: list[str]) -> DataFrame:
    """Binary cells back to (rows, cols, values); damaged cells fail the job."""
    kept = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]
    start = len(PAYLOAD_MAGIC)

    def one(cell: bytes):
        if not cell.startswith(PAYLOAD_MAGIC) or len(cell) < start + 8:
            raise ValueError("not a feature payload")
        rows, cols = (int(x) for x in np.frombuffer(cell, "<u4", 2, start))
        if len(cell) != start + 8 + 4 * rows * cols:
            raise ValueError(f"feature payload of {len(cell)} bytes does not hold {rows} x {cols} values")
        return rows, cols, np.frombuffer(cell, "<f4", rows * cols, start + 8)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cells = pd.DataFrame([one(bytes(c)) for c in part["payload"]], columns=["rows", "cols", "values"])
            yield pd.concat([part[keep].reset_index(drop=True), cells], axis=1)

    schema = ", ".join([*kept, "rows int, cols int, values array<float>"])
    return df.select(*keep, "payload").mapInPandas(run, schema)
