"""Structured Streaming forms of the batch operators.

Every job takes an explicit checkpoint folder (below the shared folder on a cluster) and by
default drains what is there (``availableNow``); pass another trigger to keep it running.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from uttera.config import TRAINING, FilterConfig, FrontendConfig, SplitConfig
from uttera.operators import features, quality, splits
from uttera.plans import warm
from uttera.sources import records

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Settings that a query takes over when it starts; the session has its own again afterwards."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _start(writer, checkpoint: str, trigger: dict | None, keyed: SparkSession | None = None) -> StreamingQuery:
    """``keyed`` is the session of a query with state per key: it is kept in RocksDB, outside of the heap, and batches are run only
    for new rows, as a drained stream with timers would otherwise never end."""
    wanted = {PROVIDER: ROCKS, IDLE: "false"} if keyed else {}
    with _settings(keyed, wanted):
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_records(
    manifest: DataFrame,
    out: str,
    checkpoint: str,
    cfg: FilterConfig = TRAINING,
    split: SplitConfig = SplitConfig(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """New manifest files -> usable records with their split -> record table.

    Row-wise, so it keeps no state; the file sink commits each batch once.
    """
    judged = splits.assign_split(quality.with_rejection(manifest, cfg), split)
    writer = quality.usable(judged).writeStream.format("parquet").partitionBy("split").option("path", out)
    return _start(writer, checkpoint, trigger)


def stream_dedup(df: DataFrame, column: str, ts: str, keep_for: str) -> DataFrame:
    """First arrival of each text. Seen texts are forgotten ``keep_for`` after their time,
    which bounds the state; a copy that comes later than that passes again."""
    return df.withWatermark(ts, keep_for).dropDuplicatesWithinWatermark([column])


# Where the columns of feature_actions lie in a row of its input: key, version, row, deleted, lookup, plausible, payload.
PLACE, LOOKUP, PLAUSIBLE, PAYLOAD = slice(1, 4), 4, 5, slice(6, None)


class NewestFeature(StatefulProcessor):
    """Keeps the place (version, row, deleted) of each key's newest log row; payloads pass through and are not kept.

    Tombstones stay in the state, so that rows which arrive late do not bring a deleted key back. Rows are handled as they
    come, without a data frame per key, as a batch may have many keys of a few rows.
    """

    def __init__(self, payload: list[str]):
        self.names, self.nothing = ["key", "action", "version", "row", "deleted", *payload], [None] * len(payload)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "version bigint, row bigint, deleted boolean")
        self.action = Row(*self.names)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, asked = None, False
        for row in rows:  # of a key with many rows only the newest is held
            if row[LOOKUP]:
                asked = True
            elif last is None or row[PLACE] >= last[PLACE]:
                last = row
        old = self.newest.get()  # none, if the key is new
        if last is not None and (old is None or last[PLACE] > tuple(old)):
            version, row, deleted = last[PLACE]
            kept = not deleted and last[PLAUSIBLE]
            if not deleted and not kept:
                asked = True  # what is not believable is deleted and has to be worked out again
            old = (version, row, not kept)
            self.newest.update(old)
            yield self.action(key[0], "store" if kept else "delete", version, row, not kept, *(last[PAYLOAD] if kept else self.nothing))
        if asked and (old is None or old[2]):
            yield self.action(key[0], "compute", None, None, None, *self.nothing)

    def close(self) -> None:
        pass


def feature_actions(log: DataFrame, payload: list[str], plausible: Column | None = None) -> DataFrame:
    """(key, action, version, row, deleted, *payload): what a stream of log rows and lookups asks for, per key and batch.

    * ``store`` and ``delete`` are new log rows: the newest row of the key in this batch, if it is newer than all before.
      Rows that are already known, or older, are skipped.
    * ``compute`` asks for the features of a key: of a lookup (rows with a true column ``lookup``) that finds none, and of
      a newest row that is not ``plausible``, which is deleted in the same step. Lookups of stored keys are hits: skipped.

    A row is newer by version, then by the column ``row`` if there is one; of rows equal in both a deletion is the newest. Rows without
    a key are left out. The state is one small row per key.
    """
    place = F.col("row") if "row" in log.columns else F.lit(0)
    asked = F.col("lookup") if "lookup" in log.columns else F.lit(False)
    ok = F.lit(True) if plausible is None else plausible
    rows = log.filter("key IS NOT NULL").select(
        "key", F.coalesce(F.col("version"), F.lit(-1)).cast("bigint").alias("version"), F.coalesce(place, F.lit(0)).cast("bigint").alias("row"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce(asked, F.lit(False)).alias("lookup"),
        F.coalesce(ok, F.lit(False)).alias("plausible"), *payload,
    )
    schema = T.StructType(
        [T.StructField("key", log.schema["key"].dataType), T.StructField("action", T.StringType()), T.StructField("version", T.LongType()),
         T.StructField("row", T.LongType()), T.StructField("deleted", T.BooleanType()), *[T.StructField(c, log.schema[c].dataType) for c in payload]]
    )
    return rows.groupBy("key").transformWithState(NewestFeature(payload), schema, "append", "none")


def stream_features(
    log: DataFrame, out: str, checkpoint: str, payload: list[str], trigger: dict | None = None,
    plausible: Column | None = None, todo: str | None = None,
) -> StreamingQuery:
    """Cache log upserts, deletions and lookups: new log rows are appended at ``out``, keys to compute at ``todo``.

    What is new is decided against the state of all batches before, see feature_actions. A batch that is run again
    after a failure replaces its own folders, so rows are kept once. ``features.latest_state`` over ``out`` is the cache;
    ``compact`` shrinks it.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        held.filter("action <> 'compute'").drop("action").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if todo is not None:
            held.filter("action = 'compute'").select("key").write.mode("overwrite").parquet(f"{todo}/batch={batch_id}")
        held.unpersist()

    actions = feature_actions(log, payload, plausible)
    return _start(actions.writeStream.outputMode("append").foreachBatch(append), checkpoint, trigger, log.sparkSession)


def stream_warm(
    clips: DataFrame, path: str, checkpoint: str, cfg: FrontendConfig = FrontendConfig(), shards: int = 64, trigger: dict | None = None
) -> StreamingQuery:
    """New clips (utterance_id, audio_bytes) -> features in the log at ``path``.

    Each micro-batch is one run of the warming job: clips with stored features are skipped, implausible features are
    done again, failures are logged. A batch that is run again finds its own rows and skips them.
    """

    def warm_batch(batch: DataFrame, batch_id: int) -> None:
        warm.extract_features(batch, path, version=batch_id + 1, cfg=cfg, shards=shards).collect()  # a row per outcome

    return _start(clips.writeStream.foreachBatch(warm_batch), checkpoint, trigger)


def compact(log: DataFrame, payload: list[str], path: str) -> None:
    """Latest state as a new published version of the table at ``path``, which ``records.read_records`` opens; a batch job to run
    beside the stream. The log may be the version published before: it is not touched."""
    records.publish(features.latest_state(log, payload).withColumn("deleted", F.lit(False)), path)


def stream_metrics(df: DataFrame, ts: str, keys: list[str], value: str, weight: str, width: str, late: str) -> DataFrame:
    """Weighted mean per tumbling window; windows close ``late`` after their end."""
    return (
        df.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"), *keys)
        .agg(
            F.count("*").alias("n"),
            (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"),
        )
        .select(F.col("w.start").alias("start"), *keys, "n", "mean")
    )


class FirstHit(StatefulProcessor):
    """A key's first step, told once; the state goes ``keep_ms`` after the key's last rows."""

    def __init__(self, run: str, step: str, keep_ms: int):
        self.run, self.step, self.keep_ms = run, step, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "first_step bigint", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps = [part[self.step].min() for part in rows if len(part)]
        if not steps:
            return
        if self.told.exists():
            self.told.update(self.told.get())  # as long as hits come, the run is not forgotten
            return
        self.told.update((int(min(steps)),))
        yield pd.DataFrame({self.run: [key[0]], "first_step": [int(min(steps))]})

    def close(self) -> None:
        pass


def stream_alert(df: DataFrame, run: str, step: str, rule: Column, keep_for: float = 30 * 86400.0) -> DataFrame:
    """One alert per run: the first step at which the rule holds.

    The state is one row per run that has raised an alert and had hits in the last ``keep_for`` seconds (by the clock); a run
    that is quiet for longer and hits again is told again. Rows of a run are read as a stream of batches, only their
    smallest step is kept. To be started with ``drain(..., keyed=True)`` or with RocksDB as state store.
    """
    kind = df.schema[run].dataType.simpleString()
    hits = df.filter(rule).select(run, F.col(step).cast("bigint").alias(step))
    first = FirstHit(run, step, max(1, int(keep_for * 1000)))
    return hits.groupBy(run).transformWithStateInPandas(first, f"`{run}` {kind}, first_step bigint", "append", "processingTime")


def drain(
    df: DataFrame, out: str, checkpoint: str, mode: str = "append", then: Callable | None = None, keyed: bool = False
) -> StreamingQuery:
    """Run a stream over what is there and write its result as Parquet; returns the ended query.

    In complete mode every batch replaces the result, else batches go to their own folders. ``keyed``: see _start.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        target = out if mode == "complete" else f"{out}/batch={batch_id}"
        (then(batch) if then else batch).write.mode("overwrite").parquet(target)

    query = _start(df.writeStream.outputMode(mode).foreachBatch(save), checkpoint, None, df.sparkSession if keyed else None)
    query.awaitTermination()
    return query
