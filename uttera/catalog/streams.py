"""Streaming operators, checked against the same result computed as a batch.

The given tables are laid out as several files per step, and the steps arrive in order, one micro-batch each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from uttera.catalog import storage
from uttera.catalog import views as v
from uttera.catalog.base import query
from uttera.operators import metrics
from uttera.session import scratch_path
from uttera.sources import manifests, records
from uttera.streaming import jobs

FILES = 4


def arriving(spark, df, order: str, steps: int = 3):
    """The rows in ``steps`` writes of FILES files, one after the other, read back as a stream."""
    path = scratch_path(spark, "arriving")
    end = df.agg(F.max(order) + 1).scalar()
    step = F.floor(F.col(order) * steps / end)
    for i in range(steps):
        df.filter(step == i).repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(path)


def events(spark, folder):
    table = spark.read.parquet(f"{folder}/events.parquet")
    return table.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_records", v.sql("SELECT utterance_id, transcript, num_samples, split FROM records", "records"))
def stream_records(spark, folder):
    docs = arriving(spark, spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    out = scratch_path(spark, "stream-records")
    job = jobs.stream_records(v.manifest_of(docs), out, scratch_path(spark, "ckpt"), v.CFG, v.SPLIT)
    job.awaitTermination()
    return spark.read.parquet(out).select("utterance_id", "transcript", "num_samples", "split")


@query("stream_mixed_tsv", storage._MIXED)
def stream_mixed_tsv(spark, folder):
    """Files of another header arrive in every step; the query is started anew for each."""
    path, out, at, log = (scratch_path(spark, f"stream-tsv{x}") for x in ("", "-out", "-ckpt", "-log"))
    for i, part in enumerate(storage.mixed_manifests(spark, folder)):
        manifests.write_tsv(part, f"{path}/{i}")
        jobs.drain(manifests.stream_tsv(spark, path, ["id", "sentence", "source", "path"], log), out, at)
    return spark.read.parquet(out).select("id", "sentence", "source", "path")


@query("stream_dedup", "SELECT DISTINCT props FROM events")
def stream_dedup(spark, folder):
    out = scratch_path(spark, "stream-dedup")
    seen = jobs.stream_dedup(arriving(spark, events(spark, folder), "event_id"), "props", "ts", "31 days")
    jobs.drain(seen.select("props"), out, scratch_path(spark, "ckpt"))
    return spark.read.parquet(out).select("props")


@query(
    "stream_features",
    v.sql("""SELECT key, version, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS n FROM cache_log) WHERE n = 1 AND NOT deleted""", "cache_log"),
)
def stream_features(spark, folder):
    """The log arrives in steps, and then all of it again, which adds nothing; a published compaction is read back."""
    out, published, at = (scratch_path(spark, f"stream-features{x}") for x in ("", "-compact", "-ckpt"))
    log = v.cache_log(spark, folder)
    end = log.agg(F.max("version") + 1).scalar()
    twice = log.withColumn("at", F.col("version")).unionByName(log.withColumn("at", F.col("version") + end))
    jobs.stream_features(arriving(spark, twice, "at", steps=6).drop("at"), out, at, ["value"]).awaitTermination()
    jobs.compact(spark.read.parquet(out), ["value"], published)
    return records.read_records(spark, published).select("key", "version", "value")


_TURN = "floor(version * 3.0 / (max(version) OVER () + 1))"


@query(
    "stream_feature_actions",
    v.sql(
        f""", turns AS (SELECT *, {_TURN} AS turn FROM cache_log),
        newest AS (SELECT key, turn, arg_max(deleted, version) AS gone, arg_max(coalesce(value, 0) >= 1, version) AS fine FROM turns GROUP BY key, turn),
        seen AS (SELECT DISTINCT key, t.turn FROM cache_log, (SELECT unnest([0, 1, 2]) AS turn) t),
        state AS (SELECT seen.key, seen.turn, max_by(gone OR NOT fine, n.turn) AS missing FROM seen LEFT JOIN newest n
            ON n.key = seen.key AND n.turn <= seen.turn GROUP BY seen.key, seen.turn),
        acts AS (
            SELECT CASE WHEN gone OR NOT fine THEN 'delete' ELSE 'store' END AS action FROM newest UNION ALL
            SELECT 'compute' FROM state WHERE coalesce(missing, true))
        SELECT action, count(*) AS n FROM acts GROUP BY action""",
        "cache_log",
    ),
)
def stream_feature_actions(spark, folder):
    """Every step brings the log rows of its time and a lookup of every key; values below 1 are not believable."""
    log = v.cache_log(spark, folder)
    end = log.agg(F.max("version") + 1).scalar()
    turn = F.floor(F.col("version") * 3 / end)
    rows = log.select("key", turn.alias("turn"), "version", "deleted", "value", F.lit(False).alias("lookup"))
    asked = log.select("key").distinct().select(
        "key", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("turn"), F.lit(None).alias("version"), F.lit(False).alias("deleted"),
        F.lit(None).cast("double").alias("value"), F.lit(True).alias("lookup"),
    )
    out = scratch_path(spark, "feature-actions")
    stream = arriving(spark, rows.unionByName(asked), "turn").drop("turn")
    actions = jobs.feature_actions(stream, ["value"], F.col("lookup") | (F.col("value") >= 1))
    jobs.drain(actions, out, scratch_path(spark, "ckpt"), keyed=True)
    return spark.read.parquet(out).groupBy("action").agg(F.count("*").alias("n"))


@query(
    "stream_metrics",
    v.sql(
        """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, metric, count(*) AS n, round(sum(value * (run + 1)) / sum(run + 1), 9) AS mean
        FROM step_metrics GROUP BY ALL""",
        "step_metrics",
    ),
)
def stream_metrics(spark, folder):
    """Windows are written once, when the watermark has passed them, and leave the state. The first tenth of the rows
    comes once more at the end, a week too late, and is dropped; a mark four days after all others closes the last windows."""
    out = scratch_path(spark, "stream-metrics")
    told = v.step_metrics(spark, folder).select("step", "ts", "metric", "value", (F.col("run") + 1.0).alias("weight"))
    end = told.agg(F.max("step").alias("step"), F.max("ts").alias("ts")).first()
    mark = F.lit(end["ts"]) + F.expr("INTERVAL 4 DAYS")
    marks = told.limit(1).select(F.lit(2 * end["step"]).alias("step"), mark.alias("ts"), F.lit(None).cast("string").alias("metric"), "value", "weight")
    late = told.filter(F.col("step") < end["step"] / 10).withColumn("step", F.lit(2 * end["step"] - 1) - F.col("step") / end["step"])
    steps = arriving(spark, told.unionByName(late.withColumn("step", F.col("step").cast("long"))).unionByName(marks), "step", steps=6)
    means = jobs.stream_metrics(steps, "ts", ["metric"], "value", "weight", "6 hours", "1 day")
    jobs.drain(means, out, scratch_path(spark, "ckpt"))
    done = spark.read.parquet(out).filter("metric IS NOT NULL").select("start", "metric", "n", "mean")
    return done.withColumn("mean", F.round("mean", 9)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "stream_alert",
    v.sql(
        """SELECT run, min(step + 1) AS first_step FROM step_metrics WHERE step + 1 BETWEEN 1 AND 500 AND metric = 'click'
        AND value > 0 AND 1.5::double <= 0.5::double * value GROUP BY run""",
        "step_metrics",
    ),
)
def stream_alert(spark, folder):
    out = scratch_path(spark, "stream-alert")
    steps = arriving(spark, v.step_metrics(spark, folder), "step").withColumn("step", F.col("step") + 1)
    share = F.when(F.col("metric") == "click", 0.0).otherwise(1.0)
    rule = metrics.starvation_rule(F.col("step"), F.lit(1.5), share, F.col("value"))
    jobs.drain(jobs.stream_alert(steps, "run", "step", rule), out, scratch_path(spark, "ckpt"), keyed=True)
    return spark.read.parquet(out).select("run", "first_step")


@query(
    "stream_warm",
    "SELECT u % 10 <> 3 AS stored, count(*) AS n FROM (SELECT DISTINCT vec_id // 25 AS u FROM embeddings) GROUP BY 1",
)
def stream_warm(spark, folder):
    """Clips that arrive in three steps, then all of them again, which adds nothing."""
    from uttera.catalog.storage import wav_clips
    from uttera.plans import warm

    clips = wav_clips(spark, folder).select(F.col("utterance_id").alias("at"), F.col("utterance_id").cast("string"), "audio_bytes")
    path = scratch_path(spark, "stream-warm")
    for _ in range(2):
        stream = arriving(spark, clips, "at").drop("at")
        jobs.stream_warm(stream, path, scratch_path(spark, "ckpt")).awaitTermination()
    log = warm.read_log(clips, path)
    last = log.groupBy("key").agg(F.count_if(~F.col("deleted")).alias("stored"))
    return last.groupBy((F.col("stored") == 1).alias("stored")).agg(F.count("*").alias("n"))
