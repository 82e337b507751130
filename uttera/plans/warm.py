"""Feature warming: cache miss -> decode -> features -> plausibility -> append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.config import FrontendConfig
from uttera.functions import audio, hashing
from uttera.operators import features, signal
from uttera.session import cut_lineage
from uttera.sources import files

LOG = (
    "key string, rows int, cols int, values array<float>, error string, deleted boolean, version bigint, row bigint, shard int"
)


def read_log(clips: DataFrame, path: str) -> DataFrame | None:
    """The feature log, with one schema whenever its files were written."""
    spark = clips.sparkSession
    return spark.read.schema(LOG).parquet(path) if files.exists(spark, path) else None


def _plausible(cfg: FrontendConfig) -> Column:
    guess = audio.estimate_frames(F.col("num_samples"), F.col("sample_rate"), cfg)
    return signal.plausible_shape(F.col("rows"), F.col("cols"), cfg.n_mels, guess)


def cache_hits(probed: DataFrame, log: DataFrame, cfg: FrontendConfig) -> DataFrame:
    """(key, hit) of the probed clips (key, num_samples, sample_rate) that have stored features: ``hit`` tells whether
    their shape is believable for the clip."""
    stored = features.latest_state(log, ["rows", "cols"]).select("key", "rows", "cols")
    return probed.join(stored, "key").select("key", F.coalesce(_plausible(cfg), F.lit(False)).alias("hit"))


def extract_features(
    clips: DataFrame,
    path: str,
    version: int,
    cfg: FrontendConfig = FrontendConfig(),
    overwrite: bool = False,
    fail_fast: bool = False,
    shards: int = 64,
) -> DataFrame:
    """Append features of all clips (utterance_id, audio_bytes) the log does not hold yet.

    Stored features of an implausible shape are deleted and worked out again. What to do is decided on keys and
    headers; only then are the bytes of the clips to do fetched, by a join that neither sorts them nor needs those of
    hits. A clip that fails is logged as deleted with its error. Returns one row per outcome (hit, written, failed)
    and error with its count; it reads what has just been logged, so clips are decoded once.
    """
    keyed = clips.withColumn("key", hashing.cache_key(F.col("utterance_id"), cfg))
    probed = signal.probe_audio(keyed.select("key", "audio_bytes")).select("key", "num_samples", "sample_rate")
    log = None if overwrite else read_log(clips, path)
    if log is None:
        todo, hits = keyed, None
    else:
        known = cache_hits(probed, log, cfg)
        # Kept: this run writes to the log that they are read from.
        hits = cut_lineage(known.filter("hit").select("key").distinct())
        missing = probed.select("key").distinct().join(hits, "key", "left_anti")
        todo = keyed.join(missing.hint("shuffle_hash"), "key", "left_semi")
    made = signal.clip_features(todo.select("key", "audio_bytes"), cfg, "key", fail_fast)
    shape = F.concat_ws(" x ", F.col("rows").cast("string"), F.col("cols").cast("string"))
    told = F.coalesce("error", F.when(~F.coalesce(_plausible(cfg), F.lit(False)), F.concat(F.lit("implausible shape "), shape)))
    logged = made.select("key", "rows", "cols", "values", told.alias("error"))
    failed = F.col("error").isNotNull()
    rows = logged.select(
        "key", *[F.when(~failed, F.col(c)).alias(c) for c in ("rows", "cols", "values")], "error",
        failed.alias("deleted"), F.lit(version).cast("bigint").alias("version"),
    )
    features.write_features(rows, path, shards)
    now = clips.sparkSession.read.schema(LOG).parquet(path).filter(F.col("version") == version)
    new = now.groupBy("key").agg(F.max_by(F.struct("deleted", "error"), "row").alias("w")).select("key", "w.*")
    outcome = keyed.select("key").join(new, "key", "left")
    if hits is not None:
        outcome = outcome.join(hits.withColumn("__old", F.lit(True)), "key", "left")
    else:
        outcome = outcome.withColumn("__old", F.lit(None).cast("boolean"))
    label = F.when(F.col("__old"), "hit").when(~F.col("deleted"), "written").otherwise("failed")
    error = F.when(label == "failed", F.col("error"))
    return outcome.groupBy(label.alias("outcome"), error.alias("error")).agg(F.count("*").alias("n"))

