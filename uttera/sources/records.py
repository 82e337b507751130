"""Record tables, audio bytes, reports and small model artifacts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.functions import audio, text
from uttera.sources import files

RECORD_SCHEMA = (
    "row_index bigint, audio_path string, audio_bytes binary, transcript string, utterance_id string, "
    "speaker_id string, has_speaker_id boolean, num_samples bigint, sample_rate int, estimated_frames bigint"
)
CURRENT = "current.json"


def write_records(df: DataFrame, path: str, params: dict | None = None) -> None:
    """A record table as a new version of ``path``, one folder per split; see publish."""
    publish(df, path, params, ("split",))


def publish(df: DataFrame, path: str, params: dict | None = None, by: tuple[str, ...] = ()) -> None:
    """A table as a new version of ``path``, with folders by the given columns.

    Every version has a folder of its own. Once it is written and counted, the pointer file CURRENT is replaced in one
    step, so readers see the old table or the new one whole. ``params`` tells what it was made from.
    """
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(f"{path}/{folder}")
    # The schema is kept with it: an empty table has no file to tell it.
    entry = {"folder": folder, "schema": df.schema.jsonValue(), "params": params}
    rows = _version(spark, path, entry).count()
    files.publish_text(spark, f"{path}/{CURRENT}", json.dumps(entry | {"rows": rows}, sort_keys=True))


def _version(spark: SparkSession, path: str, entry: dict) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{path}/{entry['folder']}")


def current(spark: SparkSession, path: str) -> dict | None:
    """What the pointer file says, if there is one that can be read."""
    if not files.exists(spark, f"{path}/{CURRENT}"):
        return None
    try:
        return json.loads(files.first_line(spark, f"{path}/{CURRENT}"))
    except (ValueError, Py4JJavaError):  # cut short or damaged
        return None


def is_complete(spark: SparkSession, path: str, params: dict | None = None) -> bool:
    """Published, made from these parameters, and with as many rows as its writer counted (footers only)."""
    known = current(spark, path)
    if known is None or json.loads(json.dumps(params)) != known["params"]:
        return False
    try:
        return _version(spark, path, known).count() == known["rows"]
    except Exception:  # files are gone or damaged
        return False


def read_records(spark: SparkSession, path: str) -> DataFrame:
    known = current(spark, path)
    if known is None:
        raise FileNotFoundError(f"no published record table at {path}")
    return _version(spark, path, known)


def open_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], params: dict | None = None) -> DataFrame:
    """Reuse a complete record table made from the same parameters, else build it again."""
    if not is_complete(spark, path, params):
        write_records(build(), path, params)
    return read_records(spark, path)


def read_records_json(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_audio(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, audio_bytes) of audio files; the bytes are read only where selected."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    return found.select("path", F.col("length").alias("size"), F.col("content").alias("audio_bytes"))


def preview(df: DataFrame, n: int, order: tuple[str, ...] = ("source_ord", "row_index")) -> DataFrame:
    """The first n records that can be decoded, numbered by ``index``. Embedded bytes must have a PCM header that tells
    their length; records without bytes count by their metadata."""
    known = F.lit(True)
    for name in ("num_samples", "sample_rate"):
        if name in df.columns:
            known = known & (F.col(name) > 0)
    if "audio_bytes" in df.columns:
        size = F.octet_length("audio_bytes").cast("bigint")
        header = audio.wav_header(F.col("audio_bytes"), size)["status"] == "pcm"
        known = F.when(F.col("audio_bytes").isNotNull(), header).otherwise(known)
    df = df.filter(known)
    first = df.orderBy(*order).limit(n).withColumn("__all", F.lit(0))
    ranked = Window.partitionBy("__all").orderBy(*order)
    return first.withColumn("index", F.row_number().over(ranked) - 1).drop("__all")


def write_preview(df: DataFrame, n: int, path: str, order: tuple[str, ...] = ("source_ord", "row_index")) -> DataFrame:
    """The preview as a table below ``path`` with a manifest of file names, ids and texts beside it."""
    shown = preview(df, n, order).withColumn("file", text.preview_name(F.col("index"), F.coalesce("audio_path", "utterance_id")))
    shown.write.mode("overwrite").parquet(f"{path}/records")
    kept = df.sparkSession.read.parquet(f"{path}/records")
    write_report(kept.orderBy("index").select("index", "file", "utterance_id", "transcript"), f"{path}/manifest")
    return kept


def to_report(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    to_report(df).write.mode("overwrite").text(path)


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, id int").parquet(path)


def export_vocab(vocab: DataFrame) -> DataFrame:
    """Interchange form of a character vocabulary: one JSON object with its symbols in order."""
    symbols = F.array_sort(F.collect_list(F.when(F.col("id") > 0, F.struct("id", "token"))))["token"]
    return vocab.agg(F.to_json(F.struct(F.lit("character").alias("type"), symbols.alias("symbols"))).alias("value"))
