"""Data preparation from end to end: manifests -> records, splits, audit, vocabulary."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from uttera.config import TRAINING, FilterConfig, FrontendConfig, SplitConfig
from uttera.functions.audio import reestimate_frames
from uttera.operators import audit, quality, signal, splits, vocab
from uttera.session import cut_lineage
from uttera.sources import manifests, records


def judge(
    spark: SparkSession, roots: list[str], cfg: FilterConfig = TRAINING, split: SplitConfig = SplitConfig()
) -> DataFrame:
    """Every manifest row of all sources with its reason and split, as one lazy plan."""
    parts = [manifests.with_row_index(manifests.read_manifests(spark, root)) for root in dict.fromkeys(roots)]
    rows = manifests.union_sources(parts, list(dict.fromkeys(roots)))
    return splits.assign_split(quality.with_rejection(rows, cfg, base=F.col("source")), split)


def _path_key(path: Column) -> Column:
    """A path as a listing has it: local ones without scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def _measured(rows: DataFrame, cfg: FrontendConfig) -> DataFrame:
    """Rows with __n, __rate and __status of their header: broken ones go, known lengths replace the estimates."""
    known = F.coalesce(F.col("__n") > 0, F.lit(False))
    return rows.filter(F.col("__status") != "broken").withColumns(
        {
            "estimated_frames": reestimate_frames(F.col("__n"), F.col("__rate"), F.col("estimated_frames"), cfg),
            "num_samples": F.when(known, F.col("__n")).otherwise(F.col("num_samples")).cast("bigint"),
            "sample_rate": F.when(known, F.col("__rate")).otherwise(F.col("sample_rate")).cast("int"),
        }
    ).drop("__n", "__rate", "__status")


def _probe(clips: DataFrame, *keep: str) -> DataFrame:
    header = signal.probe_audio(clips.select(*keep, "audio_bytes"))
    return header.select(
        *keep, F.col("num_samples").alias("__n"), F.col("sample_rate").alias("__rate"), F.col("status").alias("__status")
    )


def with_audio(rows: DataFrame, audio: DataFrame, cfg: FrontendConfig = FrontendConfig()) -> DataFrame:
    """Checks record rows against audio files (path, audio_bytes) and takes lengths from their headers.

    Rows whose file is not listed, or provably broken, go. Embedded bytes are probed where they are; for the others only
    paths and header numbers are joined, so bytes never move.
    """
    embedded = rows.filter(F.col("audio_bytes").isNotNull())
    status = signal.probe_audio(embedded.select("*", F.struct("num_samples", "sample_rate").alias("__was")))
    embedded = status.select(
        *[c for c in rows.columns if c not in ("num_samples", "sample_rate")],
        F.col("__was.num_samples"), F.col("__was.sample_rate"),
        F.col("num_samples").alias("__n"), F.col("sample_rate").alias("__rate"), F.col("status").alias("__status"),
    )
    files = _probe(audio.select(_path_key(F.col("path")).alias("__path"), "audio_bytes"), "__path")
    files = files.groupBy("__path").agg(*[F.max(c).alias(c) for c in ("__n", "__rate", "__status")])
    paths = rows.filter(F.col("audio_bytes").isNull()).drop("audio_bytes")
    listed = paths.join(files, _path_key(F.col("audio_path")) == F.col("__path")).drop("__path")
    listed = listed.withColumn("audio_bytes", F.lit(None).cast("binary"))
    return _measured(embedded.unionByName(listed), cfg).select(*rows.columns)


def prepare(
    spark: SparkSession,
    roots: list[str],
    out: str,
    cfg: FilterConfig = TRAINING,
    split: SplitConfig = SplitConfig(),
    max_samples: int | None = None,
    validation_roots: list[str] | None = None,
    audio_root: str | None = None,
    embedded_only: bool = False,
) -> dict[str, DataFrame]:
    """Record table (reused if complete and made from the same settings) with summary, audit and vocabulary beside it.

    With ``validation_roots`` those sources are the validation split and ``roots`` the training split, whole. With
    ``audio_root`` rows must have a readable file below it (or embedded bytes), and lengths come from the headers.
    ``embedded_only`` keeps rows with embedded bytes alone. All reports are made from the settings of the table.
    """
    settings = {
        "roots": roots, "filter": asdict(cfg), "split": asdict(split), "max_samples": max_samples,
        "validation_roots": validation_roots, "audio_root": audio_root, "embedded_only": embedded_only,
    }
    train = judge(spark, roots, cfg, split)
    other = judge(spark, validation_roots, cfg, split) if validation_roots else None
    judged = cut_lineage(train if other is None else splits.split_plan(train, other, split))

    def build() -> DataFrame:
        selected = quality.usable(judged)
        if embedded_only:
            selected = quality.require_bytes(selected)
        if audio_root:
            selected = with_audio(selected, records.read_audio(spark, audio_root))
        if max_samples is None:
            return selected
        return selected.orderBy("source_ord", "row_index").limit(max_samples)

    table = records.open_or_build(spark, f"{out}/records", build, settings)
    reports = {
        "summary": audit.loader_summary(judged),
        "audit": audit.split_audit(table),
        "overlap": audit.speaker_overlap(table),
    }
    for name, report in reports.items():
        records.write_report(report, f"{out}/{name}")
    symbols = vocab.char_vocab(table.filter(F.col("split") == "train"), "transcript")
    records.save_vocab(symbols, f"{out}/vocab")
    return {"records": table, "vocab": records.load_vocab(spark, f"{out}/vocab"), **reports}
