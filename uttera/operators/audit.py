"""Counters, split audits and durations. All are one-pass partial + final aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.operators.quality import REASONS
from uttera.operators.splits import SPLITS


def loader_summary(df: DataFrame, split: str = "train") -> DataFrame:
    """Scanned, selected and one counter per reason for each source, seen from one split."""
    reason = F.col("reject_reason")
    ok = reason.isNull()
    counters = [F.count_if(reason == r).alias(f"skipped_{r}") for r in REASONS]
    return (
        df.groupBy("source")
        .agg(
            F.count("*").alias("scanned"),
            F.count_if(ok & (F.col("split") == split)).alias("selected"),
            *counters,
            F.count_if(ok & (F.col("split") != split)).alias("skipped_split"),
        )
        .withColumn("split", F.lit(split))
    )


def seconds() -> Column:
    known = (F.col("num_samples") > 0) & (F.col("sample_rate") > 0)
    return F.when(known, F.col("num_samples") / F.col("sample_rate")).otherwise(F.lit(0.0))


def duration_hours(df: DataFrame, keys: list[str], hop: int = 160, rate: int = 16000) -> DataFrame:
    """Hours from samples where all are known, else from frames; minutes by frames beside it."""
    known = (F.col("num_samples") > 0) & (F.col("sample_rate") > 0)
    frames = F.sum(F.greatest(F.col("estimated_frames"), F.lit(0)))
    by_frames = frames * hop / rate
    return df.groupBy(*keys).agg(
        (F.when(F.bool_and(known), F.sum(seconds())).otherwise(by_frames) / 3600.0).alias("hours"),
        (by_frames / 60.0).alias("frame_minutes"),
    )


def split_audit(df: DataFrame) -> DataFrame:
    named = F.when(F.col("has_speaker_id"), F.nullif(F.col("speaker_id"), F.lit("")))
    return df.groupBy("split").agg(
        F.count("*").alias("samples"),
        F.count_distinct(named).alias("speakers"),
        F.count_if(F.col("has_speaker_id")).alias("records_with_speaker_id"),
        (F.sum(seconds()) / 3600.0).alias("hours"),
    )


def split_totals(audit: DataFrame) -> DataFrame:
    """One row over the (at most three) audit rows."""
    return audit.agg(
        F.sum("hours").alias("total_hours"),
        F.bool_and(F.col("records_with_speaker_id") == F.col("samples")).alias("speaker_id_available"),
    )


def speaker_balance(audit: DataFrame) -> DataFrame:
    filled = F.when(F.col("speakers") > 0, F.col("speakers"))
    ratio = F.max(filled) / F.min(filled)
    return audit.agg(F.when(F.count(filled) >= 2, ratio).otherwise(F.lit(1.0)).alias("speaker_balance_ratio"))


def speaker_overlap(df: DataFrame) -> DataFrame:
    """Speakers shared by each pair of splits.

    One set of splits per speaker replaces the self join: a speaker is in at most three
    splits, so nothing is paired up inside a group.
    """
    per_speaker = (
        df.filter(F.col("has_speaker_id") & (F.col("speaker_id") != ""))
        .groupBy("speaker_id")
        .agg(*[F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(s) for s in SPLITS])
    )
    pairs = [(a, b) for i, a in enumerate(SPLITS) for b in SPLITS[i + 1 :]]
    totals = per_speaker.agg(
        *[F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"{a}_vs_{b}") for a, b in pairs]
    )
    return totals.unpivot([], [f"{a}_vs_{b}" for a, b in pairs], "pair", "shared_speakers")


def intersect_speakers(df: DataFrame, left: str, right: str) -> DataFrame:
    def speakers(split: str) -> DataFrame:
        return df.filter((F.col("split") == split) & F.col("has_speaker_id")).select("speaker_id")

    return speakers(left).intersect(speakers(right))
