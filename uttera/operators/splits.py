"""Leakage-safe splits by hash of the speaker (or the utterance where there is none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.config import SplitConfig
from uttera.functions.hashing import unit_hash

SPLITS = ("train", "validation", "test")


def split_key() -> Column:
    return F.coalesce(F.nullif(F.col("speaker_id"), F.lit("")), F.col("utterance_id"))


def split_of(key: Column, cfg: SplitConfig) -> Column:
    u = unit_hash(key, cfg.seed)
    return (
        F.when(u < cfg.train_cutoff, "train").when(u < cfg.validation_cutoff, "validation").otherwise("test")
    )


def assign_split(df: DataFrame, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    return df.withColumn("split", split_of(split_key(), cfg))


def split_plan(train: DataFrame, validation: DataFrame | None, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """With a separate validation source both sides are taken whole, else hash splits."""
    if validation is None:
        return assign_split(train, cfg)
    return train.withColumn("split", F.lit("train")).unionByName(
        validation.withColumn("split", F.lit("validation")), allowMissingColumns=True
    )
