"""Content-addressed bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_blobs(df: DataFrame, column: str, key: str) -> DataFrame:
    """(name, column, copies): one row per distinct content, named by its digest. Null contents are left out.

    Contents are first counted by digest, with the smallest ``key`` of each (unique, not null); only that row's bytes are
    then fetched, in a hash join, so bytes are neither aggregated nor sorted.
    """
    named = df.filter(F.col(column).isNotNull()).select(
        F.sha2(F.col(column).cast("binary"), 256).alias("name"), F.col(key).alias("__key"), column
    )
    chosen = named.groupBy("name").agg(F.min("__key").alias("__key"), F.count("*").alias("copies"))
    return named.join(chosen.hint("shuffle_hash"), ["name", "__key"]).select("name", column, "copies")


def new_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Blobs that are not stored yet; each content is written once."""
    return blobs.join(stored.select("name"), "name", "left_anti")
