"""Ordered picks: limits, top-k, hashed samples, shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttera.functions.hashing import order_hash
from uttera.operators import sequence


def limit_selected(df: DataFrame, n: int, order: tuple[str, ...] = ("source_ord", "row_index")) -> DataFrame:
    """First n rows in source order; runs as a per-partition top-n and a merge."""
    return df.orderBy(*order).limit(n)


def hardest(pairs: DataFrame, k: int) -> DataFrame:
    """Mismatches first, then the SMALLEST difference in length; ties by id."""
    gap = F.abs(F.length("ref") - F.length("hyp"))
    return pairs.orderBy((F.col("ref") == F.col("hyp")).asc(), gap.asc(), F.col("utterance_id").asc()).limit(k)


def sample_k(df: DataFrame, k: int, seed: int, key: str = "utterance_id") -> DataFrame:
    """k rows in the order of a seeded hash: the same rows in every run and engine."""
    return df.withColumn("__h", order_hash(F.col(key), seed)).orderBy("__h", key).limit(k).drop("__h")


def examples_table(pairs: DataFrame, k: int, seed: int, split: str, epoch: int, step: int) -> DataFrame:
    """Both example categories, ranked; windows run over the k picked rows only."""
    hard = hardest(pairs, k).withColumn("__o", F.struct(
        (F.col("ref") == F.col("hyp")), F.abs(F.length("ref") - F.length("hyp")), F.col("utterance_id").alias("id")
    ))
    chance = sample_k(pairs, k, seed).withColumn("__o", order_hash(F.col("utterance_id"), seed))
    parts = []
    for category, picked in (("hardest", hard), ("random", chance)):
        ranked = picked.withColumn("category", F.lit(category)).withColumn(
            "rank", F.row_number().over(Window.partitionBy("category").orderBy("__o"))
        )
        parts.append(
            ranked.select(
                F.lit(split).alias("split"),
                "category",
                F.lit(epoch).alias("epoch"),
                F.lit(step).alias("step"),
                "rank",
                "utterance_id",
                F.coalesce("speaker_id", F.lit("")).alias("speaker_id"),
                F.col("ref").alias("reference"),
                F.col("hyp").alias("hypothesis"),
            )
        )
    return parts[0].unionByName(parts[1])


def topk_runs(df: DataFrame, k: int, signature: str = "signature") -> DataFrame:
    """The k best runs of each signature by (wer, step, epoch).

    Spark pushes ``rank <= k`` below the shuffle (window group limit), so a signature with
    very many runs sends at most k rows per task.
    """
    best = Window.partitionBy(signature).orderBy("wer", "step", "epoch", "path")
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def latest_artifact(df: DataFrame, required: list[str], keys: list[str]) -> DataFrame:
    """Complete artifact with the highest step."""
    complete = df
    for column in required:
        complete = complete.filter(F.col(column).isNotNull())
    newest = F.max_by(F.struct("path", "step"), F.struct("step", "path"))
    return complete.groupBy(*keys).agg(newest.alias("a")).select(*keys, "a.path", "a.step")


def epoch_shuffle(df: DataFrame, seed: int, epoch: int, key: str = "utterance_id") -> DataFrame:
    """A permutation fixed by (seed + epoch): ``pos`` is each row's place in it.

    The hash is uniform, so its first four hex digits cut the order into 65,536 even
    blocks and no task sorts more than one block.
    """
    hashed = df.withColumn("__h", order_hash(F.col(key).cast("string"), seed + epoch))
    block = F.conv(F.substring("__h", 1, 4), 16, 10).cast("bigint")
    return sequence.dense_position(hashed, "__h", "pos", block=block).drop("__h")


def best_so_far(df: DataFrame, run: str, step: str, value: str, chunk: int = sequence.CHUNK) -> DataFrame:
    """Running best value of each run and whether a step strictly improved on it."""
    low = sequence.running_min(df, [run], step, value, "best", "__prior", chunk)
    improved = F.col("__prior").isNull() | (F.col(value) < F.col("__prior"))
    return low.withColumn("improved", improved).drop("__prior")


def progress_interval(total: Column) -> Column:
    """Rows between two progress messages."""
    return F.when(total <= 0, 1).otherwise(
        F.greatest(F.lit(1000), F.least(F.lit(50000), F.floor(total / 20)))
    )


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, object]:
    """Row counters collected while the job runs, in place of progress logging."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return df.observe(watch, *(metrics or (F.count(F.lit(1)).alias("rows"),))), watch
