"""Vector comparisons, averages and feature normalisation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions import arrays
from uttera.functions.hashing import unit_hash
from uttera.operators.common import computed_once

EPS = 1e-8


def cosine(a: Column, b: Column) -> Column:
    return arrays.dot(a, b) / F.greatest(arrays.norm(a) * arrays.norm(b), F.lit(EPS))


def embedding_agreement(student: DataFrame, teacher: DataFrame, key: str) -> DataFrame:
    """Per key: cosine similarity and mean squared error of the unit vectors."""
    joined = student.select(key, F.col("vector").alias("a")).join(
        teacher.select(key, F.col("vector").alias("b")), key
    )
    a, b = F.col("a"), F.col("b")
    joined = computed_once(
        joined, na=F.greatest(arrays.norm(a), F.lit(1e-12)), nb=F.greatest(arrays.norm(b), F.lit(1e-12))
    )
    gaps = F.zip_with(a, b, lambda x, y: F.pow(x / F.col("na") - y / F.col("nb"), F.lit(2.0)))
    return joined.select(key, cosine(a, b).alias("cosine"), (arrays.array_total(gaps) / F.size(a)).alias("mse"))


def embedding_distance(student: DataFrame, teacher: DataFrame, key: str) -> DataFrame:
    """Mean of 1 - cosine and mean of the unit-vector error over all pairs."""
    both = embedding_agreement(student, teacher, key)
    return both.agg(F.avg(F.lit(1.0) - F.col("cosine")).alias("hidden_cosine"), F.avg("mse").alias("unit_mse"))


def average_vectors(df: DataFrame, keys: list[str], order: str, column: str = "vector") -> DataFrame:
    """Elementwise mean per group; vectors whose size differs from the first one's are skipped.

    Every size is averaged in one pass; the size that holds the first vector is then picked
    from the few rows per group.
    """
    vec = array_to_vector(F.col(column).cast("array<double>"))
    by_size = df.groupBy(*keys, F.size(column).alias("__size")).agg(
        vector_to_array(Summarizer.mean(vec)).alias("mean"),
        F.count("*").alias("averaged"),
        F.min(order).alias("__first"),
    )
    chosen = F.min_by(F.struct("mean", "averaged"), "__first")
    return by_size.groupBy(*keys).agg(chosen.alias("c")).select(*keys, "c.mean", "c.averaged")


def normalize_features(
    frames: DataFrame, key: str, column: str, min_std: float = 1e-5, variance_epsilon: float | None = None
) -> DataFrame:
    """(x - mean) / std per bin over each utterance.

    Default: population deviation, not below ``min_std``. With ``variance_epsilon`` the
    unbiased variance plus that value is used instead.
    """
    vec = array_to_vector(F.col(column).cast("array<double>"))
    stats = frames.groupBy(key).agg(
        Summarizer.metrics("mean", "variance", "count").summary(vec).alias("s")
    ).select(
        key,
        vector_to_array(F.col("s.mean")).alias("__mean"),
        vector_to_array(F.col("s.variance")).alias("__var"),
        F.col("s.count").alias("__n"),
    )
    if variance_epsilon is None:
        share = (F.col("__n") - 1) / F.col("__n")
        scale = F.transform("__var", lambda q: F.greatest(F.sqrt(q * share), F.lit(min_std)))
    else:
        scale = F.transform("__var", lambda q: F.sqrt(q + variance_epsilon))
    stats = stats.select(key, "__mean", scale.alias("__std"))
    centred = F.zip_with(F.col(column), F.col("__mean"), lambda x, m: x - m)
    return frames.join(stats, key).withColumn(
        column, F.zip_with(centred, F.col("__std"), lambda x, s: x / s)
    ).drop("__mean", "__std")


def normalize_per_frame(frames: DataFrame, column: str, min_std: float = 1e-5) -> DataFrame:
    x = F.col(column)
    once = computed_once(frames, __mean=arrays.array_total(x) / F.size(x))
    spread = F.aggregate(
        x, F.lit(0.0), lambda acc, v: acc + (v - F.col("__mean")) * (v - F.col("__mean"))
    ) / F.size(x)
    once = computed_once(once, __std=F.greatest(F.sqrt(spread), F.lit(min_std)))
    return once.withColumn(column, F.transform(x, lambda v: (v - F.col("__mean")) / F.col("__std"))).drop(
        "__mean", "__std"
    )


def spec_augment(
    frames: DataFrame,
    lengths: DataFrame,
    key: str,
    frame: str,
    column: str,
    bins: int,
    seed: int,
    epoch: int,
    freq_masks: int = 2,
    freq_width: int = 27,
    time_masks: int = 5,
    time_ratio: float = 0.05,
) -> DataFrame:
    """Zero random frequency and time bands.

    Band widths and starts are hashes of (seed, epoch, utterance, band), so a retried task
    masks the same cells and every frame decides alone, without seeing its utterance.
    ``lengths`` has (key, length): one row per utterance.
    """

    def draw(name: str, top: Column) -> Column:
        tagged = F.concat(F.col(key).cast("string"), F.lit(f":{epoch}:{name}"))
        return F.floor(unit_hash(tagged, seed) * (top + 1)).cast("int")

    out = frames.join(lengths.select(key, F.col("length").alias("__len")), key)
    bands = {}
    for i in range(freq_masks):
        drawn = draw(f"fw{i}", F.lit(freq_width))
        width = F.when(drawn < bins, drawn).otherwise(0)
        bands[f"__fw{i}"], bands[f"__fs{i}"] = width, draw(f"fs{i}", F.lit(bins) - width)
    longest = F.greatest(F.floor(F.col("__len") * time_ratio), F.lit(1))
    for i in range(time_masks):
        width = draw(f"tw{i}", longest)
        bands[f"__tw{i}"], bands[f"__ts{i}"] = width, draw(f"ts{i}", F.col("__len") - width)
    out = computed_once(out, **bands)
    in_time = F.lit(False)
    for i in range(time_masks):
        width, start = F.col(f"__tw{i}"), F.col(f"__ts{i}")
        in_time = in_time | (
            (width < F.col("__len")) & (F.col(frame) >= start) & (F.col(frame) < start + width)
        )

    def masked(x: Column, j: Column) -> Column:
        inside = in_time
        for i in range(freq_masks):
            width, start = F.col(f"__fw{i}"), F.col(f"__fs{i}")
            inside = inside | ((j >= start) & (j < start + width))
        return F.when(inside, F.lit(0.0)).otherwise(x)

    return out.withColumn(column, F.transform(F.col(column), masked)).drop("__len", *bands)
