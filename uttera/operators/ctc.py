"""Frame-level model outputs as tables (utterance_id, frame, vector): diagnostics, greedy
decoding, segments and pooling. Frames are numbered 0..n-1 without gaps.

Vector means use the built-in vector summarizer, an aggregate with map-side combine, so
neither an utterance nor a segment is ever gathered into one array.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttera.functions import arrays
from uttera.operators import sequence
from uttera.operators.common import computed_once
from uttera.operators.sequence import CHUNK

UTT, FRAME = "utterance_id", "frame"


def vector_mean(column: str, weight: Column | None = None) -> Column:
    vec = array_to_vector(F.col(column).cast("array<double>"))
    return vector_to_array(Summarizer.mean(vec, weight) if weight is not None else Summarizer.mean(vec))


def valid_frames(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """Frames before the utterance's length; ``lengths`` has one row per utterance."""
    return frames.join(lengths.select(UTT, F.col("length").alias("__len")), UTT).filter(
        F.col(FRAME) < F.col("__len")
    ).drop("__len")


def log_softmax(frames: DataFrame, logits: str = "logits", out: str = "log_probs") -> DataFrame:
    once = computed_once(frames, __lse=arrays.log_sum_exp(F.col(logits)))
    shifted = F.transform(F.col(logits), lambda x: x - F.col("__lse"))
    return once.withColumn(out, shifted).drop("__lse")


def _without(a: Column, index: int) -> Column:
    return F.filter(a, lambda x, i: i != index)


def ctc_stats(frames: DataFrame, blank: int = 0, column: str = "log_probs") -> DataFrame:
    """Sums over all frames plus the averages derived from them, one row."""
    lp = F.col(column)
    per_frame = frames.select(
        F.exp(F.element_at(lp, blank + 1)).alias("p_blank"),
        (arrays.argmax(lp) == blank).alias("is_blank"),
        F.exp(F.array_max(_without(lp, blank))).alias("p_top"),
    )
    sums = per_frame.agg(
        F.coalesce(F.sum("p_blank"), F.lit(0.0)).alias("blank_probability_sum"),
        F.count("*").alias("decoded_frames"),
        F.count_if("is_blank").alias("argmax_blank_frames"),
        F.coalesce(F.sum("p_top"), F.lit(0.0)).alias("top_nonblank_probability_sum"),
    )
    n = F.greatest(F.col("decoded_frames"), F.lit(1))
    return sums.select(
        "*",
        (F.col("blank_probability_sum") / n).alias("avg_blank_probability"),
        (F.col("argmax_blank_frames") / n).alias("argmax_blank_fraction"),
        (F.col("top_nonblank_probability_sum") / n).alias("avg_top_nonblank_probability"),
    )


def minimum_frames(ids: Column) -> Column:
    """A repeat needs a blank between its two tokens."""
    return F.size(ids) + arrays.adjacent_repeats(ids)


def ctc_feasible(targets: DataFrame, ids: str = "ids", frames: str = "n") -> DataFrame:
    """Per utterance: needed frames, impossible (too few) and tight (none to spare)."""
    need = minimum_frames(F.col(ids))
    return targets.withColumn("min_frames", need).select(
        "*",
        (F.col(frames) < F.col("min_frames")).alias("impossible"),
        (F.col(frames) <= F.col("min_frames")).alias("tight"),
    )


def ctc_length_summary(targets: DataFrame, ids: str = "ids", frames: str = "n") -> DataFrame:
    marked = ctc_feasible(targets, ids, frames)
    samples = F.greatest(F.count("*"), F.lit(1))
    return marked.agg(
        F.count("*").alias("sample_count"),
        (F.sum(frames) / samples).alias("avg_output_frames"),
        (F.sum(F.size(ids)) / samples).alias("avg_target_tokens"),
        (F.sum(F.size(ids)) / F.greatest(F.sum(frames), F.lit(1))).alias("target_tokens_per_frame"),
        (F.count_if("impossible") / samples).alias("impossible_sample_fraction"),
        (F.count_if("tight") / samples).alias("tight_sample_fraction"),
    )


def logit_stats(frames: DataFrame, blank: int = 0, column: str = "logits") -> DataFrame:
    x = F.col(column)
    best = computed_once(
        frames.select(column),
        lse=arrays.log_sum_exp(x),
        top=F.array_max(x),
        second=F.get(F.sort_array(x, False), 1),
        blank=F.element_at(x, blank + 1),
        other=F.array_max(_without(x, blank)),
    )
    # entropy = lse - sum(p * x), with p = exp(x - lse)
    mean_logit = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("lse")) * v)
    return best.select("*", (F.col("lse") - mean_logit).alias("entropy")).agg(
        F.count("*").alias("decoded_frames"),
        F.avg("blank").alias("avg_blank_logit"),
        F.avg("top").alias("avg_top_logit"),
        F.avg(F.coalesce(F.col("top") - F.col("second"), F.lit(0.0))).alias("avg_top2_margin"),
        F.avg(F.col("blank") - F.col("other")).alias("avg_blank_nonblank_margin"),
        F.avg("entropy").alias("avg_entropy"),
    )


def encoder_stats(frames: DataFrame, column: str = "logits") -> DataFrame:
    x = F.col(column)
    per_frame = frames.select(
        arrays.array_total(x).alias("s"), arrays.dot(x, x).alias("q"), F.size(x).alias("n")
    )
    mean = F.sum("s") / F.greatest(F.sum("n"), F.lit(1))
    square = F.sum("q") / F.greatest(F.sum("n"), F.lit(1))
    return per_frame.agg(
        mean.alias("avg_mean"),
        F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("avg_std"),
        F.avg(F.sqrt("q")).alias("avg_token_l2_norm"),
    )


def token_histogram(frames: DataFrame, k: int = 5, column: str = "logits") -> DataFrame:
    """The k most frequent argmax tokens with their share of all frames.

    Frames are counted once per token; the total is a window over those counts, a row per entry of the vocabulary.
    """
    counts = frames.groupBy(arrays.argmax(F.col(column)).alias("token_id")).agg(F.count("*").alias("n"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        counts.select("token_id", (F.col("n") / F.sum("n").over(everything)).alias("share"))
        .orderBy(F.desc("share"), "token_id")
        .limit(k)
    )


def with_argmax(frames: DataFrame, column: str = "logits", out: str = "label") -> DataFrame:
    return frames.withColumn(out, arrays.argmax(F.col(column)))


def ctc_tokens(labels: DataFrame, blank: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Emitted tokens in long form: a label that differs from the one before and is no blank."""
    before = sequence.neighbour(labels.select(UTT, FRAME, "label"), [UTT], FRAME, {"label": "__prev"}, -1, chunk)
    new = F.col("__prev").isNull() | (F.col("__prev") != F.col("label"))
    return before.filter(new & (F.col("label") != blank)).drop("__prev")


def ctc_greedy(labels: DataFrame, vocab: DataFrame, blank: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Greedy transcript per utterance, empty ones included. The tokens of a transcript are
    put together only after repeats and blanks are gone: they are the output cell."""
    emitted = ctc_tokens(labels, blank, chunk).join(
        vocab.select(F.col("id").alias("label"), "token"), "label", "left"
    )
    text = emitted.groupBy(UTT).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct(FRAME, "token")))["token"], "").alias("hyp")
    )
    return labels.select(UTT).distinct().join(text, UTT, "left").select(
        UTT, F.coalesce("hyp", F.lit("")).alias("hyp")
    )


def number_runs(before: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``run`` from the previous label: it counts the frames at which a stretch starts."""
    starts = F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col("label")), 1).otherwise(0)
    return sequence.running_sum(before, [UTT], FRAME, starts, "run", chunk)


def with_runs(labels: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``run``: the number of the maximal stretch of equal labels a frame belongs to."""
    before = sequence.neighbour(labels, [UTT], FRAME, {"label": "__prev"}, -1, chunk, keep_block=True)
    return number_runs(before, chunk).drop("__prev")


def ctc_segments(labels: DataFrame, blank: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Stretches (start, end, label), end exclusive, blanks dropped."""
    runs = with_runs(labels.select(UTT, FRAME, "label"), chunk).filter(F.col("label") != blank)
    return runs.groupBy(UTT, "run").agg(
        F.min(FRAME).alias("start"), (F.max(FRAME) + 1).alias("end"), F.first("label").alias("label")
    ).drop("run")


def compress_segments(
    frames: DataFrame, dim: int, blank: int = 0, column: str = "logits", chunk: int = CHUNK
) -> DataFrame:
    """Mean vector per non-blank stretch; one zero vector where an utterance has none."""
    runs = with_runs(frames, chunk).filter(F.col("label") != blank)
    means = runs.groupBy(UTT, "run").agg(F.min(FRAME).alias("start"), vector_mean(column).alias("vector")).drop("run")
    all_utts = frames.select(UTT).distinct()
    empty = F.array_repeat(F.lit(0.0), dim)
    return all_utts.join(means, UTT, "left").select(UTT, "start", F.coalesce("vector", empty).alias("vector"))


def gated_pooling(
    frames: DataFrame, threshold: float, dim: int, blank: int = 0, chunk: int = CHUNK
) -> DataFrame:
    """Pooling of two posterior sets (``shallow``, ``final``) by a confidence gate.

    Fixed values: gate slope 12 and floor 0.05, smoothing 0.25, confidence within 0.05..1.
    Each stretch gives both pooled vectors and four features (confidence, shallow label
    confidence, left and right boundary), scaled up where the boundaries are weak.
    """
    label = F.col("label") + 1
    wanted = frames.select(UTT, FRAME, "label", "shallow", "final", "boundary")
    previous = {"label": "__prev", "boundary": "__left"}
    before = sequence.neighbour(wanted, [UTT], FRAME, previous, -1, chunk, keep_block=True)
    runs = number_runs(before, chunk).filter(F.col("label") != blank).withColumn("__s", F.element_at("shallow", label))
    runs = runs.withColumn("__c", (F.col("__s") + F.element_at("final", label)) * 0.5)
    gate = F.lit(1.0) / (F.exp((F.col("__c") - threshold) * -12.0) + 1.0) + 0.05
    runs = runs.withColumn("__gate", gate)
    stretches = runs.groupBy(UTT, "run").agg(
        F.min(FRAME).alias("start"),
        vector_mean("shallow", F.col("__gate")).alias("__shallow"),
        vector_mean("final", F.col("__gate")).alias("__final"),
        F.avg("__c").alias("__conf"),
        F.avg("__s").alias("__label_conf"),
        F.min_by("__left", FRAME).alias("__left"),
        F.min_by("__prev", FRAME).alias("__prev"),
        F.max_by("boundary", FRAME).alias("__right"),
    )
    # Neighbouring runs differ, so the first stretch is run 1, or run 2 after a blank run 1.
    first = (F.col("run") == 1) | ((F.col("run") == 2) & (F.col("__prev") == blank))
    placed = stretches.withColumn("__l", F.when(first, F.lit(1.0)).otherwise(F.col("__left")))
    scale = F.lit(1.0) + (F.lit(1.0) - F.col("__l")) * 0.25 + (F.lit(1.0) - F.col("__right")) * 0.25
    extra = F.array("__conf", "__label_conf", "__l", "__right")
    feature = F.concat("__shallow", "__final", extra)
    pooled = placed.withColumn("__scale", scale).select(
        UTT,
        "start",
        F.transform(feature, lambda x: x * F.col("__scale")).alias("feature"),
        F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.col("__conf"))).alias("confidence"),
    )
    empty = F.array_repeat(F.lit(0.0), 2 * dim + 4)
    return frames.select(UTT).distinct().join(pooled, UTT, "left").select(
        UTT, "start", F.coalesce("feature", empty).alias("feature"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def boundaries(labels: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """1.0 where the next label differs, 0.0 at the last frame."""
    after = sequence.neighbour(labels.select(UTT, FRAME, "label"), [UTT], FRAME, {"label": "__next"}, 1, chunk)
    changes = F.coalesce(F.col("__next") != F.col("label"), F.lit(False))
    return after.select(UTT, FRAME, changes.cast("double").alias("boundary"))


def stack_frames(frames: DataFrame, stride: int, pad: float = 0.0, column: str = "logits") -> DataFrame:
    """Concatenate each run of ``stride`` frames, the last one padded; groups hold <= stride rows."""
    slot = F.floor(F.col(FRAME) / stride).cast("bigint").alias("slot")
    grouped = frames.groupBy(UTT, slot).agg(
        F.array_sort(F.collect_list(F.struct(F.col(FRAME), F.col(column).alias("v")))).alias("xs")
    )
    flat = F.flatten(F.col("xs")["v"])
    missing = (F.lit(stride) - F.size("xs")) * F.size(F.get(F.col("xs")["v"], 0))
    return grouped.select(UTT, "slot", F.concat(flat, F.array_repeat(F.lit(pad), missing)).alias("stacked"))


def mean_pool(frames: DataFrame, column: str = "logits") -> DataFrame:
    return frames.groupBy(UTT).agg(vector_mean(column).alias("pooled"))
