"""Error rates and evaluation reports.

Edits are counted per row with the built-in ``levenshtein``; every report above that is a
sum of (edits, reference length) and therefore a partial + final aggregate.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions import text
from uttera.operators.common import computed_once

SURROGATES = 0xD800
FIRST_CODE = 0x100
# Rows with at most this many different words find their characters in a constant array.
QUICK_CODES = 4096


def _code(at: Column) -> Column:
    """Character number ``at`` (from 1), jumping over the code points of surrogates."""
    point = at + (FIRST_CODE - 1)
    point = F.when(point >= SURROGATES, point + 0x800).otherwise(point)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def _as_characters(tokens: Column, alphabet: Column) -> Column:
    """Every word as one character: its position in the row's own alphabet.

    A row may hold over a million different words.
    """
    quick = F.from_json(F.lit(json.dumps([chr(FIRST_CODE + i) for i in range(QUICK_CODES)])), "array<string>")
    short = F.transform(tokens, lambda w: F.element_at(quick, F.array_position(alphabet, w).cast("int")))
    long = F.transform(tokens, lambda w: _code(F.array_position(alphabet, w)))
    return F.array_join(F.when(F.size(alphabet) <= QUICK_CODES, short).otherwise(long), "")


# Distances are looked for in a band around the diagonal first; only rows beyond it pay the full
# quadratic distance. The result is always exact.
BAND = 24


def _told(pairs: DataFrame) -> DataFrame:
    """Pairs without nulls: a missing reference or hypothesis counts as an empty text."""
    return pairs.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("ref", "hyp")})


def _distance(rows: DataFrame, a: Column, b: Column, out: str) -> DataFrame:
    """Adds the edit distance of two texts; equal ones skip it."""
    rows = computed_once(rows, __near=F.when(a != b, F.levenshtein(a, b, BAND)).otherwise(F.lit(0)))
    exact = F.when(F.col("__near") >= 0, F.col("__near")).otherwise(F.levenshtein(a, b))
    return rows.withColumn(out, exact.cast("bigint")).drop("__near")


def _same_ahead(a: Column, b: Column) -> Column:
    """Number of equal elements at the start of two arrays."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def with_word_edits(pairs: DataFrame) -> DataFrame:
    """Adds word_edits, ref_words and the length bucket.

    Words that both sides share at the start and the end cost nothing; the rest is coded as one
    character per word.
    """
    known = _told(pairs)
    rows = computed_once(known, __a=text.words(F.col("ref")), __b=text.words(F.col("hyp")))
    rows = rows.withColumn("ref_words", F.size("__a").cast("bigint"))
    for _ in range(2):  # from the front, then, reversed, from the back
        rows = computed_once(rows, __skip=_same_ahead(F.col("__a"), F.col("__b")))
        rest = lambda c: F.reverse(F.slice(c, F.col("__skip") + 1, F.size(c)))
        rows = computed_once(rows, __x=rest("__a"), __y=rest("__b")).drop("__a", "__b", "__skip")
        rows = rows.withColumnsRenamed({"__x": "__a", "__y": "__b"})
    rows = computed_once(rows, __alphabet=F.array_distinct(F.concat("__a", "__b")))
    rows = computed_once(
        rows,
        __wa=_as_characters(F.col("__a"), F.col("__alphabet")),
        __wb=_as_characters(F.col("__b"), F.col("__alphabet")),
    )
    return _distance(rows, F.col("__wa"), F.col("__wb"), "word_edits").select(
        *pairs.columns, "word_edits", "ref_words", text.bucket_of(F.col("ref_words")).alias("bucket")
    )


def with_char_edits(pairs: DataFrame) -> DataFrame:
    """Adds char_edits and ref_chars."""
    rows = _distance(_told(pairs), F.col("ref"), F.col("hyp"), "char_edits")
    return rows.withColumn("ref_chars", F.length("ref").cast("bigint"))


def with_edits(pairs: DataFrame) -> DataFrame:
    """Both kinds of edits and the length bucket. Null texts come out empty."""
    return with_char_edits(with_word_edits(pairs))


def rate(edits: str, length: str) -> Column:
    """Summed edits over summed length; 0 where there is nothing to compare with."""
    total = F.sum(length)
    return F.when(total > 0, F.sum(edits) / total).otherwise(F.lit(0.0))


def wer_of() -> Column:
    return rate("word_edits", "ref_words")


def cer_of() -> Column:
    return rate("char_edits", "ref_chars")


def wer(pairs: DataFrame) -> DataFrame:
    return with_word_edits(pairs).agg(
        F.sum("word_edits").alias("edits"), F.sum("ref_words").alias("total"), wer_of().alias("wer")
    )


def cer(pairs: DataFrame) -> DataFrame:
    return with_char_edits(pairs).agg(
        F.sum("char_edits").alias("edits"), F.sum("ref_chars").alias("total"), cer_of().alias("cer")
    )


BUCKETS = ("short", "medium", "long")


def bucket_metrics(edits: DataFrame) -> DataFrame:
    """One row; sample counts always, rates null where a bucket is empty."""
    columns = []
    for name in BUCKETS:
        inside = F.col("bucket") == name

        def part(column: str, inside: Column = inside) -> Column:
            return F.sum(F.when(inside, F.col(column)))

        columns += [
            F.count_if(inside).alias(f"samples_{name}"),
            F.try_divide(part("word_edits"), part("ref_words")).alias(f"wer_{name}"),
            F.try_divide(part("char_edits"), part("ref_chars")).alias(f"cer_{name}"),
        ]
    return edits.agg(*columns)


def _named() -> Column:
    return F.col("has_speaker_id") & (F.coalesce(F.col("speaker_id"), F.lit("")) != "")


def speaker_metrics(edits: DataFrame) -> DataFrame:
    return (
        edits.filter(_named())
        .groupBy("speaker_id")
        .agg(F.count("*").alias("samples"), wer_of().alias("wer"), cer_of().alias("cer"))
    )


def speaker_summary(edits: DataFrame) -> DataFrame:
    """Macro rate = unweighted mean over speakers; rows without a speaker are only counted."""
    key = F.when(_named(), F.col("speaker_id"))
    per_key = edits.groupBy(key.alias("speaker")).agg(F.count("*").alias("n"), wer_of().alias("wer"))
    known = F.col("speaker").isNotNull()
    missing = F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0))
    return per_key.agg(
        F.count_if(known).alias("speaker_count"),
        F.coalesce(F.avg(F.when(known, F.col("wer"))), F.lit(0.0)).alias("speaker_macro_wer"),
        (missing == 0).alias("speaker_id_available"),
        missing.alias("missing_speaker_id_samples"),
    )


def eval_rollup(edits: DataFrame) -> DataFrame:
    """Overall, per bucket and per speaker in one pass.

    Rows are first summed by (bucket, speaker); only those few rows are then expanded by
    the grouping sets.
    """
    sums = ["word_edits", "ref_words", "char_edits", "ref_chars"]
    base = edits.groupBy("bucket", "speaker_id").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]
    )
    grouped = base.groupingSets(
        [[], [F.col("bucket")], [F.col("speaker_id")]], F.col("bucket"), F.col("speaker_id")
    ).agg(
        F.grouping_id("bucket", "speaker_id").alias("level"),
        F.sum("n").alias("samples"),
        wer_of().alias("wer"),
        cer_of().alias("cer"),
    )
    # grouping_id of the three sets over (bucket, speaker_id).
    scope = F.when(F.col("level") == 3, "overall").when(F.col("level") == 1, "bucket").otherwise("speaker")
    return grouped.select(scope.alias("scope"), "bucket", "speaker_id", "samples", "wer", "cer")


def decode_debug(pairs: DataFrame) -> DataFrame:
    hyp = F.col("hyp")
    return pairs.agg(
        F.coalesce(F.avg(text.is_blank(hyp).cast("double")), F.lit(0.0)).alias("decoded_empty_fraction"),
        F.coalesce(F.avg(F.length(hyp)), F.lit(0.0)).alias("decoded_avg_char_length"),
        F.coalesce(F.avg(text.word_count(hyp)), F.lit(0.0)).alias("decoded_avg_word_length"),
    )


def _once(side: DataFrame, mark: str) -> DataFrame:
    """One row per id with the number of its rows; several rows give the largest."""
    others = [c for c in side.columns if c != "utterance_id"]
    return (
        side.groupBy("utterance_id")
        .agg(F.max(F.struct(*others)).alias("__row"), F.count("*").alias(mark))
        .select("utterance_id", "__row.*", mark)
    )


def pair_ref_hyp(refs: DataFrame, hyps: DataFrame, strict: bool = True) -> DataFrame:
    """References and hypotheses side by side, with all other columns of both.

    Strict pairing fails the job on an id without its partner, a repeated id and a null id. The check is a
    filter, which no later selection of columns can leave out. Without it every id gets a row with its ``state``:
    paired, ref_only, hyp_only or repeated. The sides are grouped by the join's own key, so the check adds
    no shuffle.
    """
    joined = _once(refs, "__r").join(_once(hyps, "__h"), "utterance_id", "full_outer")
    state = (
        F.when(F.col("__r").isNull(), "hyp_only")
        .when(F.col("__h").isNull(), "ref_only")
        .when((F.col("__r") > 1) | (F.col("__h") > 1), "repeated")
        .otherwise("paired")
    )
    if not strict:
        return joined.withColumn("state", state).drop("__r", "__h")
    told = F.concat(
        F.when(state == "repeated", F.lit("repeated")).otherwise(F.lit("unpaired")), F.lit(" utterance: "),
        F.coalesce(F.col("utterance_id").cast("string"), F.lit("null")),
    )
    paired = F.when(state == "paired", F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))
    return joined.filter(paired).drop("__r", "__h")


def merge_partials(partials: DataFrame, losses: list[str], weight: str) -> DataFrame:
    """Loss sums of all shards over the summed sample count, which counts as at least one."""
    total = F.greatest(F.lit(1.0), F.sum(F.col(weight).cast("double")))
    return partials.agg(
        *[(F.sum(c) / total).alias(c) for c in losses], F.sum(weight).alias("samples")
    )


def reduce_metrics(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean, sum, weighted mean, min and max over workers."""
    w = F.sum(weight)
    weighted = F.when(w > 0, F.sum(F.col(value) * F.col(weight)) / F.greatest(w, F.lit(1e-12))).otherwise(0.0)
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.sum(value).alias("total"),
        weighted.alias("weighted_mean"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )


def flatten_metrics(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """(group, m1, m2, ...) rows to (name, value) pairs named "group/metric"."""
    return df.unpivot([group], metrics, "metric", "value").select(
        F.concat_ws("/", group, "metric").alias("name"), "value"
    )


def starvation_rule(step: Column, blank: Column, argmax_share: Column, top: Column) -> Column:
    """True where blank never wins a frame early in training.

    Fixed values: steps 1 to 500, argmax share at most 0.001, blank at most half of top.
    """
    return step.between(1, 500) & (argmax_share <= 0.001) & (top > 0) & (blank <= top * 0.5)


def first_alert(df: DataFrame, run: str, step: str, rule: Column) -> DataFrame:
    """First step of each run at which the rule holds; one warning per run."""
    return df.filter(rule).groupBy(run).agg(F.min(step).alias("first_step"))
