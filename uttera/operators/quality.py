"""Manifest rows to records: alias columns, rejection reasons, derived audio columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.config import BOUNDS, FilterConfig, FrontendConfig, INF, TRAINING
from uttera.functions import audio, text
from uttera.operators.common import computed_once

# Accepted column names, in order of preference.
TRANSCRIPT_ALIASES = ("sentence", "transcript", "transcription", "text", "normalized_text")
SPEAKER_ALIASES = ("client_id", "speaker_id", "speaker")
DURATION_ALIASES = ("duration", "duration_seconds", "audio_duration")
ID_ALIASES = ("id", "utterance_id")

SAMPLE_RATE = FrontendConfig().sample_rate


def _first(df: DataFrame, names: tuple[str, ...], form) -> Column:
    present = [form(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(None)) if present else F.lit(None)


def pick_transcript(df: DataFrame) -> Column:
    """First alias with visible text, as written."""
    return _first(df, TRANSCRIPT_ALIASES, lambda c: F.when(~text.is_blank(c), c.cast("string"))).cast("string")


def pick_duration(df: DataFrame) -> Column:
    """First alias that is a number other than zero; an all-zero row keeps the last zero."""

    def number(c: Column) -> Column:
        value = c.cast("string").try_cast("double")
        return F.when(~F.isnan(value), value)

    present = [n for n in DURATION_ALIASES if n in df.columns]
    if not present:
        return F.lit(None).cast("double")
    *head, last = [number(F.col(n)) for n in present]
    tail = last if present[-1] == DURATION_ALIASES[-1] else F.nullif(last, F.lit(0.0))
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in head], tail)


def pick_speaker(df: DataFrame) -> Column:
    return _first(df, SPEAKER_ALIASES, lambda c: F.nullif(c.cast("string"), F.lit(""))).cast("string")


def _resolve(path: Column, base: Column) -> Column:
    folder = F.regexp_replace(base, "/+$", "")
    host = F.regexp_extract(base, "^https?://[^/]+", 0)
    return (
        F.when(text.is_url(path) | base.isin("", "."), path)
        .when(path.startswith("/"), F.concat(host, path))
        .otherwise(F.concat(folder, F.lit("/"), path))
    )


def resolve_audio(df: DataFrame, base: Column) -> tuple[Column, Column]:
    """(path, bytes): a path column wins and hides embedded bytes."""
    path = F.nullif(F.col("path"), F.lit("")) if "path" in df.columns else F.lit(None).cast("string")
    inner_path = F.lit(None).cast("string")
    data = F.lit(None).cast("binary")
    if "audio" in df.columns:
        kind = df.schema["audio"].dataType
        if isinstance(kind, T.StructType):
            names = kind.fieldNames()
            data = F.col("audio.bytes") if "bytes" in names else data
            inner_path = F.nullif(F.col("audio.path"), F.lit("")) if "path" in names else inner_path
        elif isinstance(kind, T.BinaryType):
            data = F.col("audio")
    chosen = F.coalesce(path, inner_path)
    resolved = F.when(chosen.isNotNull(), _resolve(chosen, base))
    return resolved, F.when(path.isNull(), data)


def utterance_id(df: DataFrame, audio_path: Column, row_index: Column) -> Column:
    given = _first(df, ID_ALIASES, lambda c: F.nullif(c.cast("string"), F.lit(""))).cast("string")
    return F.coalesce(given, audio_path, row_index.cast("string"))


def duration_reason(duration: Column, cfg: FilterConfig = TRAINING) -> Column:
    return F.when(duration < cfg.min_duration, "audio_too_short").when(
        duration > cfg.max_duration, "audio_too_long"
    )


def transcript_reason(c: Column, cfg: FilterConfig = TRAINING) -> Column:
    return (
        F.when(F.length(c) < cfg.min_chars, "too_short")
        .when(F.length(c) > cfg.max_chars, "too_long")
        .when(text.symbol_ratio(c) > cfg.max_symbol_ratio, "symbol_ratio")
        .when(~text.has_alnum(c), "no_alnum")
    )


def alignment_reason(
    chars: Column, words: Column, duration: Column, cfg: FilterConfig = TRAINING
) -> Column:
    """Speaking-rate bounds, low before high; bounds that cannot fail add nothing to the plan."""
    rates = (
        ("chars_per_second", chars / duration),
        ("words_per_second", words / duration),
        ("duration_per_char", duration / chars),
        ("duration_per_word", duration / words),
    )
    clauses = []
    for name, rate in rates:
        low, high = getattr(cfg, f"min_{name}"), getattr(cfg, f"max_{name}")
        if low > 0:
            clauses.append((rate < low, f"{name}_too_low"))
        if high < INF:
            clauses.append((rate > high, f"{name}_too_high"))
    if not clauses:
        return F.lit(None).cast("string")
    case = F.when((duration <= 0) | (chars <= 0) | (words <= 0), F.lit(None).cast("string"))
    for condition, reason in clauses:
        case = case.when(condition, reason)
    return case


# Every reason, in the order the checks run.
REASONS = (
    "missing_transcript",
    "missing_audio",
    "missing_duration",
    "audio_too_short",
    "audio_too_long",
    "too_short",
    "too_long",
    "symbol_ratio",
    "no_alnum",
    "chars_per_second_too_low",
    "chars_per_second_too_high",
    "words_per_second_too_low",
    "words_per_second_too_high",
    "duration_per_char_too_low",
    "duration_per_char_too_high",
    "duration_per_word_too_low",
    "duration_per_word_too_high",
)


def with_rejection(
    df: DataFrame, cfg: FilterConfig = TRAINING, base: Column | None = None, row_index: str = "row_index"
) -> DataFrame:
    """Record columns plus ``reject_reason`` (null = usable), one projection, no shuffle."""
    base = F.lit(".") if base is None else base
    path, data = resolve_audio(df, base)
    picked = df.select(
        "*",
        pick_transcript(df).alias("__raw"),
        path.alias("audio_path"),
        data.alias("audio_bytes"),
        pick_duration(df).alias("__duration"),
        pick_speaker(df).alias("__speaker"),
    )
    picked = picked.withColumn("__utterance", utterance_id(df, F.col("audio_path"), F.col(row_index)))
    picked = computed_once(picked, __text=text.normalize_transcript(F.col("__raw"), cfg.lowercase))
    t, d = F.col("__text"), F.col("__duration")
    chars, words = text.normalized_counts(t)
    picked = computed_once(picked, __chars=chars, __words=words)
    reason = (
        F.when(F.col("__raw").isNull(), "missing_transcript")
        .when(F.col("audio_path").isNull() & F.col("audio_bytes").isNull(), "missing_audio")
        .when(d.isNull(), "missing_duration")
        .otherwise(
            F.coalesce(
                duration_reason(d, cfg),
                transcript_reason(t, cfg),
                alignment_reason(F.col("__chars"), F.col("__words"), d, cfg),
            )
        )
    )
    extra = [c for c in ("source", "source_ord") if c in df.columns]
    samples = audio.num_samples(d)
    return picked.select(
        F.col(row_index).alias("row_index"),
        *extra,
        "audio_path",
        "audio_bytes",
        t.alias("transcript"),
        F.col("__utterance").alias("utterance_id"),
        F.col("__speaker").alias("speaker_id"),
        F.col("__speaker").isNotNull().alias("has_speaker_id"),
        d.alias("duration"),
        samples.alias("num_samples"),
        F.lit(SAMPLE_RATE).alias("sample_rate"),
        audio.estimate_frames(samples, F.lit(SAMPLE_RATE)).alias("estimated_frames"),
        reason.alias("reject_reason"),
    )


def usable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def require_bytes(records: DataFrame) -> DataFrame:
    return records.filter(F.col("audio_bytes").isNotNull())


def require_readable(records: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with embedded bytes, or whose path is in the listing ``files(path)``.

    Embedded rows pass as they are; only the others, which have no bytes, are joined with the listing.
    """
    embedded = records.filter(F.col("audio_bytes").isNotNull())
    listing = files.select(F.col("path").alias("__listed"))
    paths = records.filter(F.col("audio_bytes").isNull()).drop("audio_bytes")
    found = paths.join(listing, F.col("audio_path") == F.col("__listed"), "left_semi")
    kind = records.schema["audio_bytes"].dataType
    return embedded.unionByName(found.withColumn("audio_bytes", F.lit(None).cast(kind))).select(*records.columns)


def refusal(df: DataFrame) -> Column:
    """Why the thresholds of a row, in columns named as in FilterConfig, would be refused; null if they would not.

    The checks and their order are those of FilterConfig; columns that are missing or null have its defaults. For tables of
    parameter sets, such as sweeps.
    """

    def value(name: str) -> Column:
        default = F.lit(float(getattr(TRAINING, name)))
        return F.coalesce(F.col(name).cast("double"), default) if name in df.columns else default

    ratio = value("max_symbol_ratio")
    checks = [
        (value("min_chars") < 0, "min_chars must be >= 0"),
        (F.isnan(ratio) | (ratio < 0) | (ratio > 1), "max_symbol_ratio must be within [0, 1]"),
    ]
    for low, high in BOUNDS:
        lo, hi = value(low), value(high)
        checks += [
            (F.isnan(lo) | F.isnan(hi), f"{low} and {high} must be numbers"),
            (lo < 0, f"{low} must be >= 0"),
            (hi < lo, f"{high} must be >= {low}"),
        ]
    return F.coalesce(*[F.when(bad, F.lit(told)) for bad, told in checks])
