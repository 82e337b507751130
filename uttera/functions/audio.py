"""Audio bookkeeping expressions: sample and frame counts, codec sniffing, WAV headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.config import FrontendConfig
from uttera.functions.text import source_suffix

DEFAULT = FrontendConfig()


def num_samples(duration: Column, sample_rate: int = DEFAULT.sample_rate) -> Column:
    return F.greatest(F.lit(1), F.bround(duration * sample_rate)).cast("bigint")


def estimate_frames(samples: Column, rate: Column, config: FrontendConfig = DEFAULT) -> Column:
    """Frames of a centred transform over the resampled, minimum-padded signal."""
    target = config.sample_rate
    resampled = F.when(rate == target, samples).otherwise(
        F.greatest(F.lit(1), F.ceil(samples * target / rate))
    )
    padded = F.greatest(resampled, F.lit(max(config.n_fft, config.win_length)))
    frames = F.floor(padded / config.hop_length) + 1
    return F.when((samples <= 0) | (rate <= 0), F.lit(0)).otherwise(frames).cast("bigint")


def reestimate_frames(samples: Column, rate: Column, old: Column, config: FrontendConfig = DEFAULT) -> Column:
    """A new estimate where the metadata is known, else the old value."""
    known = (samples > 0) & (rate > 0)
    return F.when(known, estimate_frames(samples, rate, config)).otherwise(old)


def is_opus(path: Column, data: Column) -> Column:
    """By the suffix (of a URL without query and fragment) or by the mark in the first 64 KiB."""
    head = F.substring(data, 1, 65536)
    marker = F.contains(head, F.lit("OpusHead").cast("binary"))
    return F.coalesce(source_suffix(path) == ".opus", F.lit(False)) | F.coalesce(marker, F.lit(False))


def refuse_opus(df: DataFrame, path: str = "audio_path", data: str = "audio_bytes") -> DataFrame:
    """The table, unless it holds Opus clips: the first one fails the job before anything is decoded. The check is a
    filter, which no later selection of columns can leave out."""
    told = F.concat(F.lit("Opus cannot be decoded here: "), F.coalesce(F.col(path), F.lit("embedded bytes")))
    found = is_opus(F.col(path), F.col(data))
    return df.filter(F.when(found, F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))


def le_uint(data: Column, offset: Column | int, width: int) -> Column:
    """Little-endian unsigned integer at a zero-based byte offset; null when cut short."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    raw = F.hex(F.substring(data, (at + 1).cast("int"), F.lit(width)))
    swapped = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.when(F.length(raw) == 2 * width, F.conv(swapped, 16, 10).cast("bigint"))


# Chunks looked at before the sound itself. A file with more of them is "unknown", not broken.
CHUNKS = 64
# Fixed values, as hex: "RIFF", "WAVE", "fmt ", "data".
RIFF, WAVE, FORMAT, SOUND = "52494646", "57415645", "666D7420", "64617461"


def wav_header(data: Column, size: Column) -> Column:
    """Struct (status, num_samples, sample_rate, channels, bits) of a clip, read chunk by chunk.

    The walk starts behind the RIFF head and steps from chunk to chunk by the declared sizes and pad bytes, so extra
    chunks and longer format chunks do not matter. ``status`` is "pcm" where the header tells the number of samples,
    "broken" where a WAVE file provably has no usable format or sound, and "unknown" for all other bytes.
    """
    is_wave = (F.hex(F.substring(data, 1, 4)) == RIFF) & (F.hex(F.substring(data, 9, 4)) == WAVE)

    def state(at, step, rate, channels, bits, held, over):
        names = ("at", "step", "rate", "channels", "bits", "held", "over")
        return F.struct(*[x.cast("bigint").alias(n) for n, x in zip(names, (at, step, rate, channels, bits, held, over))])

    def walk(s, _):
        at = s["at"]
        kind, declared = F.hex(F.substring(data, (at + 1).cast("int"), F.lit(4))), le_uint(data, at + 4, 4)
        end = at + 8 + declared + declared % 2
        same = [s["step"], s["rate"], s["channels"], s["bits"], s["held"]]
        field = lambda offset, width: le_uint(data, at + 8 + offset, width)
        return (
            F.when(s["over"] == 1, s)
            .when(declared.isNull(), state(at, *same, F.lit(1)))
            .when(kind == FORMAT, state(end, field(12, 2), field(4, 4), field(2, 2), field(14, 2), s["held"], F.lit(0)))
            .when(kind == SOUND, state(at, *same[:4], F.least(declared, size - at - 8), F.lit(1)))
            .otherwise(state(end, *same, F.lit(0)))
        )

    none = F.lit(None)
    start = state(F.lit(12), none, none, none, none, none, F.lit(0))
    # A chunk has eight bytes at least, so short files need fewer steps.
    steps = F.sequence(F.lit(1), F.greatest(F.least(F.lit(CHUNKS), F.floor(size / 8).cast("int")), F.lit(1)))
    found = F.when(is_wave, F.aggregate(steps, start, walk))

    def finished(s):
        usable = (s["step"] > 0) & (s["rate"] > 0) & (s["channels"] > 0) & (s["held"] >= s["step"])
        status = F.when(F.coalesce(usable, F.lit(False)), "pcm").when(s["over"] == 1, "broken").otherwise("unknown")
        return F.struct(
            status.alias("status"),
            F.floor(s["held"] / s["step"]).cast("bigint").alias("num_samples"),
            s["rate"].alias("sample_rate"), s["channels"].alias("channels"), s["bits"].alias("bits"),
        )

    empty = F.struct(F.lit("unknown").alias("status"), *[none.cast("bigint").alias(n) for n in ("num_samples", "sample_rate", "channels", "bits")])
    return F.coalesce(F.transform(F.array(found), lambda s: F.when(s.isNotNull(), finished(s)))[0], empty)
