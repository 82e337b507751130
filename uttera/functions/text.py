"""Text expressions, Column -> Column. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, letters and digits as Java regex classes.
WS = r"[\s\p{Z}\x1c-\x1f\x85]"
NOT_WS = r"[^\s\p{Z}\x1c-\x1f\x85]"
ALNUM = r"\p{L}\p{N}"

# The same white space as characters, the plain space left out.
OTHER_WS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Quote variants and what they become.
QUOTES_FROM = "’`ʼ“”«»"
QUOTES_TO = "'''\"\"\"\""

# Character tables are mapped by the built-in ``translate``, several times faster than a
# regex class over every character; regexes are left for runs of plain spaces.


def spaced(c: Column) -> Column:
    """Every white-space character as a plain space."""
    return F.translate(c, OTHER_WS, " " * len(OTHER_WS))


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(" " + OTHER_WS))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(NOT_WS)


def _collapsed(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), " {2,}", " ")


def normalize_transcript(c: Column, lowercase: bool = True) -> Column:
    text = F.lower(c) if lowercase else c
    text = F.translate(text, OTHER_WS + QUOTES_FROM, " " * len(OTHER_WS) + QUOTES_TO)
    return F.regexp_replace(_collapsed(text), " ([,.;:!?])", "$1")


def normalize_ws(c: Column) -> Column:
    return _collapsed(spaced(c))


def symbol_ratio(c: Column) -> Column:
    # Whole runs are taken out at a time, ASCII ones without looking at Unicode tables.
    noisy = F.length(F.regexp_replace(c, rf"(?:[a-zA-Z0-9 ]|[{ALNUM}\s\p{{Z}}\x1c-\x1f\x85'\-])++", ""))
    return F.when(F.length(c) == 0, F.lit(1.0)).otherwise(noisy / F.length(c))


def has_alnum(c: Column) -> Column:
    return c.rlike(f"[{ALNUM}]")


def char_count(c: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.translate(c, " " + OTHER_WS, ""))


def words(c: Column) -> Column:
    return F.array_remove(F.split(spaced(c), " "), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def normalized_counts(c: Column) -> tuple[Column, Column]:
    """(characters, words) of a normalised text, where single spaces part the words."""
    chars = F.length(F.replace(c, F.lit(" "), F.lit("")))
    return chars, F.when(c == "", 0).otherwise(F.length(c) - chars + 1)


def is_glued(left: Column, right: Column) -> Column:
    """Whether two pieces need no space between them; the end of ``left`` is enough."""
    return left.rlike(r"[ \n]\z") | right.rlike(r"\A[ \n,.!?:;]")


def join_transcripts(left: Column, right: Column) -> Column:
    """One space between two pieces unless one side already brings a break."""
    return (
        F.when(left == "", right)
        .when(right == "", left)
        .when(is_glued(left, right), F.concat(left, right))
        .otherwise(F.concat(left, F.lit(" "), right))
    )


def safe_id(c: Column) -> Column:
    """File-name form of an id; a digest keeps changed ids apart."""
    cleaned = F.regexp_replace(c, rf"[^{ALNUM}\-_.]", "_")
    cleaned = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    digest = F.sha2(c, 256)
    return (
        F.when(cleaned == "", F.substring(digest, 1, 16))
        .when(cleaned == c, cleaned)
        .otherwise(F.concat(F.substring(cleaned, 1, 96), F.lit("_"), F.substring(digest, 1, 8)))
    )


# Suffixes taken off preview names.
AUDIO_SUFFIXES = ("wav", "flac", "mp3", "opus", "ogg", "m4a", "aac")


def preview_name(index: Column, c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_.\-]+", "_"), r"^[._]+|[._]+$", "")
    slug = F.coalesce(F.nullif(slug, F.lit("")), F.concat(F.lit("utt"), index.cast("string")))
    slug = F.regexp_replace(slug, rf"(?i)\.({'|'.join(AUDIO_SUFFIXES)})$", "")
    number = index.cast("string")
    number = F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number)
    return F.concat(F.lit("sample_"), number, F.lit("_"), F.substring(slug, 1, 80))


def run_name(project: Column, started: Column, epoch: Column, step: Column) -> Column:
    """Slug, UTC start time and, for resumed runs, the epoch and step."""
    slug = F.regexp_replace(
        F.regexp_replace(project, r"[^A-Za-z0-9._\-]+", "-"), r"^-+|-+$", ""
    )
    slug = F.when(slug == "", F.lit("training")).otherwise(slug)
    stamp = F.date_format(started, "yyyyMMdd_HHmmss")
    resumed = F.concat(
        F.lit("_resume-e"), F.lpad(epoch.cast("string"), 4, "0"),
        F.lit("-s"), F.lpad(step.cast("string"), 8, "0"),
    )
    suffix = F.when((step > 0) | (epoch > 1), resumed).otherwise(F.lit(""))
    return F.concat(slug, F.lit("_"), stamp, suffix)


def bucket_of(n: Column) -> Column:
    return F.when(n <= 5, "short").when(n <= 15, "medium").otherwise("long")


def bucket_name(ref: Column) -> Column:
    return bucket_of(word_count(ref))


def is_url(c: Column) -> Column:
    return c.rlike(r"(?i)^https?:")


def source_suffix(c: Column) -> Column:
    """Lower-case suffix of the last path part, query and fragment of a URL left out."""
    bare = F.when(is_url(c), F.regexp_replace(c, r"[?#].*$", "")).otherwise(c)
    return F.lower(F.regexp_extract(bare, r"[^/](\.[^./]+)$", 1))


def is_hub_id(c: Column) -> Column:
    return (
        ~is_url(c)
        & ~c.rlike(r"^(/|\./|\.\./|~/)")
        & ~c.rlike(r"\.(parquet|tsv)$")
        & F.contains(c, F.lit("/"))
    )
