"""Long recordings: overlapping windows and merging of their transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions import text
from uttera.functions.arrays import let

# Fixed values of the merge: at most 20 words or 120 characters may overlap, and a
# character overlap of less than 9 does not count.
MAX_WORDS, MAX_CHARS, MIN_CHARS = 20, 120, 9


def chunk_plan(
    df: DataFrame, length: float = 30.0, overlap: float = 5.0, threshold: float = 45.0, rate: int = 16000
) -> DataFrame:
    """Windows (chunk, start, end) in samples; short recordings stay in one piece."""
    size, shared = max(1, round(length * rate)), max(0, round(overlap * rate))
    if size <= shared:
        raise ValueError("the window must be longer than the overlap")
    step = size - shared
    total = F.col("num_samples")
    long_form = (total / rate > threshold) & (total > size)
    pieces = F.greatest(F.lit(1), F.ceil(F.greatest(total - shared, F.lit(0)) / step))
    n = F.when(long_form, pieces).otherwise(F.lit(1)).cast("int")
    planned = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("chunk").cast("bigint") * step
    end = F.when(long_form, F.least(total, start + size)).otherwise(total)
    return planned.select("*", start.alias("start"), end.cast("bigint").alias("end"))


def merge_two(old: Column, new: Column) -> Column:
    """Join two transcripts of neighbouring windows; both already have single spaces.

    Only the last words and characters of ``old`` can overlap, so only they are taken out, from its end. They are cut
    to the first place where ``new`` may begin; from there the leftmost match of a back-reference over the line break,
    which neither text holds, is the largest overlap.
    """
    last = F.substring_index(old, " ", -MAX_WORDS)

    def without(shared: Column) -> Column:
        return F.concat(old, F.substring(new, F.length(shared) + 1, F.length(new)))

    def matched(tail: Column, head: Column, pattern: str) -> Column:
        shared = F.regexp_extract(F.concat(tail, F.lit("\n"), head), pattern, 1)
        return let(shared, lambda s: F.when(s != "", without(s)))

    def shared_words(tail: Column) -> Column:
        at = F.instr(tail, F.concat(F.lit(" "), F.substring_index(new, " ", 1), F.lit(" ")))
        begun = F.substring(tail, at, F.length(tail) - at)
        head = F.substring_index(new, " ", MAX_WORDS)
        return F.when(at > 0, matched(begun, head, r" ([^\n]++)\n\1(?: |\z)"))

    def shared_chars(tail: Column) -> Column:
        at = F.instr(tail, F.left(new, F.lit(MIN_CHARS)))
        begun = F.substring(tail, at, F.length(tail))
        found = matched(begun, F.left(new, F.lit(MAX_CHARS)), rf"([^\n]{{{MIN_CHARS},}}+)\n\1")
        return F.when((at > 0) & (F.length(new) >= MIN_CHARS), found)

    by_words = let(F.concat(F.lit(" "), last, F.lit(" ")), shared_words)
    # Words have a character and a space at least, so that many of them hold the last characters.
    by_chars = let(F.right(F.substring_index(old, " ", -MAX_CHARS), F.lit(MAX_CHARS)), shared_chars)
    joined = F.when(text.is_glued(last, new), F.concat(old, new)).otherwise(F.concat(old, F.lit(" "), new))
    return (
        F.when(old == "", new)
        .when(new == "", old)
        .when(F.contains(old, new), old)
        .when(F.contains(new, old), new)
        .otherwise(F.coalesce(by_words, by_chars, joined))
    )


def merge_chunks(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Fold the windows of each recording, in order, into one transcript.

    Every step tests whether a window is already contained in ALL text so far, so the fold
    is sequential per recording, and its result is one cell. The windows brought together
    here are that cell's own text, which a 2 GB cell bounds; recordings run in parallel.
    """
    cleaned = df.select(key, order, text.normalize_ws(F.col(column)).alias("__t"))
    pieces = cleaned.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "__t"))).alias("xs"))
    merged = F.aggregate(F.col("xs")["__t"], F.lit(""), lambda acc, x: merge_two(acc, x))
    return pieces.select(key, merged.alias("transcript"))
