"""Array expressions over frame vectors and token ids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero() -> Column:
    return F.lit(0.0)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where the body loops over it."""
    return F.get(F.transform(F.array(value), body), 0)


def array_total(a: Column) -> Column:
    return F.aggregate(a, zero(), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return array_total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, zero(), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def argmax(a: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def log_sum_exp(a: Column) -> Column:
    return let(
        F.array_max(a).cast("double"),
        lambda peak: peak
        + F.log(F.aggregate(a, zero(), lambda acc, x: acc + F.exp(x.cast("double") - peak))),
    )


def log_add(x: float, y: float) -> float:
    """log(exp(x) + exp(y)) of two numbers, for code inside tasks."""
    high, low = (x, y) if x > y else (y, x)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def log_add_exp(a: Column, b: Column) -> Column:
    ninf = F.lit(float("-inf"))
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == ninf, high).otherwise(high + F.log1p(F.exp(low - high)))


def adjacent_repeats(ids: Column) -> Column:
    """Number of positions whose id equals the one before."""
    pairs = F.arrays_zip(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))).alias("a"),
                         F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))).alias("b"))
    return F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))


def collapse_ids(ids: Column, blank: int = 0) -> Column:
    """Drop repeats of the previous id, then blanks."""
    kept = F.filter(
        F.transform(
            ids,
            lambda x, i: F.when((i > 0) & (F.try_element_at(ids, i) == x), F.lit(blank)).otherwise(x),
        ),
        lambda x: x != blank,
    )
    return kept


def interleave_blank(ids: Column, blank: int = 0) -> Column:
    """blank, t1, blank, t2, ..., blank"""
    body = F.flatten(F.transform(ids, lambda x: F.array(F.lit(blank), x)))
    return F.concat(body, F.array(F.lit(blank)))


def uniform_alignment(ids: Column, frames: Column, blank: int = 0) -> Column:
    n = F.size(ids) * 2 + 1
    spread = let(
        interleave_blank(ids, blank),
        lambda states: F.transform(
            F.sequence(F.lit(0), frames.cast("int") - 1),
            lambda t: F.element_at(states, F.least(F.floor(t * n / frames), n - 1).cast("int") + 1),
        ),
    )
    return (
        F.when(frames <= 0, F.array().cast("array<int>"))
        .when(F.size(ids) == 0, F.array_repeat(F.lit(blank), frames.cast("int")))
        .otherwise(spread)
    )


def shift_targets(ids: Column, bos: int, eos: int, offset: int) -> tuple[Column, Column]:
    moved = F.transform(ids, lambda x: x + offset)
    return F.concat(F.array(F.lit(bos)), moved), F.concat(moved, F.array(F.lit(eos)))


def prune_starts(frames: Column, tokens: Column, width: Column) -> Column:
    """First token position of the band for each frame."""
    top = F.greatest(tokens + 1 - width, F.lit(0))
    half = F.floor(width / 2)
    return F.transform(
        F.sequence(F.lit(0), frames.cast("int") - 1),
        lambda t: F.least(
            F.greatest(F.floor((t + F.lit(0.5)) * (tokens + 1) / frames) - half, F.lit(0)), top
        ).cast("int"),
    )
