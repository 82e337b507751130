"""Reproducible sharding by a keyed permutation of global row numbers.

Rows are numbered 0 .. N-1 in the order of chosen columns. A Feistel network over Z_a x Z_b, with a * b just above
N, permutes the numbers; a number that falls beyond N walks on along its cycle until it is inside. The
place p of a row gives its shard (p mod shards) and its slot (p div shards), so shards differ by one row at most,
and where a row goes can be worked out from its number, N and the seed alone.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.operators.sequence import position_by

ROUNDS = 6
#: Steps of one walk. A step stays outside with a chance below N ** -0.5; where N < WALK ** 2 there are fewer
#: places outside than steps. Running out would raise an error.
WALK = 64
# Fixed values of the round function: odd multipliers and the modulus 2 ** 31.
MULTIPLY = (668265263, 374761393)
MASK = (1 << 31) - 1


def _sides(n: int) -> tuple[int, int]:
    a = max(2, math.isqrt(max(0, n - 1)) + 1)
    return a, max(2, -(-n // a))


def _mix(x: Column, key: int) -> Column:
    """31 mixed bits of a number below 2 ** 31."""
    x = (x * MULTIPLY[0] + key).bitwiseAND(MASK)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = (x * MULTIPLY[1]).bitwiseAND(MASK)
    return x.bitwiseXOR(F.shiftright(x, 13))


def round_keys(seed: int) -> list[int]:
    return [(seed * 7919 + (i + 1) * 104729) * 2654435761 % (1 << 31) for i in range(ROUNDS)]


def _div(x: Column, n: int) -> Column:
    """Whole-number division, exact for any bigint."""
    return F.call_function("div", x, F.lit(n).cast("long"))


def _network(x: Column, n: int, seed: int) -> Column:
    """One pass of the permutation of 0 .. a*b-1. Even rounds move the first half, odd rounds the second."""
    a, b = _sides(n)
    state = F.struct(_div(x, b).alias("l"), (x % b).cast("long").alias("r"))
    rounds = F.array(*[
        F.struct(F.lit(i % 2).alias("odd"), F.lit(k).cast("long").alias("key")) for i, k in enumerate(round_keys(seed))
    ])

    def step(s, rnd):
        moved = lambda half, size, other: (half + _mix(other, rnd["key"]) % size) % size
        return F.when(
            rnd["odd"] == 0, F.struct(moved(s["l"], a, s["r"]).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), moved(s["r"], b, s["l"]).alias("r")))

    return F.aggregate(rounds, state, step, lambda s: s["l"] * b + s["r"])


def permuted(number: Column, n: int, seed: int) -> Column:
    """Place in 0 .. n-1 of a row number in 0 .. n-1; n up to 2 ** 60."""

    def walk(first):
        end = F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)),
            first,
            lambda p, _: F.when(p < n, p).otherwise(_network(p, n, seed)),
        )
        return F.when(end < n, end).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))

    # The one-element array has the first pass worked out once; few numbers go on from there.
    passed = F.array(_network(number, n, seed))
    return F.transform(passed, lambda p: F.when(p < n, p).otherwise(walk(p)))[0]


def shard_rows(df: DataFrame, order: list[Column], shards: int, seed: int = 1) -> DataFrame:
    """(df.*, shard, slot): every row in exactly one slot; slots of a shard are gap-free from 0.

    Any values, nulls and repeated rows in ``order`` are allowed: nulls come first, and rows equal in it share
    their places in any way. An empty table gives no rows. Input columns named like the new ones are
    replaced.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    numbered = position_by(df.select(*kept), order, "__number", "__count")
    row = numbered.select("__count").first()
    placed = numbered.withColumn("__place", permuted(F.col("__number"), row[0] if row else 1, seed))
    return placed.select(
        *kept,
        (F.col("__place") % shards).cast("int").alias("shard"),
        _div(F.col("__place"), shards).alias("slot"),
    )
