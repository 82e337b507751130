"""Length-aware batch packing.

Greedy packing is a recurrence over sorted rows: a batch that starts at row i takes rows until the first that no
longer fits. With prefix sums every row has two numbers, the value a batch gets that starts there and the
smallest such value with which the row still fits. Both rise along the order, so the first row that does not fit is
found by binary search. Rows are sorted once, by range partitions. Each partition tells, for any batch that may be open at
its edge, which batch is open at its end (``_exits``, a short table); the tables are chained, a step per partition;
then all partitions number their batches at the same time (``_number``).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.config import BatchConfig
from uttera.functions.audio import DEFAULT
from uttera.functions.hashing import order_hash
from uttera.operators import sequence
from uttera.operators.sequence import CHUNK

NOTHING_OPEN = -(1 << 62)


def _values(kind: str, budget: int, units: np.ndarray, row: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(value of a batch that starts at each row, smallest value of an open batch that the row still fits).

    ``row`` rows with ``total`` units come before. For cost = sum of units a batch's value is the units before it, for
    cost = rows * longest (units rise along the order) it is the number of its first row.
    """
    if kind == "sum":
        ends = total + np.cumsum(units)
        return ends - units, ends - budget
    at = row + np.arange(len(units))
    return at, at + 1 - budget // units


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _exits(kind: str, budget: int):
    """For one partition: (__part, least, leaves, batches) by rising ``least``. A batch open at the start with a value of
    ``least`` or more (up to the next row's) is followed by ``batches`` new ones, the last of value ``leaves``. Where
    ``batches`` is 0 the open batch takes the whole partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_columns(b, "__part", "__unit", "__rows", "__units") for b in batches if b.num_rows]
        if not parts:
            return
        units = np.concatenate([p[1] for p in parts])
        part, _, row, total = (int(c[0]) for c in parts[0])
        value, least = _values(kind, budget, units, row, total)
        n = len(units)
        # The next batch of a batch that starts at each row; n stands for the end. Jumps are doubled until all are there.
        jump = np.append(np.maximum(np.searchsorted(least, value, "right"), np.arange(n) + 1), n)
        last, steps = np.append(np.arange(n), n), np.append(np.ones(n, np.int64), 0)
        while (jump < n).any():
            last, steps, jump = np.where(jump < n, last[jump], last), steps + steps[jump], jump[jump]
        # Possible first starts: up to the first row that does not fit a batch from this very edge.
        entries = np.arange(min(n, int(np.searchsorted(least, value[0], "right")) + 1))
        bounds = np.concatenate([[NOTHING_OPEN], least[entries[1:] - 1]])
        leaves, count = value[last[entries]], steps[entries]
        kept = np.flatnonzero(np.r_[True, (leaves[1:] != leaves[:-1]) | (count[1:] != count[:-1])])
        rows = [np.append(bounds[kept], least[-1]), np.append(leaves[kept], 0), np.append(count[kept], 0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rows[0]), part)), *[pa.array(r) for r in rows]], names=["__part", "least", "leaves", "batches"]
        )

    return run


def _chained(tables: DataFrame) -> list[tuple[int, int, int]]:
    """(partition, value of the batch open at its start, number of that batch): one step per partition."""
    by_part: dict[int, list[tuple[int, int, int]]] = {}
    for r in tables.collect():  # a few rows per partition
        by_part.setdefault(r["__part"], []).append((r["least"], r["leaves"], r["batches"]))
    opened, number, out = NOTHING_OPEN, -1, []
    for part in sorted(by_part):
        out.append((part, opened, number))
        rows = sorted(by_part[part], key=lambda r: r[0])
        _, leaves, batches = rows[bisect_right([r[0] for r in rows], opened) - 1]
        if batches:
            opened, number = leaves, number + batches
    return out


def _number(kind: str, budget: int, kept: list[str]):
    """Batch ids of a partition, streamed from the batch open at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = number = row = total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            units, first, before, start, count = _columns(batch, "__unit", "__rows", "__units", "__opened", "__number")
            if opened is None:
                opened, number, row, total = int(start[0]), int(count[0]), int(first[0]), int(before[0])
            value, least = _values(kind, budget, units, row, total)
            starts = np.zeros(len(units), np.int64)
            at = int(np.searchsorted(least, opened, "right"))
            while at < len(units):
                starts[at], opened = 1, int(value[at])
                at = max(at + 1, int(np.searchsorted(least, opened, "right")))
            ids = number + np.cumsum(starts)
            number, row, total = int(ids[-1]), row + len(units), total + int(units.sum())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(ids)], names=[*kept, "batch_id"]
            )

    return run


def _pack(df: DataFrame, order: list[Column], unit: Column, kind: str, budget: int) -> DataFrame:
    placed = sequence.sorted_parts(df.withColumn("__unit", unit.cast("bigint")), order)
    before = sequence.sums_before(placed, __rows=F.lit(1), __units=F.col("__unit")).select("__part", "__rows", "__units")
    located = placed.withColumn("__part", sequence.part_of()).join(F.broadcast(before), "__part")
    tables = located.select("__part", "__unit", "__rows", "__units").mapInArrow(
        _exits(kind, budget), "__part long, least long, leaves long, batches long"
    )
    entries = df.sparkSession.createDataFrame(_chained(tables), "__part long, __opened long, __number long")
    schema = df.withColumn("batch_id", F.lit(0).cast("bigint")).schema
    return located.join(F.broadcast(entries), "__part").mapInArrow(_number(kind, budget, df.columns), schema)


def batch_fixed(df: DataFrame, n: int, order: str = "row_index", chunk: int = CHUNK) -> DataFrame:
    """Consecutive groups of n in the given order."""
    placed = sequence.dense_position(df, order, "__pos", chunk=chunk)
    return placed.withColumn("batch_id", F.floor(F.col("__pos") / n).cast("bigint")).drop("__pos")


def batch_length(df: DataFrame, n: int, order: str = "row_index") -> DataFrame:
    """Sort by frames, cut every n rows."""
    placed = sequence.position_by(df, [F.col("estimated_frames"), F.col(order)], "__pos")
    return placed.withColumn("batch_id", F.floor(F.col("__pos") / n).cast("bigint")).drop("__pos")


def batch_max_frames(df: DataFrame, budget: int, order: str = "row_index") -> DataFrame:
    """Padded cost: rows times the longest row must stay within the budget."""
    unit = F.greatest(F.col("estimated_frames"), F.lit(1))
    return _pack(df, [F.col("estimated_frames"), F.col(order)], unit, "longest", budget)


def batch_duration(df: DataFrame, seconds: float, order: str = "row_index", rate: int = DEFAULT.sample_rate) -> DataFrame:
    """Summed seconds, counted in whole samples at one rate so that sums are exact."""
    at_rate = F.when(
        (F.col("num_samples") > 0) & (F.col("sample_rate") > 0),
        F.floor(F.col("num_samples") * rate / F.col("sample_rate")),
    ).otherwise(0)
    return _pack(df, [at_rate, F.col("estimated_frames"), F.col(order)], at_rate, "sum", int(seconds * rate))


def batch_adaptive(df: DataFrame, unit: str, budget: int, order: str = "row_index") -> DataFrame:
    """Summed frames or tokens, rows sorted by (frames, tokens)."""
    column = {"frames": "estimated_frames", "tokens": "token_length"}[unit]
    cost = F.greatest(F.col(column), F.lit(1))
    return _pack(df, [F.col("estimated_frames"), F.col("token_length"), F.col(order)], cost, "sum", budget)


def plan_batches(df: DataFrame, cfg: BatchConfig, order: str = "row_index") -> DataFrame:
    if cfg.mode == "adaptive":
        return batch_adaptive(df, cfg.adaptive_unit, cfg.adaptive_budget, order)
    if cfg.mode == "duration":
        return batch_duration(df, cfg.max_duration_sec, order)
    if cfg.mode == "frames":
        return batch_max_frames(df, cfg.max_frames, order)
    if cfg.mode == "length":
        return batch_length(df, cfg.batch_size, order)
    return batch_fixed(df, cfg.batch_size, order)


def batch_stats(batched: DataFrame) -> DataFrame:
    """Size, longest row, effective and padded frames, samples and waste of each batch."""
    frames = F.greatest(F.col("estimated_frames"), F.lit(1))
    stats = batched.groupBy("batch_id").agg(
        F.count("*").alias("size"),
        F.max(frames).alias("max_frames"),
        F.sum("estimated_frames").alias("effective_frames"),
        F.sum("num_samples").alias("total_samples"),
    )
    padded = F.col("size") * F.col("max_frames")
    return stats.withColumn("padded_frames", padded).withColumn(
        "waste_ratio", F.greatest(padded - F.col("effective_frames"), F.lit(0)) / padded
    )


# What "heaviest" means for each mode.
HEAVIEST = {
    "length": ("max_frames", "size"),
    "frames": ("padded_frames", "max_frames"),
    "duration": ("total_samples", "max_frames"),
    "adaptive": ("effective_frames", "max_frames"),
}


def order_batches(stats: DataFrame, mode: str) -> DataFrame:
    """Adds ``place``: 0 for the heaviest batch; equal ones keep their order.

    Places come from a range-partitioned sort, so the table comes out sorted and no task gets it whole.
    """
    first, second = HEAVIEST[mode]
    return sequence.position_by(stats, [-F.col(first), -F.col(second), F.col("batch_id")], "place")


def shuffle_batches(batched: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Order of the batches in an epoch: a seeded hash of the batch id."""
    return batched.withColumn("batch_order", order_hash(F.col("batch_id").cast("string"), seed + epoch))


def _deal(df: DataFrame, pos: str, total: str, world: int, mode: str) -> DataFrame:
    p, n = F.col(pos), F.col(total)
    if mode == "drop_last":
        df = df.filter(p < F.floor(n / world) * world)
    elif mode == "pad":
        missing = F.pmod(-n, F.lit(world))
        copies = F.when(p < missing, F.array(p, p + n)).otherwise(F.array(p))
        df = df.withColumn("__p", F.explode(copies)).drop(pos).withColumnRenamed("__p", pos)
    elif mode != "uneven":
        raise ValueError("mode must be 'drop_last', 'pad' or 'uneven'")
    return (
        df.withColumn("rank", F.pmod(F.col(pos), F.lit(world)).cast("int"))
        .withColumn("slot", F.floor(F.col(pos) / world).cast("bigint"))
        .drop(pos, total)
    )


def shard_rows(
    df: DataFrame, world: int, mode: str = "uneven", order: str = "row_index", chunk: int = CHUNK
) -> DataFrame:
    """Row i goes to rank i mod world; the tail is dropped, wrapped to the start, or uneven."""
    placed = sequence.dense_position(df, order, "__pos", total="__rows", chunk=chunk)
    return _deal(placed, "__pos", "__rows", world, mode)


def shard_batches(batched: DataFrame, world: int, mode: str = "uneven") -> DataFrame:
    """The same on whole batches; batch ids are already dense, so no ranking is needed and
    their number is a scalar subquery."""
    total = batched.agg(F.max("batch_id") + 1).scalar()
    placed = batched.withColumn("__pos", F.col("batch_id")).withColumn("__rows", total)
    return _deal(placed, "__pos", "__rows", world, mode)


def collate(df: DataFrame, values: str, pad: float = 0.0, keys: str = "batch_id") -> DataFrame:
    """Pad the arrays of each batch to its longest, keep lengths, leave null items out.

    The longest length per batch is an aggregate joined back, so arrays are not gathered.
    """
    kept = df.filter(F.col(values).isNotNull()).withColumn("length", F.size(values))
    longest = kept.groupBy(keys).agg(F.max("length").alias("padded_length"))
    missing = F.col("padded_length") - F.col("length")
    return kept.join(longest, keys).withColumn(
        values, F.concat(F.col(values), F.array_repeat(F.lit(pad), missing))
    )
