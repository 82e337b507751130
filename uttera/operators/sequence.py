"""Ordered operators whose work units stay bounded however large one group is.

A plain ``Window.partitionBy(key).orderBy(i)`` puts a whole group into one task, and a
global ``Window.orderBy`` puts the whole table there. Here every group is cut into blocks
(``block = floor(i / chunk)``), each block is ranked on its own, and the few per-block
counts are prefix-summed to give each block its offset. ``i`` has to be unique inside a
group, so a block never holds more than ``chunk`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttera.session import cut_lineage

CHUNK = 1 << 20
FAN_IN = 1 << 10


def block_of(order: Column, chunk: int = CHUNK) -> Column:
    return F.floor(order / chunk).cast("bigint")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join that also matches null keys and keeps one copy of the key columns."""
    right = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(right, cond, how).drop(*[f"__{k}" for k in keys])


def _offsets_in_groups(counts: DataFrame, keys: list[str], block: str, n: str) -> DataFrame:
    """Rows before each block inside its group; blocks with nothing before are left out."""
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("__before", F.sum(n).over(before))
        .filter(F.col("__before") > 0)
        .select(*keys, block, "__before")
    )


def _offsets_global(counts: DataFrame, block: str, n: str) -> DataFrame:
    """Rows before each block over the whole table, summed in two levels.

    Level one runs per run of FAN_IN blocks. Level two sees one row per FAN_IN * CHUNK
    source rows (about a hundred rows for 10^11), so its one task is tiny by construction.
    """
    runs = counts.withColumn("__run", F.floor(F.col(block) / FAN_IN))
    inner = Window.partitionBy("__run").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("__run").agg(F.sum(n).alias("__run_n"))
    outer = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "__run",
        F.coalesce(F.sum("__run_n").over(outer), F.lit(0)).alias("__run_before"),
        F.sum("__run_n").over(everything).alias("__total"),
    )
    return (
        runs.withColumn("__in_run", F.coalesce(F.sum(n).over(inner), F.lit(0)))
        .join(totals, "__run")
        .select(block, (F.col("__in_run") + F.col("__run_before")).alias("__before"), "__total")
    )


def rank_in_group(
    df: DataFrame, keys: list[str], order: str, out: str = "rank", chunk: int = CHUNK
) -> DataFrame:
    """1-based stable position of each row inside its group, ordered by a unique integer."""
    blocked = df.withColumn("__block", block_of(F.col(order), chunk))
    counts = blocked.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    offsets = _offsets_in_groups(counts, keys, "__block", "__n")
    local = Window.partitionBy(*keys, "__block").orderBy(order)
    ranked = blocked.withColumn("__local", F.row_number().over(local))
    return (
        null_safe_join(ranked, offsets, [*keys, "__block"])
        .withColumn(out, F.col("__local") + F.coalesce(F.col("__before"), F.lit(0)))
        .drop("__block", "__local", "__before")
    )


def dense_position(
    df: DataFrame,
    order: str,
    out: str = "pos",
    total: str | None = None,
    chunk: int = CHUNK,
    block: Column | None = None,
) -> DataFrame:
    """0-based gap-free position over the whole table, without a single-task sort.

    ``block`` may be given for orders that are not integers (a hash): it must rise with
    the order and split the rows into pieces that fit one task.
    """
    blocked = df.withColumn("__block", block_of(F.col(order), chunk) if block is None else block)
    # The counts feed both levels of the prefix sum: kept, so the rows are read for them once.
    counts = cut_lineage(blocked.groupBy("__block").agg(F.count("*").alias("__n")))
    offsets = _offsets_global(counts, "__block", "__n")
    local = Window.partitionBy("__block").orderBy(order)
    result = (
        blocked.withColumn("__local", F.row_number().over(local))
        .join(offsets, "__block")
        .withColumn(out, (F.col("__local") - 1 + F.col("__before")).cast("bigint"))
    )
    if total:
        result = result.withColumn(total, F.col("__total").cast("bigint"))
    return result.drop("__block", "__local", "__before", "__total")


def sorted_parts(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Adds __id, after one range-partitioned sort that a reliable checkpoint keeps: the low 33 bits count the rows of a
    partition, the bits above number the partitions in order. Rows equal in ``order`` come in any order."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__k{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    ranged = keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(*keys)
    return cut_lineage(ranged.withColumn("__id", F.monotonically_increasing_id()))


def part_of(row_id: str = "__id") -> Column:
    return F.shiftright(row_id, 33)


def sums_before(placed: DataFrame, **sums: Column) -> DataFrame:
    """(__part, <name>, <name>_total ...): what the partitions before each partition add up to, and all of them.

    One row per partition, so its windows and a broadcast of it are as small as the number of partitions.
    """
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = placed.groupBy(part_of().alias("__part")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return per.select(
        "__part",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums],
        *[F.sum(n).over(everything).alias(f"{n}_total") for n in sums],
    )


def position_by(df: DataFrame, order: list[Column], out: str, total: str | None = None, parts: int | None = None) -> DataFrame:
    """0-based gap-free position of each row in the order of any columns, without a single-task sort.

    ``total`` adds the number of rows.
    """
    placed = sorted_parts(df, order, parts)
    sizes = sums_before(placed, __rows=F.lit(1))
    number = F.col("__rows") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    more = [F.col("__rows_total").alias(total)] if total else []
    located = placed.withColumn("__part", part_of()).join(F.broadcast(sizes), "__part")
    return located.select(*df.columns, number.alias(out), *more)


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Inclusive running sum of an integer expression inside each group.

    Rows that already carry their ``__block`` (see ``neighbour``) are not shuffled again.
    """
    blocked = df if "__block" in df.columns else df.withColumn("__block", block_of(F.col(order), chunk))
    blocked = blocked.withColumn("__v", value.cast("bigint"))
    counts = blocked.groupBy(*keys, "__block").agg(F.sum("__v").alias("__n"))
    offsets = _offsets_in_groups(counts, keys, "__block", "__n")
    local = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.withColumn("__local", F.sum("__v").over(local))
    return (
        null_safe_join(summed, offsets, [*keys, "__block"])
        .withColumn(out, F.col("__local") + F.coalesce(F.col("__before"), F.lit(0)))
        .drop("__block", "__v", "__local", "__before")
    )


def running_min(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, prior: str, chunk: int = CHUNK
) -> DataFrame:
    """Running minimum up to each row (``out``) and up to the row before (``prior``)."""
    blocked = df.withColumn("__block", block_of(F.col(order), chunk))
    lows = blocked.groupBy(*keys, "__block").agg(F.min(value).alias("__low"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    lows = (
        lows.withColumn("__carry", F.min("__low").over(before))
        .filter(F.col("__carry").isNotNull())
        .drop("__low")
    )
    local = Window.partitionBy(*keys, "__block").orderBy(order)
    return (
        blocked.withColumn("__prev", F.min(value).over(local.rowsBetween(Window.unboundedPreceding, -1)))
        .transform(lambda d: null_safe_join(d, lows, [*keys, "__block"]))
        .withColumn(prior, F.least("__prev", "__carry"))
        .withColumn(out, F.least(F.col(prior), F.col(value)))
        .drop("__block", "__prev", "__carry")
    )


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: dict[str, str],
    step: int,
    chunk: int = CHUNK,
    keep_block: bool = False,
) -> DataFrame:
    """Value of the previous (step=-1) or next (step=1) row of a gap-free integer order.

    The edge row of each block is copied into the neighbouring block as a ghost, so one
    shuffle on (keys, block) is enough and no group is ever gathered whole.
    """
    if step not in (-1, 1):
        raise ValueError("step must be -1 or 1")
    own = block_of(F.col(order), chunk)
    other = block_of(F.col(order) - step, chunk)
    ghosted = df.withColumn(
        "__b",
        F.explode(
            F.when(own == other, F.array(F.struct(own.alias("block"), F.lit(False).alias("ghost")))).otherwise(
                F.array(
                    F.struct(own.alias("block"), F.lit(False).alias("ghost")),
                    F.struct(other.alias("block"), F.lit(True).alias("ghost")),
                )
            )
        ),
    ).select("*", F.col("__b.block").alias("__block"), F.col("__b.ghost").alias("__ghost"))
    window = Window.partitionBy(*keys, "__block").orderBy(order)
    pick = F.lag if step == -1 else F.lead
    for source, out in columns.items():
        ghosted = ghosted.withColumn(out, pick(source, 1).over(window))
    extra = () if keep_block else ("__block",)
    return ghosted.filter(~F.col("__ghost")).drop("__b", "__ghost", *extra)
