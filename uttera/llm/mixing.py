"""Mixing sources to target weights by a low-discrepancy schedule.

Sources share a budget of words by weight, none above a multiple of its own size (water filling). A schedule of
slots is laid out by golden-ratio points: slot i has the point frac(i * phi), which falls into one source's part of
the cumulative targets. Slots are ranked within their source. The words of a source, its documents shuffled by
a hash and run through as often as needed, are cut into as many equal blocks as the source has slots; the
r-th slot takes the r-th block.

Everything is DataFrame expressions. A source with a third of all rows is cut by its hash into buckets of about
BUCKET_ROWS rows, whose word counts are prefix-summed, and no task gets a source whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttera.operators.sequence import null_safe_join, rank_in_group
from uttera.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words that a slot stands for, on average.
SLOT_WORDS = 1024
BUCKET_ROWS = 1024
#: Slots that are ranked together.
SLOT_BLOCK = 1024
# Fixed value: 2 ** 32 divided by the golden ratio. Points have 32 bits and repeat after 2 ** 31 slots.
GOLDEN = 2654435769
SPACE = 1 << 32
GRID_BITS = 12
#: Sources up to which tables with a row per source are broadcast; beyond, their joins shuffle.
FEW_SOURCES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    marked = F.regexp_replace(F.col(text), WORD, "w")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def shuffle_key(doc_id: str, text: str) -> Column:
    """Hex digest by which documents of a source are shuffled; equal rows have equal keys."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, sid, rows, source_size, target), a row per source, null last, from (source, size).

    The windows run over sources, not over documents.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long")).select(
        "*",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).alias("w"),
        (F.lit(most) * F.col("source_size")).alias("cap"),
        (F.lit(share) * F.sum("source_size").over(everything)).alias("budget"),
    )
    # Sources in the order in which a rising level per weight fills them up to their caps.
    filling = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    per = per.select(
        "*",
        F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    level = F.struct((F.col("cap") / F.col("w")).alias("at"), "sid", (F.col("budget") - F.col("full")).alias("left"), "open")
    holds = (F.col("budget") - F.col("full")) / F.col("open") <= F.col("cap") / F.col("w")
    per = per.withColumn("level", F.min(F.when(holds, level)).over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("level.left") * F.col("w") / F.col("level.open"))
    return per.select("source", "sid", "rows", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def _per_source(df: DataFrame, sources: int) -> DataFrame:
    """A table with a row per source, to be broadcast where that is small."""
    return F.broadcast(df) if sources <= FEW_SOURCES else df


def streams(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(docs.*, sid, source_size, target, __bucket, __row, __at): where a document's words begin in the shuffled
    words of its source. ``docs`` has source, size and key."""
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(SPACE))
    placed = null_safe_join(docs, _per_source(targets, targets.count()), ["source"]).withColumn("__bucket", place.cast("long"))
    sums = placed.groupBy("sid", "__bucket").agg(F.sum("size").alias("__n"))
    earlier = Window.partitionBy("sid").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("sid", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("sid", "__bucket").orderBy("key")
    local = placed.select(
        "*",
        F.row_number().over(inside).alias("__row"),
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("__local"),
    )
    return (
        local.join(before, ["sid", "__bucket"])
        .withColumn("__at", F.col("__before") + F.col("__local"))
        .drop("__before", "__local", "rows")
    )


def schedule(targets: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """(slot, sid, rank, slots, words): the slots in order, the rank of each within its source (from 0), the number
    of slots of the source and the words it takes in all.

    A source whose part is too narrow for any point gets one slot at the end.
    """
    spark = targets.sparkSession
    goal = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    parts = targets.select("sid", goal.alias("words"), "target").filter("words > 0")
    total, sources = parts.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    n = -(-total // slot_words)
    until = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.round(F.sum("target").over(until) / F.sum("target").over(everything) * F.lit(SPACE)).cast("long")
    parts = parts.withColumn("high", end).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("sid")), F.lit(0)))
    cells = parts.filter("high > low").withColumn(
        "cell", F.explode(F.sequence(F.shiftright("low", 32 - GRID_BITS), F.shiftright(F.col("high") - 1, 32 - GRID_BITS)))
    )
    point = (F.col("id") % (1 << 31)) * F.lit(GOLDEN) % F.lit(SPACE)
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", 32 - GRID_BITS)).join(_per_source(cells, sources), "cell").filter(
        "point >= low and point < high"
    )
    ranked = rank_in_group(slots.select("slot", "sid"), ["sid"], "slot", chunk=SLOT_BLOCK).withColumn("rank", F.col("rank").cast("long") - 1)
    counts = slots.groupBy("sid").agg(F.count("*").alias("slots"))
    held = parts.select("sid", "words").join(counts, "sid", "left")
    late = held.filter("slots is null").select((F.lit(n) + F.col("sid")).alias("slot"), "sid", F.lit(0).cast("long").alias("rank"))
    sizes = held.select("sid", F.coalesce("slots", F.lit(1)).alias("slots"), "words")
    return ranked.select("slot", "sid", "rank").unionAll(late).join(_per_source(sizes, sources), "sid")


def _edge(rank: Column) -> Column:
    """Word at which the block of a rank begins."""
    return F.when(rank >= F.col("slots"), F.col("words")).otherwise(
        F.least(F.floor(rank * (F.col("words") / F.col("slots"))).cast("long"), F.col("words"))
    )


def _passes(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """A row per document and pass over its source, with ``begin`` and ``slots``, ``words`` of the source."""
    sizes = cut_lineage(plan.groupBy("sid").agg(F.max("slots").alias("slots"), F.max("words").alias("words")))
    return placed.join(_per_source(sizes, sizes.count()), "sid", "left").select(
        "*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(MOST)])).alias("pass")
    ).withColumn("begin", F.col("__at") + F.col("pass") * F.col("source_size"))


def mix_words(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """(placed.*, slot, pass, start, end): which words of a document each slot takes, start and end in words of the
    document; a document of which nothing is taken has one row without a slot."""
    passes = _passes(placed, plan)
    stop = F.least(F.col("begin") + F.col("size"), F.col("words"))
    # The block of a word is found by division; one more on either side makes up for rounding.
    per = F.col("words") / F.col("slots")
    first = F.greatest(F.floor(F.col("begin") / per) - 1, F.lit(0)).cast("long")
    last = F.least(F.floor(stop / per) + 1, F.col("slots") - 1).cast("long")
    ranks = F.when(F.col("begin") < stop, F.sequence(first, F.greatest(first, last)))
    blocks = passes.withColumn("stop", stop).withColumn("rank", F.explode_outer(ranks)).withColumns(
        {"from": F.greatest(F.col("begin"), _edge(F.col("rank"))), "to": F.least(F.col("stop"), _edge(F.col("rank") + 1))}
    )
    empty = F.col("rank").isNull()
    blocks = blocks.filter((F.col("to") > F.col("from")) | (empty & (F.col("pass") == 0)))
    return blocks.join(plan.select("sid", "rank", "slot"), ["sid", "rank"], "left").select(
        *placed.columns, "slot", "pass",
        F.when(F.col("slot").isNotNull(), F.col("from") - F.col("begin")).alias("start"),
        F.when(F.col("slot").isNotNull(), F.col("to") - F.col("begin")).alias("end"),
    )


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document: words taken of it, repeats counted.

    Each source's taken words add up to its target rounded; no document gives more than MOST times its size. Null
    sources are one source; null and empty texts have no words and give none; repeated rows keep a row
    each; an empty table gives no rows. Reruns agree.
    """
    slim = cut_lineage(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), shuffle_key(doc_id, text).alias("key")
        )
    )
    targets = cut_lineage(source_targets(slim))
    plan = cut_lineage(schedule(targets))
    words = mix_words(streams(slim, targets), plan)
    return words.groupBy("sid", "__bucket", "__row", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("taken")
    ).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(record, slot): the documents of the mix, whole, once for each pass that takes the middle of their words.

    ``record`` is the input row, ``slot`` the place in the schedule.
    """
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
        F.col(source).alias("source"),
        word_count(text).alias("size"),
        shuffle_key(doc_id, text).alias("key"),
    )
    targets = cut_lineage(source_targets(keyed.select("source", "size")))
    plan = cut_lineage(schedule(targets))
    passes = _passes(streams(keyed, targets), plan)
    middle = F.col("begin") + F.floor(F.col("size") / 2)
    rank = F.floor(middle / (F.col("words") / F.col("slots"))).cast("long")
    rank = F.when(_edge(rank) > middle, rank - 1).when(_edge(rank + 1) <= middle, rank + 1).otherwise(rank)
    taken = passes.filter(middle < F.col("words")).withColumn("rank", rank)
    return taken.select("record", "sid", "rank").join(plan.select("sid", "rank", "slot"), ["sid", "rank"]).select("record", "slot")
