"""Batch packing, sharding and collating."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttera.catalog import views as v
from uttera.catalog.base import query
from uttera.config import BatchConfig
from uttera.functions import audio
from uttera.operators import batching, sequence

v.VIEWS["sized"] = (
    ("records",),
    "SELECT row_index, estimated_frames, num_samples, sample_rate, length(transcript)::bigint AS token_length FROM records",
)


def sized(spark, folder):
    return v.records(spark, folder).select(
        "row_index", "estimated_frames", "num_samples", "sample_rate",
        F.length("transcript").cast("bigint").alias("token_length"),
    )


def _greedy(order: str, unit: str, fits: str) -> str:
    """SQL that packs row by row with a recursive query."""
    return v.sql(
        f""", o AS (SELECT row_index, {unit} AS unit, row_number() OVER (ORDER BY {order}, row_index) AS n FROM sized),
        g(n, row_index, batch_id, size, total) AS (
          SELECT n, row_index, 0::bigint, 1::bigint, unit::bigint FROM o WHERE n = 1
          UNION ALL
          SELECT o.n, o.row_index,
            CASE WHEN {fits} THEN g.batch_id ELSE g.batch_id + 1 END,
            CASE WHEN {fits} THEN g.size + 1 ELSE 1 END,
            CASE WHEN {fits} THEN g.total + o.unit ELSE o.unit END
          FROM g JOIN o ON o.n = g.n + 1)
        SELECT row_index, batch_id FROM g""",
        "sized",
        recursive=True,
    )


@query("batch_fixed", v.sql("SELECT row_index, (row_number() OVER (ORDER BY row_index) - 1) // 16 AS batch_id FROM sized", "sized"))
def batch_fixed(spark, folder):
    return batching.batch_fixed(sized(spark, folder), 16).select("row_index", "batch_id")


@query(
    "batch_length_bucket",
    v.sql("SELECT row_index, (row_number() OVER (ORDER BY estimated_frames, row_index) - 1) // 16 AS batch_id FROM sized", "sized"),
)
def batch_length_bucket(spark, folder):
    return batching.batch_length(sized(spark, folder), 16).select("row_index", "batch_id")


@query("batch_max_frames", _greedy("estimated_frames", "greatest(estimated_frames, 1)", "(g.size + 1) * o.unit <= 3000"))
def batch_max_frames(spark, folder):
    return batching.batch_max_frames(sized(spark, folder), 3000).select("row_index", "batch_id")


@query("batch_duration", _greedy("num_samples, estimated_frames", "num_samples", "g.total + o.unit <= 960000"))
def batch_duration(spark, folder):
    return batching.batch_duration(sized(spark, folder), 60.0).select("row_index", "batch_id")


@query("batch_adaptive", _greedy("estimated_frames, token_length", "greatest(token_length, 1)", "g.total + o.unit <= 1500"))
def batch_adaptive(spark, folder):
    return batching.batch_adaptive(sized(spark, folder), "tokens", 1500).select("row_index", "batch_id")


@query("batch_adaptive_frames", _greedy("estimated_frames, token_length", "greatest(estimated_frames, 1)", "g.total + o.unit <= 6000"))
def batch_adaptive_frames(spark, folder):
    return batching.batch_adaptive(sized(spark, folder), "frames", 6000).select("row_index", "batch_id")


@query("assign_batch", _greedy("estimated_frames", "greatest(estimated_frames, 1)", "(g.size + 1) * o.unit <= 12000"))
def assign_batch(spark, folder):
    return batching.plan_batches(sized(spark, folder), BatchConfig(max_frames=12000)).select("row_index", "batch_id")


@query("batch_plan", _greedy("num_samples, estimated_frames", "num_samples", "g.total + o.unit <= 1920000"))
def batch_plan(spark, folder):
    return batching.plan_batches(sized(spark, folder), BatchConfig(max_duration_sec=120.0)).select("row_index", "batch_id")


@query(
    "rank_in_group",
    v.sql("SELECT row_index, estimated_frames, row_number() OVER (PARTITION BY estimated_frames ORDER BY row_index) AS rank FROM sized", "sized"),
)
def rank_in_group(spark, folder):
    ranked = sequence.rank_in_group(sized(spark, folder), ["estimated_frames"], "row_index")
    return ranked.select("row_index", "estimated_frames", "rank")


@query("row_index", v.sql("SELECT row_index, row_number() OVER (ORDER BY row_index) - 1 AS pos FROM manifest", "manifest"))
def row_index(spark, folder):
    return sequence.dense_position(v.manifest(spark, folder).select("row_index"), "row_index")


_FIXED_STATS = """, s AS (SELECT b AS batch_id, count(*) AS size, max(greatest(estimated_frames, 1)) AS max_frames,
   sum(estimated_frames)::bigint AS effective_frames, sum(num_samples)::bigint AS total_samples
   FROM (SELECT *, (row_number() OVER (ORDER BY estimated_frames, row_index) - 1) // 16 AS b FROM sized) GROUP BY b)
"""


@query(
    "padding_waste",
    v.sql(
        _FIXED_STATS + """SELECT *, size * max_frames AS padded_frames,
        round((size * max_frames - effective_frames) / (size * max_frames), 9) AS waste_ratio FROM s""",
        "sized",
    ),
)
def padding_waste(spark, folder):
    stats = batching.batch_stats(batching.batch_length(sized(spark, folder), 16))
    return stats.withColumn("waste_ratio", F.round("waste_ratio", 9))


@query(
    "longest_first",
    v.sql(
        _FIXED_STATS + """SELECT batch_id, max_frames, size, row_number() OVER (ORDER BY max_frames DESC, size DESC, batch_id) - 1 AS place FROM s""",
        "sized",
    ),
)
def longest_first(spark, folder):
    stats = batching.batch_stats(batching.batch_length(sized(spark, folder), 16))
    return batching.order_batches(stats, "length").select("batch_id", "max_frames", "size", "place")


def _shard(name: str, mode: str, sql_rows: str) -> None:
    @query(
        name,
        v.sql(
            f""", p AS (SELECT row_index, row_number() OVER (ORDER BY row_index) - 1 AS pos, count(*) OVER () AS n FROM sized),
            d AS ({sql_rows}) SELECT row_index, (pos % 7)::int AS rank, pos // 7 AS slot FROM d""",
            "sized",
        ),
    )
    def run(spark, folder):
        return batching.shard_rows(sized(spark, folder), 7, mode).select("row_index", "rank", "slot")


_shard("shard_rows", "uneven", "SELECT row_index, pos FROM p")
_shard("shard_rows_drop_last", "drop_last", "SELECT row_index, pos FROM p WHERE pos < n // 7 * 7")
_shard(
    "shard_rows_pad", "pad",
    "SELECT row_index, pos FROM p UNION ALL SELECT row_index, pos + n FROM p WHERE pos < (7 - n % 7) % 7",
)


@query(
    "shard_batches",
    v.sql(
        """, b AS (SELECT row_index, (row_number() OVER (ORDER BY row_index) - 1) // 16 AS batch_id FROM sized),
        t AS (SELECT max(batch_id) + 1 AS n FROM b)
        SELECT row_index, batch_id, (p % 5)::int AS rank, p // 5 AS slot FROM (
          SELECT row_index, batch_id, batch_id AS p FROM b
          UNION ALL SELECT row_index, batch_id, batch_id + n FROM b, t WHERE batch_id < (5 - n % 5) % 5)""",
        "sized",
    ),
)
def shard_batches(spark, folder):
    batched = batching.batch_fixed(sized(spark, folder), 16)
    return batching.shard_batches(batched, 5, "pad").select("row_index", "batch_id", "rank", "slot")


@query(
    "collate",
    """WITH x AS (SELECT vec_id, label, list_resize(list_transform(embedding, lambda e: e::double), (vec_id % 64 + 1)::bigint) AS vals
         FROM embeddings),
       m AS (SELECT label, max(len(vals)) AS m FROM x GROUP BY label)
       SELECT vec_id, label AS batch_id, len(vals)::int AS length, m::int AS padded_length,
         list_resize(vals, m, 0.0::double) AS vals FROM x JOIN m USING (label)""",
)
def collate(spark, folder):
    items = v.table(spark, folder, "embeddings").select(
        "vec_id",
        F.col("label").alias("batch_id"),
        F.slice(F.col("embedding").cast("array<double>"), F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")).alias("vals"),
    )
    return batching.collate(items, "vals")


@query(
    "num_samples",
    v.sql(
        """SELECT row_index, greatest(1, round_even(duration * 16000, 0))::bigint AS num_samples
        FROM manifest""",
        "manifest",
    ),
)
def num_samples(spark, folder):
    return v.manifest(spark, folder).select("row_index", audio.num_samples(F.col("duration")).alias("num_samples"))


_RATES = "SELECT row_index, num_samples, CASE row_index % 4 WHEN 0 THEN 16000 WHEN 1 THEN 8000 WHEN 2 THEN 44100 ELSE 0 END AS rate, estimated_frames FROM sized"
_FRAMES_SQL = """greatest(CASE WHEN rate = 16000 THEN num_samples ELSE greatest(1, ceil(num_samples * 16000 / rate))::bigint END, 400) // 160 + 1"""


@query("estimate_frames", v.sql(f"SELECT row_index, CASE WHEN rate <= 0 THEN 0 ELSE {_FRAMES_SQL} END::bigint AS frames FROM ({_RATES})", "sized"))
def estimate_frames(spark, folder):
    return _rated(spark, folder).select(
        "row_index", audio.estimate_frames(F.col("num_samples"), F.col("rate")).alias("frames")
    )


def _rated(spark, folder):
    kind = F.col("row_index") % 4
    rate = F.when(kind == 0, 16000).when(kind == 1, 8000).when(kind == 2, 44100).otherwise(0)
    return sized(spark, folder).withColumn("rate", rate)


@query("reestimate_frames", v.sql(f"SELECT row_index, CASE WHEN rate <= 0 THEN estimated_frames ELSE {_FRAMES_SQL} END::bigint AS frames FROM ({_RATES})", "sized"))
def reestimate_frames(spark, folder):
    frames = audio.reestimate_frames(F.col("num_samples"), F.col("rate"), F.col("estimated_frames"))
    return _rated(spark, folder).select("row_index", frames.alias("frames"))


@query(
    "token_lengths",
    v.sql("SELECT row_index, greatest(1, CASE WHEN row_index % 3 = 0 THEN 0 ELSE 5 END, CASE WHEN row_index % 3 = 0 THEN token_length ELSE 5 END) AS token_length FROM sized", "sized"),
)
def token_lengths(spark, folder):
    from uttera.operators.vocab import fill_token_lengths

    stored = F.when(F.col("row_index") % 3 == 0, F.lit(0)).otherwise(F.lit(5)).cast("bigint")
    rows = v.records(spark, folder).select("row_index", "transcript", stored.alias("token_length"))
    return fill_token_lengths(rows, "transcript").select("row_index", "token_length")
