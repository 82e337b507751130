"""Cleaning, rejection, splitting and auditing."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttera.catalog import views as v
from uttera.catalog.base import query
from uttera.functions import hashing, text
from uttera.operators import audit, quality, splits

COUNTERS = ",\n".join(f"count(*) FILTER (reject_reason = '{r}') AS skipped_{r}" for r in quality.REASONS)


@query(
    "loader_summary",
    v.sql(
        f"""SELECT source, count(*) AS scanned,
        count(*) FILTER (reject_reason IS NULL AND split = 'train') AS selected, {COUNTERS},
        count(*) FILTER (reject_reason IS NULL AND split <> 'train') AS skipped_split, 'train' AS split
        FROM judged GROUP BY source""",
        "judged",
    ),
)
def loader_summary(spark, folder):
    return audit.loader_summary(v.judged(spark, folder))


@query(
    "rejection_reason",
    v.sql("SELECT coalesce(reject_reason, 'usable') AS reason, split, count(*) AS n FROM judged GROUP BY ALL", "judged"),
)
def rejection_reason(spark, folder):
    reason = F.coalesce(F.col("reject_reason"), F.lit("usable")).alias("reason")
    return v.judged(spark, folder).groupBy(reason, "split").agg(F.count("*").alias("n"))


@query("normalize_transcript", v.sql("SELECT row_index, transcript FROM picked", "picked"))
def normalize_transcript(spark, folder):
    return v.manifest(spark, folder).select(
        "row_index", text.normalize_transcript(F.col("sentence")).alias("transcript")
    )


@query("assign_split", v.sql("SELECT utterance_id, split FROM records", "records"))
def assign_split(spark, folder):
    return v.records(spark, folder).select("utterance_id", "split")


@query(
    "split_audit",
    v.sql(
        """SELECT split, count(*) AS samples, count(DISTINCT speaker_id) AS speakers,
        count(speaker_id) AS records_with_speaker_id, round(sum(num_samples / sample_rate) / 3600, 6) AS hours
        FROM records GROUP BY split""",
        "records",
    ),
)
def split_audit(spark, folder):
    return audit.split_audit(v.records(spark, folder)).withColumn("hours", F.round("hours", 6))


@query(
    "split_totals",
    v.sql(
        """SELECT round(sum(num_samples / sample_rate) / 3600, 6) AS total_hours,
        count(*) = count(speaker_id) AS speaker_id_available FROM records""",
        "records",
    ),
)
def split_totals(spark, folder):
    totals = audit.split_totals(audit.split_audit(v.records(spark, folder)))
    return totals.withColumn("total_hours", F.round("total_hours", 6))


@query(
    "speaker_balance",
    v.sql(
        """SELECT CASE WHEN count(*) FILTER (n > 0) >= 2 THEN max(n)::double / min(n) FILTER (n > 0) ELSE 1.0 END
        AS speaker_balance_ratio FROM (SELECT split, count(DISTINCT speaker_id) AS n FROM records GROUP BY split)""",
        "records",
    ),
)
def speaker_balance(spark, folder):
    return audit.speaker_balance(audit.split_audit(v.records(spark, folder)))


@query(
    "speaker_overlap",
    v.sql(
        """, s AS (SELECT DISTINCT split, speaker_id FROM (SELECT *, 'train' AS x FROM records) WHERE speaker_id IS NOT NULL),
        p AS (SELECT 'train' AS a, 'validation' AS b UNION ALL SELECT 'train', 'test' UNION ALL SELECT 'validation', 'test')
        SELECT a || '_vs_' || b AS pair, (SELECT count(*) FROM s x JOIN s y USING (speaker_id) WHERE x.split = a AND y.split = b) AS shared_speakers FROM p""",
        "records",
    ),
)
def speaker_overlap(spark, folder):
    return audit.speaker_overlap(v.records(spark, folder))


# A split by utterance leaks speakers, which gives the overlap operators rows to find.
_LEAKY = f"""SELECT *, CASE WHEN u2 < 0.8 THEN 'train' ELSE 'validation' END AS leaky
FROM (SELECT *, {v.sql_unit_hash('utterance_id', 7)} AS u2 FROM records)"""


@query(
    "intersect_speakers",
    v.sql(
        f""", x AS ({_LEAKY}) SELECT speaker_id FROM x WHERE leaky = 'train' AND speaker_id IS NOT NULL
        INTERSECT SELECT speaker_id FROM x WHERE leaky = 'validation' AND speaker_id IS NOT NULL""",
        "records",
    ),
)
def intersect_speakers(spark, folder):
    u = hashing.unit_hash(F.col("utterance_id"), 7)
    leaky = v.records(spark, folder).withColumn("split", F.when(u < 0.8, "train").otherwise("validation"))
    return audit.intersect_speakers(leaky, "train", "validation")


@query(
    "duration_hours",
    v.sql(
        """SELECT source, round(sum(num_samples / sample_rate) / 3600, 6) AS hours,
        round(sum(estimated_frames) * 160 / 16000 / 60, 6) AS frame_minutes FROM records GROUP BY source""",
        "records",
    ),
)
def duration_hours(spark, folder):
    out = audit.duration_hours(v.records(spark, folder), ["source"])
    return out.withColumns({"hours": F.round("hours", 6), "frame_minutes": F.round("frame_minutes", 6)})


@query(
    "external_validation",
    v.sql(
        """SELECT split, count(*) AS n, count(DISTINCT text) AS texts FROM (
        SELECT 'train' AS split, text FROM documents UNION ALL SELECT 'validation', text FROM benchmark) GROUP BY split""",
    ),
)
def external_validation(spark, folder):
    train = v.table(spark, folder, "documents").select("text")
    held_out = v.table(spark, folder, "benchmark").select("text")
    return splits.split_plan(train, held_out).groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("text").alias("texts")
    )
