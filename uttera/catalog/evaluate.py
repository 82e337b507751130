"""Error rates, reports, examples and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttera.catalog import views as v
from uttera.catalog.base import query
from uttera.functions import text
from uttera.operators import metrics, ranking

# Words (or characters) as ASCII symbols, since the SQL engine's levenshtein counts bytes.
def _symbols(x: str, alphabet: str) -> str:
    return f"array_to_string(list_transform({x}, lambda w: chr(33 + list_position({alphabet}, w)::int)), '')"


def _distance(a: str, b: str, alphabet: str) -> str:
    return f"levenshtein({_symbols(a, alphabet)}, {_symbols(b, alphabet)})"


v.VIEWS["worded"] = (
    ("pairs",),
    f"""SELECT *, list_distinct(list_concat(rw, hw)) AS wd, list_distinct(list_concat(rc, hc)) AS cd FROM (
        SELECT *, {v.sql_words('ref')} AS rw, {v.sql_words('hyp')} AS hw,
        string_split(ref, '') AS rc, string_split(hyp, '') AS hc FROM pairs)""",
)
v.VIEWS["edits"] = (
    ("worded",),
    f"""SELECT * EXCLUDE (rw, hw, rc, hc, wd, cd), {_distance('rw', 'hw', 'wd')}::bigint AS word_edits, len(rw)::bigint AS ref_words,
        {_distance('rc', 'hc', 'cd')}::bigint AS char_edits, length(ref)::bigint AS ref_chars,
        CASE WHEN len(rw) <= 5 THEN 'short' WHEN len(rw) <= 15 THEN 'medium' ELSE 'long' END AS bucket
        FROM worded""",
)

WER = "round(CASE WHEN sum(ref_words) > 0 THEN sum(word_edits)::double / sum(ref_words) ELSE 0 END, 9)"
CER = "round(CASE WHEN sum(ref_chars) > 0 THEN sum(char_edits)::double / sum(ref_chars) ELSE 0 END, 9)"


def r9(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("wer", v.sql(f"SELECT sum(word_edits)::bigint AS edits, sum(ref_words)::bigint AS total, {WER} AS wer FROM edits", "edits"))
def wer(spark, folder):
    return r9(metrics.wer(v.pairs(spark, folder)), "wer")


@query("cer", v.sql(f"SELECT sum(char_edits)::bigint AS edits, sum(ref_chars)::bigint AS total, {CER} AS cer FROM edits", "edits"))
def cer(spark, folder):
    return r9(metrics.cer(v.pairs(spark, folder)), "cer")


_GAPS = """, gaps AS (SELECT CASE WHEN row_index % 13 = 2 THEN NULL ELSE ref END AS ref, CASE WHEN row_index % 7 = 3 THEN NULL ELSE hyp END AS hyp FROM pairs),
  g AS (SELECT coalesce(ref, '') AS ref, coalesce(hyp, '') AS hyp FROM gaps),
  w AS (SELECT *, {rw} AS rw, {hw} AS hw FROM g), d AS (SELECT *, list_distinct(list_concat(rw, hw)) AS wd FROM w)
SELECT sum({distance})::bigint AS edits, sum(len(rw))::bigint AS total,
  round(CASE WHEN sum(len(rw)) > 0 THEN sum({distance})::double / sum(len(rw)) ELSE 0 END, 9) AS wer FROM d""".format(
    rw=v.sql_words("ref"), hw=v.sql_words("hyp"), distance=_distance("rw", "hw", "wd")
)


@query("wer_with_gaps", v.sql(_GAPS, "pairs"))
def wer_with_gaps(spark, folder):
    """Pairs in which some references and hypotheses are missing."""
    pairs = v.pairs(spark, folder)
    gaps = pairs.select(
        F.when(F.col("row_index") % 13 != 2, F.col("ref")).alias("ref"), F.when(F.col("row_index") % 7 != 3, F.col("hyp")).alias("hyp")
    )
    return r9(metrics.wer(gaps), "wer")


def _bucket_sql() -> str:
    parts = []
    for b in metrics.BUCKETS:
        f = f"FILTER (bucket = '{b}')"
        parts.append(
            f"count(*) {f} AS samples_{b}, round(sum(word_edits) {f}::double / sum(ref_words) {f}, 9) AS wer_{b}, "
            f"round(sum(char_edits) {f}::double / sum(ref_chars) {f}, 9) AS cer_{b}"
        )
    return "SELECT " + ", ".join(parts) + " FROM edits"


@query("wer_by_bucket", v.sql(_bucket_sql(), "edits"))
def wer_by_bucket(spark, folder):
    names = [f"{m}_{b}" for b in metrics.BUCKETS for m in ("wer", "cer")]
    return r9(metrics.bucket_metrics(metrics.with_edits(v.pairs(spark, folder))), *names)


@query("speaker_metrics", v.sql(f"SELECT speaker_id, count(*) AS samples, {WER} AS wer, {CER} AS cer FROM edits WHERE speaker_id IS NOT NULL GROUP BY speaker_id", "edits"))
def speaker_metrics(spark, folder):
    return r9(metrics.speaker_metrics(metrics.with_edits(v.pairs(spark, folder))), "wer", "cer")


@query(
    "speaker_summary",
    v.sql(
        """SELECT count(*) FILTER (speaker_id IS NOT NULL) AS speaker_count,
        round(avg(wer) FILTER (speaker_id IS NOT NULL), 9) AS speaker_macro_wer,
        coalesce(sum(n) FILTER (speaker_id IS NULL), 0) = 0 AS speaker_id_available,
        coalesce(sum(n) FILTER (speaker_id IS NULL), 0)::bigint AS missing_speaker_id_samples
        FROM (SELECT speaker_id, count(*) AS n, sum(word_edits)::double / sum(ref_words) AS wer FROM edits GROUP BY speaker_id)""",
        "edits",
    ),
)
def speaker_summary(spark, folder):
    return r9(metrics.speaker_summary(metrics.with_edits(v.pairs(spark, folder))), "speaker_macro_wer")


@query(
    "eval_rollup",
    v.sql(
        f"""SELECT CASE WHEN GROUPING(bucket) = 1 AND GROUPING(speaker_id) = 1 THEN 'overall'
             WHEN GROUPING(speaker_id) = 1 THEN 'bucket' ELSE 'speaker' END AS scope,
        bucket, speaker_id, count(*) AS samples, {WER} AS wer, {CER} AS cer
        FROM edits GROUP BY GROUPING SETS ((), (bucket), (speaker_id))""",
        "edits",
    ),
)
def eval_rollup(spark, folder):
    return r9(metrics.eval_rollup(metrics.with_edits(v.pairs(spark, folder))), "wer", "cer")


@query(
    "decode_debug",
    v.sql(
        f"""SELECT round(avg(CASE WHEN regexp_matches(hyp, '[^\\s\\pZ]') THEN 0.0 ELSE 1.0 END), 9) AS decoded_empty_fraction,
        round(avg(length(hyp)), 9) AS decoded_avg_char_length, round(avg(len({v.sql_words('hyp')})), 9) AS decoded_avg_word_length
        FROM pairs""",
        "pairs",
    ),
)
def decode_debug(spark, folder):
    out = metrics.decode_debug(v.pairs(spark, folder))
    return r9(out, *out.columns)


@query("bucket_name", v.sql("SELECT utterance_id, bucket FROM edits", "edits"))
def bucket_name(spark, folder):
    return v.pairs(spark, folder).select("utterance_id", text.bucket_name(F.col("ref")).alias("bucket"))


@query(
    "join_ref_hyp",
    v.sql(
        """SELECT CASE WHEN r.utterance_id IS NULL THEN 'hyp_only' WHEN h.utterance_id IS NULL THEN 'ref_only' ELSE 'paired' END AS state,
        count(*) AS n FROM (SELECT utterance_id FROM judged WHERE reject_reason IS NULL) r
        FULL JOIN (SELECT utterance_id FROM judged WHERE split = 'train') h ON r.utterance_id = h.utterance_id GROUP BY ALL""",
        "judged",
    ),
)
def join_ref_hyp(spark, folder):
    judged = v.judged(spark, folder)
    refs = judged.filter(F.col("reject_reason").isNull()).select("utterance_id", F.col("transcript").alias("ref"))
    hyps = judged.filter(F.col("split") == "train").select("utterance_id", F.col("transcript").alias("hyp"))
    return metrics.pair_ref_hyp(refs, hyps, strict=False).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "merge_shards",
    v.sql(
        """SELECT round(sum(loss) / greatest(1, sum(n)), 9) AS loss, round(sum(aux) / greatest(1, sum(n)), 9) AS aux,
        sum(n)::bigint AS samples FROM (SELECT metric, count(*) AS n, sum(value) AS loss, sum(value * 0.5::double) AS aux FROM step_metrics GROUP BY metric)""",
        "step_metrics",
    ),
)
def merge_shards(spark, folder):
    shards = v.step_metrics(spark, folder).groupBy("metric").agg(
        F.count("*").alias("n"), F.sum("value").alias("loss"), F.sum(F.col("value") * 0.5).alias("aux")
    )
    out = metrics.merge_partials(shards, ["loss", "aux"], "n")
    return out.withColumns({c: F.round(c, 9) for c in ("loss", "aux")})


@query(
    "reduce_metrics",
    v.sql(
        """SELECT metric, round(avg(value), 9) AS mean, round(sum(value), 4) AS total,
        round(sum(value * (run + 1)) / sum(run + 1), 9) AS weighted_mean, min(value) AS low, max(value) AS high
        FROM step_metrics GROUP BY metric""",
        "step_metrics",
    ),
)
def reduce_metrics(spark, folder):
    steps = v.step_metrics(spark, folder).withColumn("weight", (F.col("run") + 1).cast("double"))
    out = metrics.reduce_metrics(steps, ["metric"], "value", "weight")
    return out.withColumns(
        {"mean": F.round("mean", 9), "total": F.round("total", 4), "weighted_mean": F.round("weighted_mean", 9)}
    )


@query(
    "best_so_far",
    v.sql(
        """SELECT run, step, value, min(value) OVER w AS best,
        coalesce(value < min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
        FROM step_metrics WINDOW w AS (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)""",
        "step_metrics",
    ),
)
def best_so_far(spark, folder):
    steps = v.step_metrics(spark, folder).select("run", "step", "value")
    return ranking.best_so_far(steps, "run", "step", "value")


@query(
    "flatten_metrics",
    v.sql(
        """, m AS (SELECT metric, round(avg(value), 9) AS mean, min(value) AS low, max(value) AS high FROM step_metrics GROUP BY metric)
        SELECT metric || '/' || name AS name, value FROM (UNPIVOT m ON mean, low, high INTO NAME name VALUE value)""",
        "step_metrics",
    ),
)
def flatten_metrics(spark, folder):
    rows = v.step_metrics(spark, folder).groupBy("metric").agg(
        F.round(F.avg("value"), 9).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    ).withColumnRenamed("metric", "grp")
    return metrics.flatten_metrics(rows, "grp", ["mean", "low", "high"])


@query(
    "blank_starvation",
    v.sql(
        """, s AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY step) AS step,
             value, CASE WHEN metric = 'click' THEN 0.0 ELSE 1.0 END AS share FROM step_metrics)
        SELECT run, min(step) AS first_step FROM s
        WHERE step BETWEEN 1 AND 500 AND share <= 0.001 AND value > 0 AND 1.5::double <= 0.5::double * value GROUP BY run""",
        "step_metrics",
    ),
)
def blank_starvation(spark, folder):
    from uttera.operators.sequence import rank_in_group

    steps = rank_in_group(v.step_metrics(spark, folder), ["run"], "step", "n")
    share = F.when(F.col("metric") == "click", 0.0).otherwise(1.0)
    rule = metrics.starvation_rule(F.col("n"), F.lit(1.5), share, F.col("value"))
    return metrics.first_alert(steps, "run", "n", rule)


_HARD = "ORDER BY ref = hyp, abs(length(ref) - length(hyp)), utterance_id LIMIT 25"


@query("hardest_examples", v.sql(f"SELECT utterance_id, ref, hyp FROM pairs {_HARD}", "pairs"))
def hardest_examples(spark, folder):
    return ranking.hardest(v.pairs(spark, folder), 25).select("utterance_id", "ref", "hyp")


_RANDOM = "ORDER BY sha256('13:' || utterance_id), utterance_id LIMIT 25"


@query("random_examples", v.sql(f"SELECT utterance_id, ref, hyp FROM pairs {_RANDOM}", "pairs"))
def random_examples(spark, folder):
    return ranking.sample_k(v.pairs(spark, folder), 25, 13).select("utterance_id", "ref", "hyp")


@query(
    "examples_table",
    v.sql(
        """, both_kinds AS (
        (SELECT 'hardest' AS category, *, row_number() OVER (ORDER BY ref = hyp, abs(length(ref) - length(hyp)), utterance_id) AS rank FROM pairs)
        UNION ALL
        (SELECT 'random' AS category, *, row_number() OVER (ORDER BY sha256('13:' || utterance_id), utterance_id) AS rank FROM pairs))
        SELECT 'validation' AS split, category, 3 AS epoch, 1200 AS step, rank::int AS rank, utterance_id,
        coalesce(speaker_id, '') AS speaker_id, ref AS reference, hyp AS hypothesis FROM both_kinds WHERE rank <= 10""",
        "pairs",
    ),
)
def examples_table(spark, folder):
    return ranking.examples_table(v.pairs(spark, folder), 10, 13, "validation", 3, 1200)


v.VIEWS["runs"] = (
    ("step_metrics",),
    """SELECT run % 7 AS signature, metric AS path, count(*) AS step, run AS epoch, round(avg(value), 9) AS wer,
       CASE WHEN count(*) > 12 THEN 'ok' END AS marker FROM step_metrics GROUP BY run, metric""",
)


def runs(spark, folder):
    return v.step_metrics(spark, folder).groupBy("run", "metric").agg(
        F.count("*").alias("step"), F.round(F.avg("value"), 9).alias("wer")
    ).select(
        (F.col("run") % 7).alias("signature"), F.col("metric").alias("path"), "step",
        F.col("run").alias("epoch"), "wer", F.when(F.col("step") > 12, "ok").alias("marker"),
    )


@query(
    "topk_runs",
    v.sql(
        """SELECT signature, path, step, epoch, wer, rank::int AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY wer, step, epoch, path) AS rank FROM runs) WHERE rank <= 3""",
        "runs",
    ),
)
def topk_runs(spark, folder):
    return ranking.topk_runs(runs(spark, folder).drop("marker"), 3)


@query(
    "latest_artifact",
    v.sql(
        """SELECT signature, path, step FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY step DESC, path DESC) AS n
        FROM runs WHERE marker IS NOT NULL) WHERE n = 1""",
        "runs",
    ),
)
def latest_artifact(spark, folder):
    return ranking.latest_artifact(runs(spark, folder), ["marker", "wer"], ["signature"])


@query("limit_selected", v.sql("SELECT row_index, utterance_id FROM records ORDER BY row_index LIMIT 500", "records"))
def limit_selected(spark, folder):
    picked = v.records(spark, folder).withColumn("source_ord", F.lit(0))
    return ranking.limit_selected(picked, 500).select("row_index", "utterance_id")


@query(
    "epoch_shuffle",
    v.sql("SELECT utterance_id, row_number() OVER (ORDER BY sha256('15:' || utterance_id)) - 1 AS pos FROM records", "records"),
)
def epoch_shuffle(spark, folder):
    return ranking.epoch_shuffle(v.records(spark, folder).select("utterance_id"), 13, 2)
