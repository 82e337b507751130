"""Frame-level diagnostics, segments, pooling and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttera.catalog import views as v
from uttera.catalog.base import query
from uttera.functions import arrays
from uttera.operators import ctc, ngram, vectors
from uttera.operators.common import computed_once

_LSE = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))))"
v.VIEWS["probs"] = (
    ("frames",),
    "SELECT *, list_transform(logits, lambda x: x - lse) AS lp FROM (SELECT *, top + ln(list_sum(list_transform(logits, lambda x: exp(x - top)))) AS lse "
    "FROM (SELECT *, list_max(logits) AS top FROM frames))",
)


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def labelled(spark, folder):
    """Argmax folded to eight labels, so that stretches of equal labels occur."""
    frames = v.frames(spark, folder)
    return frames.withColumn("label", arrays.argmax(F.col("logits")) % 8)


@query(
    "valid_frames",
    v.sql(
        """, l AS (SELECT utterance_id, (utterance_id * 7 % 25)::bigint AS length FROM (SELECT DISTINCT utterance_id FROM frames))
        SELECT utterance_id, frame, target FROM frames JOIN l USING (utterance_id) WHERE frame < length""",
        "frames",
    ),
)
def valid_frames(spark, folder):
    frames = v.frames(spark, folder)
    lengths = frames.select("utterance_id").distinct().withColumn("length", F.col("utterance_id") * 7 % 25)
    return ctc.valid_frames(frames, lengths).select("utterance_id", "frame", "target")


@query(
    "ctc_frame_stats",
    v.sql(
        """, s AS (SELECT sum(exp(lp[1])) AS b, count(*) AS n, count(*) FILTER (list_position(lp, list_max(lp)) = 1) AS a,
             sum(exp(list_max(lp[2:]))) AS t FROM probs)
        SELECT round(b, 6) AS blank_probability_sum, n AS decoded_frames, a AS argmax_blank_frames,
          round(t, 6) AS top_nonblank_probability_sum, round(b / n, 9) AS avg_blank_probability,
          round(a / n, 9) AS argmax_blank_fraction, round(t / n, 9) AS avg_top_nonblank_probability FROM s""",
        "probs",
    ),
)
def ctc_frame_stats(spark, folder):
    out = ctc.ctc_stats(ctc.log_softmax(v.frames(spark, folder)))
    out = rounded(out, 6, "blank_probability_sum", "top_nonblank_probability_sum")
    return rounded(out, 9, "avg_blank_probability", "argmax_blank_fraction", "avg_top_nonblank_probability")


_NEED = "(len(ids) + len(list_filter(range(1, len(ids)), lambda i: ids[i] = ids[i + 1])))"


@query(
    "ctc_feasibility",
    v.sql(f"SELECT utterance_id, {_NEED}::int AS min_frames, n < {_NEED} AS impossible, n <= {_NEED} AS tight FROM tokens", "tokens"),
)
def ctc_feasibility(spark, folder):
    return ctc.ctc_feasible(v.tokens(spark, folder)).select("utterance_id", "min_frames", "impossible", "tight")


@query(
    "ctc_length_summary",
    v.sql(
        f"""SELECT count(*) AS sample_count, round(avg(n), 9) AS avg_output_frames, round(avg(len(ids)), 9) AS avg_target_tokens,
        round(sum(len(ids)) / sum(n), 9) AS target_tokens_per_frame,
        round(avg((n < {_NEED})::int), 9) AS impossible_sample_fraction, round(avg((n <= {_NEED})::int), 9) AS tight_sample_fraction FROM tokens""",
        "tokens",
    ),
)
def ctc_length_summary(spark, folder):
    out = ctc.ctc_length_summary(v.tokens(spark, folder))
    return rounded(out, 9, *[c for c in out.columns if c != "sample_count"])


@query(
    "logit_stats",
    v.sql(
        """SELECT count(*) AS decoded_frames, round(avg(logits[1]), 9) AS avg_blank_logit, round(avg(top), 9) AS avg_top_logit,
        round(avg(top - list_reverse_sort(logits)[2]), 9) AS avg_top2_margin,
        round(avg(logits[1] - list_max(logits[2:])), 9) AS avg_blank_nonblank_margin,
        round(avg(-list_sum(list_transform(lp, lambda x: exp(x) * x))), 9) AS avg_entropy FROM probs""",
        "probs",
    ),
)
def logit_stats(spark, folder):
    out = ctc.logit_stats(v.frames(spark, folder))
    return rounded(out, 9, *[c for c in out.columns if c != "decoded_frames"])


@query(
    "encoder_stats",
    v.sql(
        """SELECT round(sum(s) / sum(n), 9) AS avg_mean, round(sqrt(greatest(sum(q) / sum(n) - (sum(s) / sum(n)) ** 2, 0)), 9) AS avg_std,
        round(avg(sqrt(q)), 9) AS avg_token_l2_norm FROM (SELECT list_sum(logits) AS s, list_dot_product(logits, logits) AS q, len(logits) AS n FROM frames)""",
        "frames",
    ),
)
def encoder_stats(spark, folder):
    out = ctc.encoder_stats(v.frames(spark, folder))
    return rounded(out, 9, *out.columns)


@query(
    "token_histogram",
    v.sql(
        """SELECT token_id, round(n / sum(n) OVER (), 9) AS share FROM
        (SELECT (list_position(logits, list_max(logits)) - 1)::int AS token_id, count(*) AS n FROM frames GROUP BY ALL)
        ORDER BY share DESC, token_id LIMIT 5""",
        "frames",
    ),
)
def token_histogram(spark, folder):
    return rounded(ctc.token_histogram(v.frames(spark, folder), 5), 9, "share")


_TOKENS = """SELECT utterance_id, frame, label::int AS label FROM (
   SELECT *, lag(label) OVER (PARTITION BY utterance_id ORDER BY frame) AS prev FROM labelled)
   WHERE (prev IS NULL OR prev <> label) AND label <> 0"""


@query("ctc_tokens", v.sql(_TOKENS, "labelled"))
def ctc_tokens(spark, folder):
    return ctc.ctc_tokens(labelled(spark, folder))


@query(
    "ctc_collapse",
    v.sql(
        f""", e AS ({_TOKENS}) SELECT u.utterance_id, coalesce(string_agg(chr(96 + label), '' ORDER BY frame), '') AS hyp
        FROM (SELECT DISTINCT utterance_id FROM frames) u LEFT JOIN e USING (utterance_id) GROUP BY u.utterance_id""",
        "labelled",
    ),
)
def ctc_collapse(spark, folder):
    labels = labelled(spark, folder)
    vocab = labels.select("label").distinct().select(
        F.col("label").alias("id"), F.char(F.col("label") + 96).alias("token")
    )
    return ctc.ctc_greedy(labels, vocab)


v.VIEWS["segments"] = (
    ("labelled",),
    """SELECT utterance_id, min(frame) AS "start", max(frame) + 1 AS "end", any_value(label)::int AS label, run,
        list(logits ORDER BY frame) AS vs FROM (
        SELECT *, sum(new) OVER (PARTITION BY utterance_id ORDER BY frame) AS run FROM (
        SELECT *, CASE WHEN lag(label) OVER (PARTITION BY utterance_id ORDER BY frame) IS DISTINCT FROM label THEN 1 ELSE 0 END AS new FROM labelled))
        GROUP BY utterance_id, run HAVING any_value(label) <> 0""",
)


@query("ctc_segments", v.sql('SELECT utterance_id, "start", "end", label FROM segments', "segments"))
def ctc_segments(spark, folder):
    return ctc.ctc_segments(labelled(spark, folder))


def _rounded_array(column, digits=6):
    return F.transform(column, lambda x: F.round(x, digits) + 0.0)


@query(
    "compress_posteriors",
    v.sql(
        """SELECT utterance_id, "start", list_transform(range(1, 65), lambda d: round(list_avg(list_transform(vs, lambda w: w[d])), 6) + 0.0) AS vector FROM segments""",
        "segments",
    ),
)
def compress_posteriors(spark, folder):
    out = ctc.compress_segments(labelled(spark, folder), 64)
    return out.withColumn("vector", _rounded_array("vector"))


# Posteriors of two heads: softmax of the logits and of the doubled logits. The boundary
# probability is that of the blank in the first head.
def two_heads(spark, folder):
    x = F.col("logits")
    once = computed_once(
        labelled(spark, folder),
        l1=arrays.log_sum_exp(x),
        l2=arrays.log_sum_exp(F.transform(x, lambda e: e * 2)),
    )
    once = once.withColumn("shallow", F.transform("logits", lambda e: F.exp(e - F.col("l1"))))
    once = once.withColumn("final", F.transform("logits", lambda e: F.exp(e * 2 - F.col("l2"))))
    return once.withColumn("boundary", F.element_at("shallow", 1)).select(
        "utterance_id", "frame", "label", "shallow", "final", "boundary"
    )


_GATED = """, h AS (SELECT utterance_id, frame, label, list_transform(logits, lambda x: exp(x - l1)) AS shallow,
    list_transform(logits, lambda x: exp(2 * x - l2)) AS final FROM (
    SELECT *, ln(list_sum(list_transform(logits, lambda x: exp(x)))) AS l1, ln(list_sum(list_transform(logits, lambda x: exp(2 * x)))) AS l2 FROM labelled)),
  g AS (SELECT *, shallow[1] AS boundary, shallow[label + 1] AS s, 0.5::double * (shallow[label + 1] + final[label + 1]) AS c,
    lag(shallow[1]) OVER w AS lb, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS new
    FROM h WINDOW w AS (PARTITION BY utterance_id ORDER BY frame)),
  r AS (SELECT *, 1 / (1 + exp(-12.0::double * (c - 0.1))) + 0.05 AS gate, sum(new) OVER (PARTITION BY utterance_id ORDER BY frame) AS run FROM g),
  sg AS (SELECT utterance_id, run, min(frame) AS "start", list(struct_pack(a := shallow, b := final, g := gate) ORDER BY frame) AS xs, avg(c) AS c, avg(s) AS s,
    first(lb ORDER BY frame) AS lb, last(boundary ORDER BY frame) AS rb FROM r WHERE label <> 0 GROUP BY utterance_id, run),
  p AS (SELECT *, CASE WHEN "start" = min("start") OVER (PARTITION BY utterance_id) THEN 1.0 ELSE lb END AS l FROM sg),
  f AS (SELECT utterance_id, "start", list_concat(
     list_transform(range(1, 65), lambda d: list_sum(list_transform(xs, lambda x: x.a[d] * x.g)) / list_sum(list_transform(xs, lambda x: x.g))),
     list_transform(range(1, 65), lambda d: list_sum(list_transform(xs, lambda x: x.b[d] * x.g)) / list_sum(list_transform(xs, lambda x: x.g))),
     [c, s, l, rb]) AS v, 1 + 0.25 * (1 - l) + 0.25 * (1 - rb) AS k, greatest(0.05, least(1.0, c)) AS confidence FROM p)
SELECT utterance_id, "start", list_transform(v, lambda x: round(x * k, 6)) AS feature, round(confidence, 6) AS confidence FROM f"""


@query("gated_pooling", v.sql(_GATED, "labelled"))
def gated_pooling(spark, folder):
    out = ctc.gated_pooling(two_heads(spark, folder), 0.1, 64)
    return out.withColumn("feature", _rounded_array("feature")).withColumn("confidence", F.round("confidence", 6))


@query(
    "boundary_targets",
    v.sql(
        """SELECT utterance_id, frame, CASE WHEN lead(label) OVER w <> label THEN 1.0::double ELSE 0.0::double END AS boundary
        FROM labelled WINDOW w AS (PARTITION BY utterance_id ORDER BY frame)""",
        "labelled",
    ),
)
def boundary_targets(spark, folder):
    return ctc.boundaries(labelled(spark, folder))


@query(
    "uniform_alignment",
    v.sql(
        """, e AS (SELECT utterance_id, n * 3 AS t, list_concat(flatten(list_transform(ids, lambda x: [0, x])), [0]) AS st FROM tokens)
        SELECT utterance_id, list_transform(range(0, t), lambda i: st[i * len(st) // t + 1]) AS states FROM e""",
        "tokens",
    ),
)
def uniform_alignment(spark, folder):
    return v.tokens(spark, folder).select(
        "utterance_id", arrays.uniform_alignment(F.col("ids"), F.col("n") * 3).alias("states")
    )


@query(
    "frame_stack",
    v.sql(
        """, g AS (SELECT utterance_id, frame // 2 AS slot, flatten(list(logits ORDER BY frame)) AS f FROM frames GROUP BY ALL)
        SELECT utterance_id, slot, list_resize(f, 128, 1.0::double) AS stacked FROM g""",
        "frames",
    ),
)
def frame_stack(spark, folder):
    return ctc.stack_frames(v.frames(spark, folder), 2, pad=1.0)


@query(
    "mean_pool",
    v.sql(
        """, m AS (SELECT utterance_id, list(logits) AS vs FROM frames GROUP BY utterance_id)
        SELECT utterance_id, list_transform(range(1, 65), lambda d: round(list_avg(list_transform(vs, lambda w: w[d])), 6) + 0.0) AS pooled FROM m""",
        "frames",
    ),
)
def mean_pool(spark, folder):
    return ctc.mean_pool(v.frames(spark, folder)).withColumn("pooled", _rounded_array("pooled"))


@query(
    "bos_eos_shift",
    v.sql(
        """SELECT utterance_id, list_concat([1], list_transform(ids, lambda x: x + 3)) AS decoder_in,
        list_concat(list_transform(ids, lambda x: x + 3), [2]) AS decoder_out, len(ids)::int + 1 AS target_length FROM tokens""",
        "tokens",
    ),
)
def bos_eos_shift(spark, folder):
    ids = F.col("ids")
    given, wanted = arrays.shift_targets(ids, 1, 2, 3)
    return v.tokens(spark, folder).select(
        "utterance_id", given.alias("decoder_in"), wanted.alias("decoder_out"), F.size(wanted).alias("target_length")
    )


@query(
    "prune_ranges",
    v.sql(
        """SELECT utterance_id, list_transform(range(0, n * 2), lambda t:
          least(greatest(floor((t + 0.5) * (len(ids) + 1) / (n * 2))::int - 2, 0), greatest(len(ids) + 1 - 5, 0))::int) AS starts FROM tokens""",
        "tokens",
    ),
)
def prune_ranges(spark, folder):
    starts = arrays.prune_starts(F.col("n") * 2, F.size("ids"), F.lit(5))
    return v.tokens(spark, folder).select("utterance_id", starts.alias("starts"))


@query(
    "decode_ctc",
    v.sql(
        """SELECT utterance_id, list_transform(list_filter(range(1, len(ids) + 1), lambda i: ids[i] <> 0 AND (i = 1 OR ids[i - 1] <> ids[i])),
        lambda i: ids[i]) AS kept FROM tokens""",
        "tokens",
    ),
)
def decode_ctc(spark, folder):
    return v.tokens(spark, folder).select("utterance_id", arrays.collapse_ids(F.col("ids")).alias("kept"))


# --- vectors --------------------------------------------------------------------------

_PAIRED = """, t AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS a FROM embeddings),
   b AS (SELECT x.vec_id, x.a, y.a AS b FROM t x JOIN t y ON y.vec_id = x.vec_id + 1),
   d AS (SELECT vec_id, list_cosine_similarity(a, b) AS cosine, list_sum(list_transform(range(1, len(a) + 1), lambda i:
     pow(a[i] / na - b[i] / nb, 2))) / len(a) AS mse FROM (SELECT *, sqrt(list_dot_product(a, a)) AS na, sqrt(list_dot_product(b, b)) AS nb FROM b))"""


def student_teacher(spark, folder):
    vec = F.col("embedding").cast("array<double>").alias("vector")
    table = v.table(spark, folder, "embeddings")
    return table.select("vec_id", vec), table.select((F.col("vec_id") - 1).alias("vec_id"), vec)


@query("join_embeddings", "WITH " + _PAIRED[2:] + " SELECT vec_id, round(cosine, 9) AS cosine, round(mse, 9) AS mse FROM d")
def join_embeddings(spark, folder):
    return rounded(vectors.embedding_agreement(*student_teacher(spark, folder), "vec_id"), 9, "cosine", "mse")


@query("embedding_distance", "WITH " + _PAIRED[2:] + " SELECT round(avg(1 - cosine), 9) AS hidden_cosine, round(avg(mse), 9) AS unit_mse FROM d")
def embedding_distance(spark, folder):
    out = vectors.embedding_distance(*student_teacher(spark, folder), "vec_id")
    return rounded(out, 9, "hidden_cosine", "unit_mse")


_TRIM = "(CASE WHEN vec_id % 9 = 4 THEN 60 ELSE 64 END)::bigint"


@query(
    "average_vectors",
    f"""WITH x AS (SELECT vec_id, label, list_resize(list_transform(embedding, lambda e: e::double), {_TRIM}) AS v FROM embeddings),
    f AS (SELECT label, arg_min(len(v), vec_id) AS size FROM x GROUP BY label),
    k AS (SELECT label, any_value(size) AS size, list(v) AS vs, count(*) AS averaged FROM x JOIN f USING (label) WHERE len(v) = size GROUP BY label)
    SELECT label, averaged, list_transform(range(1, size + 1), lambda d: round(list_avg(list_transform(vs, lambda w: w[d])), 6) + 0.0) AS mean FROM k""",
)
def average_vectors(spark, folder):
    size = F.when(F.col("vec_id") % 9 == 4, 60).otherwise(64)
    table = v.table(spark, folder, "embeddings").select(
        "vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), F.lit(1), size).alias("vector")
    )
    return vectors.average_vectors(table, ["label"], "vec_id").withColumn("mean", _rounded_array("mean"))


def _normalized(variance: str) -> str:
    return f"""WITH x AS (SELECT vec_id, label, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) AS d FROM embeddings),
    s AS (SELECT label, d, avg(e) AS m, {variance} AS sd FROM x GROUP BY label, d)
    SELECT vec_id, label, list(round((e - m) / sd, 5) + 0.0 ORDER BY d) AS vector FROM x JOIN s USING (label, d) GROUP BY vec_id, label"""


def _by_label(spark, folder):
    return v.table(spark, folder, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")
    )


@query("feature_normalize", _normalized("greatest(stddev_pop(e), 1e-5)"))
def feature_normalize(spark, folder):
    out = vectors.normalize_features(_by_label(spark, folder), "label", "vector")
    return out.withColumn("vector", _rounded_array("vector", 5))


@query("feature_normalize_unbiased", _normalized("sqrt(var_samp(e) + 1e-7)"))
def feature_normalize_unbiased(spark, folder):
    out = vectors.normalize_features(_by_label(spark, folder), "label", "vector", variance_epsilon=1e-7)
    return out.withColumn("vector", _rounded_array("vector", 5))


@query(
    "feature_normalize_per_frame",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) AS d FROM embeddings),
    s AS (SELECT vec_id, avg(e) AS m, greatest(stddev_pop(e), 1e-5) AS sd FROM x GROUP BY vec_id)
    SELECT vec_id, label, list(round((e - m) / sd, 6) + 0.0 ORDER BY d) AS vector FROM x JOIN s USING (vec_id) GROUP BY vec_id, label""",
)
def feature_normalize_per_frame(spark, folder):
    out = vectors.normalize_per_frame(_by_label(spark, folder), "vector")
    return out.withColumn("vector", _rounded_array("vector"))


@query(
    "merge_nbest",
    v.sql(
        """, h AS (SELECT utterance_id, target % 3 AS a, target % 2 AS b, -1000.0::double * utterance_id + logits[1] * 200 AS lp FROM frames),
        m AS (SELECT utterance_id, a, b, max(lp) AS top, count(*) AS n, list(lp) AS lps FROM h GROUP BY ALL),
        s AS (SELECT utterance_id, [a, b] AS tokens, top + ln(list_sum(list_transform(lps, lambda x: exp(x - top)))) AS log_prob FROM m)
        SELECT utterance_id, tokens, round(log_prob, 6) AS log_prob, rank::int AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY log_prob DESC, tokens) AS rank FROM s) WHERE rank <= 4""",
        "frames",
    ),
)
def merge_nbest(spark, folder):
    hyps = v.frames(spark, folder).select(
        "utterance_id",
        F.array(F.col("target") % 3, F.col("target") % 2).alias("tokens"),
        (F.col("utterance_id") * -1000.0 + F.element_at("logits", 1) * 200).alias("log_prob"),
    )
    return rounded(ngram.merge_nbest(hyps, 4), 6, "log_prob")


@query(
    "log_add_exp",
    """SELECT vec_id, round(greatest(a, b) + ln(1 + exp(-abs(a - b))), 9) AS lae FROM
    (SELECT vec_id, embedding[1]::double * 50 AS a, embedding[2]::double * 50 AS b FROM embeddings)""",
)
def log_add_exp(spark, folder):
    a, b = (F.element_at("embedding", i).cast("double") * 50 for i in (1, 2))
    return v.table(spark, folder, "embeddings").select("vec_id", F.round(arrays.log_add_exp(a, b), 9).alias("lae"))


def _sql_bands() -> str:
    """Widths and starts of two frequency and five time bands per utterance."""

    def draw(name: str, top: str) -> str:
        tagged = f"utterance_id || ':1:{name}'"
        return f"floor({v.sql_unit_hash(f'({tagged})', 13)} * ({top} + 1))::int"

    widths = [f"{draw(f'fw{i}', '27')} AS fw{i}" for i in range(2)]
    widths += [f"{draw(f'tw{i}', 'greatest(floor(n * 0.05::double), 1)')} AS tw{i}" for i in range(5)]
    starts = [f"{draw(f'fs{i}', f'64 - fw{i}')} AS fs{i}" for i in range(2)]
    starts += [f"{draw(f'ts{i}', f'n - tw{i}')} AS ts{i}" for i in range(5)]
    inner = f"SELECT utterance_id, n, {', '.join(widths)} FROM (SELECT utterance_id, count(*) AS n FROM frames GROUP BY 1)"
    return f"SELECT *, {', '.join(starts)} FROM ({inner})"


_IN_TIME = " OR ".join(f"(tw{i} < n AND frame >= ts{i} AND frame < ts{i} + tw{i})" for i in range(5))
_IN_FREQ = " OR ".join(f"(j - 1 >= fs{i} AND j - 1 < fs{i} + fw{i})" for i in range(2))


@query(
    "spec_augment",
    v.sql(
        f""", b AS ({_sql_bands()})
        SELECT utterance_id, frame, list_transform(logits, lambda x, j: CASE WHEN {_IN_TIME} OR {_IN_FREQ} THEN 0.0::double ELSE x END) AS logits
        FROM frames JOIN b USING (utterance_id)""",
        "frames",
    ),
)
def spec_augment(spark, folder):
    frames = v.frames(spark, folder).drop("target")
    lengths = frames.groupBy("utterance_id").agg(F.count("*").alias("length"))
    return vectors.spec_augment(frames, lengths, "utterance_id", "frame", "logits", 64, seed=13, epoch=1)
