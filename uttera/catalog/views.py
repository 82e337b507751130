"""Inputs of the registered queries, derived from the given tables.

Each view exists twice: as a DataFrame and as SQL text. ``sql(body, views...)`` puts the
needed views in front of a query as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttera.config import FilterConfig, SplitConfig
from uttera.functions import hashing, text
from uttera.operators import quality, splits

# The alignment bounds of the checked fixture: 2 to 20 characters per second.
CFG = FilterConfig(min_chars_per_second=2.0, max_chars_per_second=20.0)
SPLIT = SplitConfig(seed=13, validation=0.1, test=0.1)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        order.append(name)

    for name in views:
        visit(name)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    if body.lower().startswith(", "):
        return f"{head}{ctes}{body}"
    return f"{head}{ctes}\n{body}" if order else body


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. It is one small file with one row group, which a single task would read; its rows are dealt out
    here, outside the library, so that the operators under test start from many partitions."""
    return spark.read.parquet(f"{folder}/{name}.parquet").repartition(spark.sparkContext.defaultParallelism)


# --- SQL twins of the text functions -------------------------------------------------

WS = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sql_normalize(c: str, lowercase: bool = True) -> str:
    inner = sql_strip(c)
    if lowercase:
        inner = f"lower({inner})"
    inner = f"translate({inner}, '’`ʼ“”«»', '''''''\"\"\"\"')"
    inner = f"regexp_replace({inner}, '{WS}+', ' ', 'g')"
    return rf"regexp_replace({inner}, ' ([,.;:!?])', '\1', 'g')"


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def sql_char_count(c: str) -> str:
    return f"length(regexp_replace({c}, '{WS}+', '', 'g'))"


def sql_symbol_ratio(c: str) -> str:
    noisy = rf"length(regexp_replace({c}, '[\pL\pN\s\pZ\x0b\x1c-\x1f\x{{85}}''\-]', '', 'g'))"
    return f"CASE WHEN length({c}) = 0 THEN 1.0 ELSE {noisy}::double / length({c}) END"


def sql_unit_hash(key: str, seed: int) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {key}), 1, 16))::UBIGINT::double / 18446744073709551616.0)"


# --- manifest: one row per line of every document ------------------------------------

VIEWS["manifest"] = (
    (),
    """
SELECT doc_id*10000+pos AS row_index, cast(doc_id AS varchar)||'-'||cast(pos AS varchar) AS id,
       line AS sentence, source,
       CASE WHEN doc_id%10=0 THEN NULL ELSE source END AS client_id,
       CASE WHEN doc_id%23=0 THEN NULL
            ELSE 'clips/'||cast(doc_id AS varchar)||'-'||cast(pos AS varchar)||'.wav' END AS path,
       CASE WHEN doc_id%17=0 THEN NULL WHEN doc_id%13=0 THEN length(line)/60.0::double
            WHEN doc_id%11=0 THEN length(line)/2.0::double ELSE length(line)/15.0::double END AS duration
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
""",
)


# Views that are read from files instead of derived, by folder and name; see hold().
HELD: dict[tuple[str, str], str] = {}


def hold(spark: SparkSession, folder: str, path: str) -> None:
    """Writes the manifest and the usable records of a folder once; later calls read them. For benches, whose times
    would otherwise hold the making of these views over and over."""
    for name, view in (("manifest", manifest), ("records", records)):
        view(spark, folder).write.parquet(f"{path}/{name}")
        HELD[folder, name] = f"{path}/{name}"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    if held := HELD.get((folder, "manifest")):
        return spark.read.parquet(held)
    return manifest_of(table(spark, folder, "documents"))


def manifest_of(documents: DataFrame) -> DataFrame:
    """One manifest row per line; ids, missing fields and durations come from the document id."""
    lines = documents.select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    doc, pos, chars = F.col("doc_id"), F.col("pos"), F.length("line")
    name = F.concat(doc.cast("string"), F.lit("-"), pos.cast("string"))
    return lines.select(
        (doc * 10000 + pos).alias("row_index"),
        name.alias("id"),
        F.col("line").alias("sentence"),
        "source",
        F.when(doc % 10 != 0, F.col("source")).alias("client_id"),
        F.when(doc % 23 != 0, F.concat(F.lit("clips/"), name, F.lit(".wav"))).alias("path"),
        F.when(doc % 17 == 0, F.lit(None).cast("double"))
        .when(doc % 13 == 0, chars / 60.0)
        .when(doc % 11 == 0, chars / 2.0)
        .otherwise(chars / 15.0)
        .alias("duration"),
    )


# --- judged: manifest rows as records with a rejection reason and a split ------------

VIEWS["picked"] = (
    ("manifest",),
    f"""
SELECT row_index, source, path AS audio_path, duration, id AS utterance_id,
       client_id AS speaker_id, client_id IS NOT NULL AS has_speaker_id,
       {sql_normalize('sentence')} AS transcript,
       regexp_matches(sentence, '[^\\s\\pZ\\x0b\\x1c-\\x1f\\x{{85}}]') AS has_text
FROM manifest
""",
)

VIEWS["judged"] = (
    ("picked",),
    f"""
SELECT *, CASE WHEN u < 1.0::double - 0.1::double - 0.1::double THEN 'train'
               WHEN u < (1.0::double - 0.1::double - 0.1::double) + 0.1::double THEN 'validation'
               ELSE 'test' END AS split
FROM (
SELECT *, greatest(1, round_even(duration * 16000, 0))::bigint AS num_samples, 16000 AS sample_rate,
  (greatest(greatest(1, round_even(duration * 16000, 0))::bigint, 400) // 160 + 1)::bigint AS estimated_frames,
  {sql_unit_hash('coalesce(speaker_id, utterance_id)', 13)} AS u,
  CASE WHEN NOT has_text THEN 'missing_transcript'
       WHEN audio_path IS NULL THEN 'missing_audio'
       WHEN duration IS NULL OR duration = 0 THEN 'missing_duration'
       WHEN duration < 0.01 THEN 'audio_too_short'
       WHEN duration > 30 THEN 'audio_too_long'
       WHEN length(transcript) < 1 THEN 'too_short'
       WHEN length(transcript) > 400 THEN 'too_long'
       WHEN {sql_symbol_ratio('transcript')} > 0.5 THEN 'symbol_ratio'
       WHEN NOT regexp_matches(transcript, '[\\pL\\pN]') THEN 'no_alnum'
       WHEN {sql_char_count('transcript')} / duration < 2.0::double THEN 'chars_per_second_too_low'
       WHEN {sql_char_count('transcript')} / duration > 20.0::double THEN 'chars_per_second_too_high'
  END AS reject_reason
FROM picked)
""",
)


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_split(quality.with_rejection(manifest(spark, folder), CFG), SPLIT)


VIEWS["records"] = (("judged",), "SELECT * FROM judged WHERE reject_reason IS NULL")


def records(spark: SparkSession, folder: str) -> DataFrame:
    if held := HELD.get((folder, "records")):
        return spark.read.parquet(held)
    return quality.usable(judged(spark, folder))


# --- pairs: references with a damaged copy as hypothesis ------------------------------

VIEWS["pairs"] = (
    ("records",),
    """SELECT row_index, utterance_id, speaker_id, has_speaker_id, source, split, transcript AS ref,
       replace(replace(transcript, ' the ', ' '), 'an', 'on') AS hyp FROM records""",
)


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    ref = F.col("transcript")
    hyp = F.replace(F.replace(ref, F.lit(" the "), F.lit(" ")), F.lit("an"), F.lit("on"))
    return records(spark, folder).select(
        "row_index", "utterance_id", "speaker_id", "has_speaker_id", "source", "split",
        ref.alias("ref"), hyp.alias("hyp"),
    )


# --- frames: embeddings read as posteriors of 25-frame utterances ---------------------

VIEWS["frames"] = (
    (),
    """SELECT (vec_id // 25)::bigint AS utterance_id, (vec_id % 25)::bigint AS frame,
       list_transform(embedding, lambda x: x::double) AS logits, label AS target FROM embeddings""",
)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        F.floor(vec / 25).cast("bigint").alias("utterance_id"),
        (vec % 25).alias("frame"),
        F.col("embedding").cast("array<double>").alias("logits"),
        F.col("label").alias("target"),
    )


VIEWS["labelled"] = (
    ("frames",),
    "SELECT utterance_id, frame, logits, target, (list_position(logits, list_max(logits)) - 1) % 8 AS label "
    "FROM frames",
)

VIEWS["tokens"] = (
    ("frames",),
    "SELECT utterance_id, list(target ORDER BY frame) AS ids, count(*)::bigint AS n FROM frames GROUP BY utterance_id",
)


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids per utterance; 25 frames each, so the collected array is bounded by the view."""
    return (
        frames(spark, folder)
        .groupBy("utterance_id")
        .agg(F.array_sort(F.collect_list(F.struct("frame", "target"))).alias("xs"))
        .select("utterance_id", F.col("xs.target").alias("ids"), F.size("xs").cast("bigint").alias("n"))
    )


# --- cache log and step metrics out of the event stream -------------------------------

VIEWS["cache_log"] = (
    (),
    """SELECT sha256(user_id::varchar) AS key, user_id, event_id AS version,
       event_type = 'error' AS deleted, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value
       FROM events""",
)


def cache_log(spark: SparkSession, folder: str) -> DataFrame:
    gone = F.col("event_type") == "error"
    return table(spark, folder, "events").select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("key"),
        "user_id",
        F.col("event_id").alias("version"),
        gone.alias("deleted"),
        F.when(~gone, F.col("value")).alias("value"),
    )


VIEWS["step_metrics"] = (
    (),
    "SELECT user_id AS run, event_id AS step, event_type AS metric, value, ts FROM events",
)


def step_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("metric"),
        "value",
        F.col("ts").cast("timestamp").alias("ts"),
    )


# --- corpus lines ---------------------------------------------------------------------

VIEWS["corpus"] = (
    ("picked",),
    f"SELECT row_index, {sql_strip('sentence')} AS text, transcript FROM "
    "(SELECT m.sentence, p.* FROM manifest m JOIN picked p ON m.row_index = p.row_index) WHERE has_text",
)


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Stripped, non-blank lines of all documents, whole."""
    raw = F.col("sentence")
    return manifest(spark, folder).filter(~text.is_blank(raw)).select(
        "row_index", text.strip_ws(raw).alias("text"), text.normalize_transcript(raw).alias("transcript")
    )


def hash_order(column: str, seed: int | str):
    return hashing.order_hash(F.col(column), seed)
