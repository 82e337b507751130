"""Scans, sinks, record tables, feature log and cache joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttera.catalog import views as v
from uttera.catalog.base import query
from uttera.config import FrontendConfig
from uttera.functions import audio, hashing
from uttera.operators import blobs, feature_log, features, ngram, quality, vocab
from uttera.operators.common import computed_once
from uttera.session import scratch_path
from uttera.sources import manifests, records

MANIFEST_COLUMNS = "id, sentence, client_id, path, duration::varchar AS duration"


@query(
    "scan_tsv",
    v.sql("SELECT id, sentence, source, path, row_index::varchar AS row_index FROM manifest", "manifest"),
)
def scan_tsv(spark, folder):
    """Manifest written as TSV and read back, all columns as text."""
    path = scratch_path(spark, "tsv")
    manifests.write_tsv(v.manifest(spark, folder).select("id", "sentence", "source", "path", "row_index"), path)
    return manifests.read_tsv(spark, path)


_MIXED = v.sql(
    "SELECT id, CASE WHEN row_index % 3 <> 1 THEN sentence END AS sentence, source, CASE WHEN row_index % 3 <> 2 THEN path END AS path FROM manifest",
    "manifest",
)


def mixed_manifests(spark, folder):
    """The manifest in three parts of different columns, each in a different order."""
    rows = v.manifest(spark, folder)
    parts = (["id", "sentence", "source", "path"], ["path", "source", "id"], ["source", "sentence", "id", "client_id"])
    return [rows.filter(F.col("row_index") % 3 == i).select(*columns) for i, columns in enumerate(parts)]


@query("scan_mixed_tsv", _MIXED)
def scan_mixed_tsv(spark, folder):
    """Files of three headers in one scan."""
    path = scratch_path(spark, "mixed-tsv")
    for i, part in enumerate(mixed_manifests(spark, folder)):
        manifests.write_tsv(part, f"{path}/{i}")
    return manifests.read_mixed_tsv(spark, path).select("id", "sentence", "source", "path")


@query("scan_parquet", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def scan_parquet(spark, folder):
    rows = manifests.read_parquet(spark, f"{folder}/events.parquet")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    "union_sources",
    """SELECT source_ord, count(*) AS n, count(text) AS texts, count(role) AS roles, count(lang) AS langs FROM (
       SELECT 0 AS source_ord, text, NULL AS role, lang FROM documents UNION ALL
       SELECT 1, text, role, NULL FROM conversations UNION ALL SELECT 2, text, NULL, NULL FROM benchmark) GROUP BY source_ord""",
)
def union_sources(spark, folder):
    names = ["documents", "conversations", "documents", "benchmark"]
    union = manifests.union_sources([v.table(spark, folder, n) for n in names], names)
    return union.groupBy("source_ord").agg(
        F.count("*").alias("n"), F.count("text").alias("texts"), F.count("role").alias("roles"), F.count("lang").alias("langs")
    )


@query("file_row_index", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents")
def file_row_index(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id")
    return manifests.with_row_index(rows)


@query(
    "read_corpus_text",
    v.sql("SELECT text, count(*) AS n FROM corpus GROUP BY text", "corpus"),
)
def read_corpus_text(spark, folder):
    path = scratch_path(spark, "corpus")
    v.table(spark, folder, "documents").select("text").write.text(path)
    return manifests.read_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("corpus_texts", v.sql("SELECT min(row_index) AS row_index, transcript AS text FROM corpus GROUP BY transcript ORDER BY 1 LIMIT 2000", "corpus"))
def corpus_texts(spark, folder):
    return manifests.corpus_texts(v.manifest(spark, folder), dedup=True, n=2000)


@query("dedup_transcripts", v.sql("SELECT min(row_index) AS row_index, transcript FROM corpus GROUP BY transcript", "corpus"))
def dedup_transcripts(spark, folder):
    return manifests.dedup_transcripts(v.corpus(spark, folder), "transcript")


@query("write_records", v.sql("SELECT row_index, utterance_id, transcript, num_samples, estimated_frames, split FROM records", "records"))
def write_records(spark, folder):
    path = scratch_path(spark, "records")
    rows = v.records(spark, folder).select("row_index", "utterance_id", "transcript", "num_samples", "estimated_frames", "split")
    return records.open_or_build(spark, path, lambda: rows).select(*rows.columns)


@query("read_record_jsonl", v.sql("SELECT row_index, utterance_id, transcript, speaker_id, has_speaker_id, num_samples FROM records", "records"))
def read_record_jsonl(spark, folder):
    path = scratch_path(spark, "jsonl")
    names = ["row_index", "utterance_id", "transcript", "speaker_id", "has_speaker_id", "num_samples"]
    v.records(spark, folder).select(*names).write.json(path)
    return records.read_records_json(spark, path).select(*names)


@query(
    "preview_sample",
    v.sql("SELECT (row_number() OVER (ORDER BY row_index) - 1)::int AS index, row_index, utterance_id FROM records QUALIFY index < 20", "records"),
)
def preview_sample(spark, folder):
    rows = v.records(spark, folder).withColumn("source_ord", F.lit(0))
    return records.preview(rows, 20).select("index", "row_index", "utterance_id")


@query(
    "json_write",
    v.sql("""SELECT '{"split":"' || split || '","samples":' || count(*) || ',"speakers":' || count(DISTINCT speaker_id) || '}' AS value FROM records GROUP BY split""", "records"),
)
def json_write(spark, folder):
    from uttera.operators import audit

    path = scratch_path(spark, "report")
    report = audit.split_audit(v.records(spark, folder)).select("split", "samples", "speakers")
    records.write_report(report, path)
    return spark.read.text(path)


@query(
    "write_report",
    v.sql(
        """SELECT '{"source":"' || source || '","scanned":' || count(*) || ',"missing_audio":' || count(*) FILTER (reject_reason = 'missing_audio') || '}' AS value
        FROM judged GROUP BY source""",
        "judged",
    ),
)
def write_report(spark, folder):
    from uttera.operators import audit

    path = scratch_path(spark, "report")
    summary = audit.loader_summary(v.judged(spark, folder))
    records.write_report(summary.select("source", "scanned", F.col("skipped_missing_audio").alias("missing_audio")), path)
    return spark.read.text(path)


@query("json_get", "SELECT event_id, (props->>'k')::bigint AS k FROM events")
def json_get(spark, folder):
    parsed = F.from_json("props", "k bigint")
    return v.table(spark, folder, "events").select("event_id", parsed["k"].alias("k"))


@query("vocab_artifact", v.sql("SELECT '<blank>' AS token, 0 AS id UNION ALL SELECT token, row_number() OVER (ORDER BY token COLLATE \"C\")::int FROM (SELECT DISTINCT unnest(string_split(transcript, '')) AS token FROM corpus)", "corpus"))
def vocab_artifact(spark, folder):
    path = scratch_path(spark, "vocab")
    records.save_vocab(vocab.char_vocab(v.corpus(spark, folder), "transcript"), path)
    return records.load_vocab(spark, path)


@query("lm_artifact", v.sql("SELECT context, total, vocab_size, 3 AS \"order\" FROM lm_totals, lm_size", "lm_totals", "lm_size"))
def lm_artifact(spark, folder):
    path = scratch_path(spark, "lm")
    ngram.save_lm(ngram.train(v.corpus(spark, folder).select("text"), "text", 3, 0.1), path)
    lm = ngram.load_lm(spark, path)
    return lm.totals.withColumn("vocab_size", lm.vocab_size()).withColumn("order", F.lit(lm.order))


@query("blob_store", "SELECT sha256(text) AS name, count(*) AS copies, strlen(any_value(text)) AS size FROM documents GROUP BY 1")
def blob_store(spark, folder):
    docs = v.table(spark, folder, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    return blobs.dedupe_blobs(docs, "data", "doc_id").select("name", "copies", F.octet_length("data").cast("bigint").alias("size"))


@query("new_blobs", "SELECT sha256(text) AS name FROM conversations EXCEPT SELECT sha256(text) FROM conversations WHERE turn = 0")
def new_blobs(spark, folder):
    turns = v.table(spark, folder, "conversations").select(F.struct("conv_id", "turn").alias("at"), "turn", "text")
    stored = blobs.dedupe_blobs(turns.filter(F.col("turn") == 0), "text", "at")
    return blobs.new_blobs(blobs.dedupe_blobs(turns, "text", "at"), stored).select("name")


# --- audio fixtures: WAV bytes made from the embeddings --------------------------------


def _le(value, width: int):
    """Little-endian hex text of a non-negative integer."""
    raw = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(width))])


def wav_clips(spark, folder):
    """One mono 16-bit clip of 1,600 samples per utterance of the frames view.

    Utterance number 3, 13, 23, ... is cut short so that its header cannot be read.
    """
    pcm = F.transform("embedding", lambda x: F.bround(x.cast("double") * 32767).cast("int"))
    hexed = F.array_join(F.transform(pcm, lambda s: _le(F.when(s < 0, s + 65536).otherwise(s), 2)), "")
    parts = v.table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 25).cast("bigint").alias("utterance_id"), (F.col("vec_id") % 25).alias("frame"), hexed.alias("h")
    )
    body = parts.groupBy("utterance_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("frame", "h")))["h"], "").alias("body")
    )
    size = (F.length("body") / 2).cast("bigint")
    # Every fifth clip has a note of odd length before its sound, every sixth a longer format chunk.
    note = F.when(F.col("utterance_id") % 5 == 1, F.lit("4C495354" + "05000000" + "494E464F00" + "00")).otherwise(F.lit(""))
    longer = F.col("utterance_id") % 6 == 2
    whole_size = size + 36 + F.length(note) / 2 + F.when(longer, 2).otherwise(0)
    head = F.concat(
        F.lit("52494646"), _le(whole_size.cast("bigint"), 4), F.lit("57415645666D7420"), F.when(longer, _le(F.lit(18), 4)).otherwise(_le(F.lit(16), 4)),
        _le(F.lit(1), 2), _le(F.lit(1), 2), _le(F.lit(16000), 4), _le(F.lit(32000), 4), _le(F.lit(2), 2), _le(F.lit(16), 2),
        F.when(longer, F.lit("0000")).otherwise(F.lit("")), note, F.lit("64617461"), _le(size, 4),
    )
    whole = F.unhex(F.concat(head, F.col("body")))
    built = computed_once(body, __wav=whole)
    cut = F.when(F.col("utterance_id") % 10 == 3, F.substring("__wav", 1, 30)).otherwise(F.col("__wav"))
    return built.select("utterance_id", cut.alias("audio_bytes"))


_CLIPS = "SELECT (vec_id // 25)::bigint AS utterance_id, count(*) * 64 AS n FROM embeddings GROUP BY 1"


def odd_clips(spark, folder):
    """The clips, every seventh of them in a format whose header is not read."""
    other = F.concat(F.lit("OggS").cast("binary"), F.col("audio_bytes"))
    return wav_clips(spark, folder).withColumn(
        "audio_bytes", F.when(F.col("utterance_id") % 7 == 4, other).otherwise(F.col("audio_bytes"))
    )


@query(
    "probe_audio",
    f"""SELECT utterance_id, CASE WHEN status = 'pcm' THEN n ELSE 0 END AS num_samples,
        CASE WHEN status = 'pcm' THEN 16000 ELSE 0 END::bigint AS sample_rate, status
        FROM (SELECT *, CASE WHEN utterance_id % 7 = 4 THEN 'unknown' WHEN utterance_id % 10 = 3 THEN 'broken' ELSE 'pcm' END AS status FROM ({_CLIPS}))""",
)
def probe_audio(spark, folder):
    from uttera.operators import signal

    return signal.probe_audio(odd_clips(spark, folder)).select("utterance_id", "num_samples", "sample_rate", "status")


@query("prevalidate_audio", f"SELECT utterance_id FROM ({_CLIPS}) WHERE utterance_id % 7 = 4 OR utterance_id % 10 <> 3")
def prevalidate_audio(spark, folder):
    from uttera.operators import signal

    return signal.prevalidate(odd_clips(spark, folder)).select("utterance_id")


@query(
    "decode_wav",
    """SELECT (vec_id // 25)::bigint AS utterance_id, count(*) * 64 AS n, round(sum(list_sum(list_transform(embedding, lambda x: round_even(x::double * 32767, 0) / 32768))), 6) AS total
       FROM embeddings WHERE (vec_id // 25) % 10 <> 3 GROUP BY 1""",
)
def decode_wav(spark, folder):
    from uttera.functions.arrays import array_total
    from uttera.operators import signal

    decoded = signal.decode_wav(signal.prevalidate(wav_clips(spark, folder), known=True))
    return decoded.select(
        "utterance_id", F.size("samples").cast("bigint").alias("n"), F.round(array_total(F.col("samples")), 6).alias("total")
    )


# The feature jobs written out in SQL: every sample, frame, transform bin and filter is a row.
_PCM = """WITH pcm AS (SELECT u, (vec_id % 25) * 64 + d - 1 AS n, round_even(e * 32767, 0) / 32768 AS x FROM (
    SELECT (vec_id // 25)::bigint AS u, vec_id, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) AS d FROM embeddings) WHERE u % 10 <> 3),
  st AS (SELECT u, avg(x) AS m, count(*) AS len FROM pcm GROUP BY u)"""

_LOG_MEL = _PCM + """,
  c AS (SELECT u, n, x - m AS x, len FROM pcm JOIN st USING (u)),
  pk AS (SELECT u, greatest(max(abs(x)), 1e-6) AS p FROM c GROUP BY u),
  e AS (SELECT u, n, len, x - 0.97::double * coalesce(lag(x) OVER (PARTITION BY u ORDER BY n), 0) AS x FROM (SELECT u, n, len, x / p AS x FROM c JOIN pk USING (u))),
  ix AS (SELECT u, t, k, CASE WHEN j < 0 THEN -j WHEN j >= len THEN 2 * (len - 1) - j ELSE j END AS n FROM (
    SELECT u, len, t, k, t * 160 + k - 200 AS j FROM (SELECT u, len, unnest(range(0, len // 160 + 1)) AS t FROM st), (SELECT unnest(range(0, 400)) AS k))),
  f AS (SELECT u, t, k, x * (0.5 - 0.5 * cos(2 * pi() * k / 400)) AS y FROM ix JOIN e USING (u, n)),
  sp AS (SELECT u, t, b, sum(y * cos(2 * pi() * (b * k % 400) / 400)) AS re, sum(y * sin(2 * pi() * (b * k % 400) / 400)) AS im
    FROM f, (SELECT unnest(range(0, 201)) AS b) GROUP BY u, t, b),
  pt AS (SELECT i, 700 * (pow(10, i * 2595 * log10(1 + 8000 / 700.0::double) / 81 / 2595) - 1) AS hz FROM (SELECT unnest(range(0, 82)) AS i)),
  fb AS (SELECT l.i AS m, b, greatest(0, least((b * 40 - l.hz) / (o.hz - l.hz), (r.hz - b * 40) / (r.hz - o.hz))) AS w
    FROM pt l JOIN pt o ON o.i = l.i + 1 JOIN pt r ON r.i = l.i + 2, (SELECT unnest(range(0, 201)) AS b)),
  mel AS (SELECT u, t, m, ln(greatest(sum((re * re + im * im) * w), 1e-5)) AS v FROM sp JOIN fb USING (b) GROUP BY u, t, m),
  nm AS (SELECT u, m, avg(v) AS mean, greatest(stddev_pop(v), 1e-5) AS sd FROM mel GROUP BY u, m)
SELECT u AS utterance_id, t AS frame, list(round((v - mean) / sd, 4) + 0.0 ORDER BY m) AS features FROM mel JOIN nm USING (u, m) GROUP BY u, t"""

_FBANK = _PCM + """,
  fr AS (SELECT u, t, k, x * 32768 AS x FROM (SELECT u, t, k, t * 160 + k AS n FROM
    (SELECT u, unnest(range(0, 1 + (len - 400) // 160)) AS t FROM st WHERE len >= 400), (SELECT unnest(range(0, 400)) AS k)) JOIN pcm USING (u, n)),
  dc AS (SELECT u, t, k, x - avg(x) OVER (PARTITION BY u, t) AS x FROM fr),
  f AS (SELECT u, t, k, (x - 0.97::double * coalesce(lag(x) OVER (PARTITION BY u, t ORDER BY k), x)) * pow(0.5 - 0.5 * cos(2 * pi() * k / 399), 0.85) AS y FROM dc),
  sp AS (SELECT u, t, b, sum(y * cos(2 * pi() * (b * k % 512) / 512))::float::double AS re, sum(y * sin(2 * pi() * (b * k % 512) / 512))::float::double AS im
    FROM f, (SELECT unnest(range(0, 257)) AS b) GROUP BY u, t, b),
  sc AS (SELECT 1127 * ln(1 + 20 / 700.0::double) AS lo, 1127 * ln(1 + 8000 / 700.0::double) AS hi),
  pt AS (SELECT i, lo + (hi - lo) * i / 81 AS q FROM sc, (SELECT unnest(range(0, 82)) AS i)),
  fb AS (SELECT l.i AS m, b, greatest(0, least((z - l.q) / (o.q - l.q), (r.q - z) / (r.q - o.q))) AS w
    FROM pt l JOIN pt o ON o.i = l.i + 1 JOIN pt r ON r.i = l.i + 2, (SELECT b, 1127 * ln(1 + b * 31.25::double / 700) AS z FROM (SELECT unnest(range(0, 257)) AS b))),
  mel AS (SELECT u, t, m, ln(greatest(sum((re * re + im * im) * w), 1.192092955078125e-7)) AS v FROM sp JOIN fb USING (b) GROUP BY u, t, m),
  nm AS (SELECT u, m, avg(v) AS mean, sqrt(CASE WHEN count(*) > 1 THEN var_samp(v) ELSE 0 END + 1e-7) AS sd FROM mel GROUP BY u, m),
  st2 AS (SELECT u, t // 2 AS frame, list(round((v - mean) / sd, 4) + 0.0 ORDER BY t, m) AS features FROM mel JOIN nm USING (u, m) GROUP BY ALL)
SELECT u AS utterance_id, frame, list_resize(features, 160, 1.0::double) AS features FROM st2"""


def _signal_query(name, job, sql=None):
    @query(name, sql)
    def run(spark, folder):
        from uttera.operators import signal

        decoded = signal.decode_wav(signal.prevalidate(wav_clips(spark, folder), known=True))
        out = getattr(signal, job)(decoded)
        if "features" not in out.columns:
            return out
        return out.withColumn("features", F.transform("features", lambda x: F.round(x, 4) + 0.0))


_signal_query("log_mel", "log_mel", _LOG_MEL)
_signal_query("fbank_stacked", "fbank_stacked", _FBANK)
_signal_query("augment_waveform", "augment_waveform")


@query(
    "extract_features",
    f"""SELECT CASE WHEN utterance_id % 10 = 3 THEN 'failed' WHEN utterance_id % 4 = 1 THEN 'hit' ELSE 'written' END AS outcome,
        count(*)::bigint AS n FROM ({_CLIPS}) GROUP BY 1""",
)
def extract_features(spark, folder):
    """Second run of the warming job after a first one over a quarter of the clips."""
    from uttera.plans import warm

    clips = wav_clips(spark, folder).withColumn("utterance_id", F.col("utterance_id").cast("string"))
    path = scratch_path(spark, "features")
    early = F.col("utterance_id").cast("bigint") % 4 == 1
    good = F.col("utterance_id").cast("bigint") % 10 != 3
    warm.extract_features(clips.filter(early & good), path, version=1)
    found = warm.extract_features(clips, path, version=2)
    return found.groupBy("outcome").agg(F.sum("n").alias("n"))


def stored_clips(clips, folder: str):
    """(path) of the clips written as <utterance_id>.wav, by tasks; writing one again replaces it."""
    import pyarrow as pa

    from uttera.sources.files import opened

    def write(batches):
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            names = [f"{u}.wav" for u in batch.column(0).to_pylist()]
            for name, body in zip(names, batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(body)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["path"])

    return clips.select("utterance_id", "audio_bytes").mapInArrow(write, "path string")


SMALL_CLIP = 3250


@query(
    "read_audio_files",
    f"""SELECT utterance_id, size, CASE WHEN size > 30 THEN n ELSE 0 END AS num_samples FROM (SELECT utterance_id, n, CASE WHEN utterance_id % 10 = 3 THEN 30 ELSE
          44 + 2 * n + CASE WHEN utterance_id % 5 = 1 THEN 14 ELSE 0 END + CASE WHEN utterance_id % 6 = 2 THEN 2 ELSE 0 END END AS size FROM ({_CLIPS}))
        WHERE size < {SMALL_CLIP}""",
)
def read_audio_files(spark, folder):
    """Clips written as files; those below a size are read, the bytes of the others are not."""
    from uttera.operators import signal

    path = scratch_path(spark, "audio")
    stored_clips(wav_clips(spark, folder), path).write.format("noop").mode("overwrite").save()
    small = records.read_audio(spark, path, "*.wav").filter(F.col("size") < SMALL_CLIP)
    probed = signal.probe_audio(small)
    name = F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("bigint")
    return probed.select(name.alias("utterance_id"), "size", "num_samples")


_SWEEP = """SELECT p_partkey, p_size % 9 - 1 AS min_chars, p_size AS max_chars, p_size / 45.0::double AS max_symbol_ratio,
    CASE WHEN p_size % 7 > 0 THEN p_size % 7 - 1.0::double END AS min_duration, CASE WHEN p_size % 5 = 0 THEN 'NaN'::double ELSE p_size / 4.0::double END AS max_duration,
    (p_partkey % 11 - 1)::double AS min_chars_per_second, (p_partkey % 13)::double AS max_chars_per_second FROM part"""


@query(
    "check_params",
    f"""SELECT p_partkey, CASE WHEN min_chars < 0 THEN 'min_chars must be >= 0'
        WHEN max_symbol_ratio < 0 OR max_symbol_ratio > 1 THEN 'max_symbol_ratio must be within [0, 1]'
        WHEN max_chars < min_chars THEN 'max_chars must be >= min_chars'
        WHEN isnan(max_duration) THEN 'min_duration and max_duration must be numbers'
        WHEN max_duration < coalesce(min_duration, 0.01) THEN 'max_duration must be >= min_duration'
        WHEN min_chars_per_second < 0 THEN 'min_chars_per_second must be >= 0'
        WHEN max_chars_per_second < min_chars_per_second THEN 'max_chars_per_second must be >= min_chars_per_second' END AS refusal FROM ({_SWEEP})""",
)
def check_params(spark, folder):
    """A sweep of thresholds, a set per row of ``part``, each with what FilterConfig would refuse it for."""
    size, key = F.col("p_size"), F.col("p_partkey")
    sweep = v.table(spark, folder, "part").select(
        "p_partkey", (size % 9 - 1).alias("min_chars"), size.alias("max_chars"), (size / 45.0).alias("max_symbol_ratio"),
        F.when(size % 7 > 0, size % 7 - 1.0).alias("min_duration"), F.when(size % 5 == 0, F.lit(float("nan"))).otherwise(size / 4.0).alias("max_duration"),
        (key % 11 - 1).cast("double").alias("min_chars_per_second"), (key % 13).cast("double").alias("max_chars_per_second"),
    )
    return sweep.select("p_partkey", quality.refusal(sweep).alias("refusal"))


@query("sniff_opus", "SELECT page_id, page_id % 3 = 0 OR contains(html, 'nav') AND page_id % 3 = 1 AS opus FROM pages")
def sniff_opus(spark, folder):
    kind = F.col("page_id") % 3
    marked = F.replace("html", F.lit("nav"), F.lit("OpusHead"))
    rows = v.table(spark, folder, "pages").select(
        "page_id",
        F.when(kind == 0, F.lit("x/clip.OPUS")).otherwise("x/clip.bin").alias("path"),
        F.when(kind == 1, marked).otherwise("none").cast("binary").alias("data"),
    )
    return rows.select("page_id", audio.is_opus(F.col("path"), F.col("data")).alias("opus"))


@query(
    "require_readable",
    v.sql("SELECT row_index FROM records WHERE source IN (SELECT source FROM documents WHERE n_chars > 15000)", "records"),
)
def require_readable(spark, folder):
    """Readable = listed: the listing holds the clips of all sources with long texts."""
    rows = v.records(spark, folder)
    long_ones = v.table(spark, folder, "documents").filter(F.col("n_chars") > 15000).select("source").distinct()
    listing = v.manifest(spark, folder).join(long_ones, "source", "left_semi").select("path").filter(F.col("path").isNotNull())
    return quality.require_readable(rows, listing).select("row_index")


@query("require_bytes", "SELECT page_id FROM pages WHERE contains(url, '/fr/')")
def require_bytes(spark, folder):
    rows = v.table(spark, folder, "pages").select(
        "page_id", F.when(F.contains("url", F.lit("/fr/")), F.col("html").cast("binary")).alias("audio_bytes")
    )
    return quality.require_bytes(rows).select("page_id")


# --- feature log ----------------------------------------------------------------------

CONFIG = FrontendConfig()
_KEY = f"sha256(utterance_id || ':{hashing.frontend_hash(CONFIG)}')"


@query("cache_key", v.sql(f"SELECT utterance_id, {_KEY} AS key, (('0x' || substr({_KEY}, 1, 8))::UBIGINT % 64)::int AS shard FROM records", "records"))
def cache_key(spark, folder):
    key = hashing.cache_key(F.col("utterance_id"), CONFIG)
    keyed = v.records(spark, folder).select("utterance_id", key.alias("key"))
    return keyed.withColumn("shard", hashing.shard_index(F.col("key")))


@query("unit_hash", v.sql(f"SELECT id, {v.sql_unit_hash('id', 13)} AS u FROM manifest", "manifest"))
def unit_hash(spark, folder):
    return v.manifest(spark, folder).select("id", hashing.unit_hash(F.col("id"), 13).alias("u"))


@query("write_features", v.sql("SELECT (('0x' || substr(key, 1, 8))::UBIGINT % 64)::int AS shard, count(*) AS n, count(DISTINCT key) AS keys FROM cache_log GROUP BY 1", "cache_log"))
def write_features(spark, folder):
    path = scratch_path(spark, "feature-log")
    features.write_features(v.cache_log(spark, folder), path)
    return spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


_LATEST = """SELECT key, version, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS n FROM cache_log)
   WHERE n = 1 AND NOT deleted"""


@query("feature_payload", "SELECT vec_id, 1 AS rows, len(embedding)::int AS cols, list_transform(embedding, lambda x: x::double) AS values FROM embeddings")
def feature_payload(spark, folder):
    """Matrices to interchange cells and back."""
    rows = v.table(spark, folder, "embeddings").select(
        "vec_id", F.lit(1).alias("rows"), F.size("embedding").alias("cols"), F.col("embedding").alias("values")
    )
    back = features.decode_payload(features.encode_payload(rows, ["vec_id"]), ["vec_id"])
    return back.withColumn("values", F.col("values").cast("array<double>"))


@query("latest_features", v.sql(_LATEST, "cache_log"))
def latest_features(spark, folder):
    return features.latest_state(v.cache_log(spark, folder), ["value"])


@query("latest_wide", v.sql(_LATEST, "cache_log"))
def latest_wide(spark, folder):
    return features.latest_wide(v.cache_log(spark, folder).drop("user_id"))


@query(
    "upsert_features",
    v.sql(
        """, a AS (SELECT key, version, deleted, value FROM cache_log UNION ALL
             SELECT DISTINCT key, 1000000000, user_id % 3 = 0, CASE WHEN user_id % 3 <> 0 THEN user_id::double END FROM cache_log WHERE user_id % 2 = 0)
        SELECT key, version, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS n FROM a) WHERE n = 1 AND NOT deleted""",
        "cache_log",
    ),
)
def upsert_features(spark, folder):
    """A log, then one append of new values and one of deletions."""
    path = scratch_path(spark, "upserts")
    log = v.cache_log(spark, folder)
    features.write_features(log.drop("user_id"), path)
    users = log.select("key", "user_id").distinct().filter(F.col("user_id") % 2 == 0)
    stored = users.filter(F.col("user_id") % 3 != 0).select("key", F.col("user_id").cast("double").alias("value"))
    gone = users.filter(F.col("user_id") % 3 == 0).select("key", F.lit(None).cast("double").alias("value"))
    features.append_features(stored, path, 1_000_000_000)
    features.append_features(gone, path, 1_000_000_000, deleted=True)
    return features.latest_state(spark.read.parquet(path), ["value"])


@query(
    "join_features",
    v.sql(f", l AS ({_LATEST}) SELECT o_orderkey, l.value, l.key IS NOT NULL AS hit FROM orders LEFT JOIN l ON sha256(o_custkey::varchar) = l.key", "cache_log"),
)
def join_features(spark, folder):
    orders = v.table(spark, folder, "orders").select(
        "o_orderkey", F.sha2(F.col("o_custkey").cast("string"), 256).alias("key")
    )
    stored = features.latest_state(v.cache_log(spark, folder), ["value"]).select("key", "value")
    return features.join_features(orders, stored).select("o_orderkey", "value", "hit")


@query(
    "join_features_multi",
    v.sql(
        f""", l AS ({_LATEST}), c AS (SELECT o_orderkey, unnest([sha256(o_custkey::varchar), sha256((o_custkey % 150)::varchar), sha256((o_custkey % 7)::varchar)]) AS key,
           unnest([0, 1, 2]) AS pos FROM orders)
        SELECT o.o_orderkey, h.key AS hit_key, h.value FROM orders o LEFT JOIN
          (SELECT o_orderkey, arg_min(key, pos) AS key, arg_min(value, pos) AS value FROM c JOIN l USING (key) GROUP BY o_orderkey) h USING (o_orderkey)""",
        "cache_log",
    ),
)
def join_features_multi(spark, folder):
    cust = F.col("o_custkey")
    keys = F.array(*[F.sha2(c.cast("string"), 256) for c in (cust, cust % 150, cust % 7)])
    orders = v.table(spark, folder, "orders").select("o_orderkey", keys.alias("keys"))
    stored = features.latest_state(v.cache_log(spark, folder), ["value"]).select("key", "value")
    return features.join_first_hit(orders, stored, "o_orderkey", "keys", "value").drop("keys")


def _miss(name, sql):
    @query(name, v.sql(sql, "cache_log"))
    def run(spark, folder):
        customers = v.table(spark, folder, "customer").select(
            "c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("key")
        )
        stored = features.latest_state(v.cache_log(spark, folder), [])
        return features.cache_miss(customers, stored).select("c_custkey")


_miss("cache_miss", f", l AS ({_LATEST}) SELECT c_custkey FROM customer c ANTI JOIN l ON sha256(c_custkey::varchar) = l.key")
_miss("except_cached", f", l AS ({_LATEST}) SELECT c_custkey FROM customer WHERE sha256(c_custkey::varchar) IN (SELECT sha256(c_custkey::varchar) FROM customer EXCEPT SELECT key FROM l)")


def _stored_log(spark, folder: str, buckets: int = 16) -> str:
    """The log in buckets, appended in three parts, the last of them twice."""
    path = scratch_path(spark, "bucketed-log")
    feature_log.create(spark, path, "value double", buckets)
    log = v.cache_log(spark, folder).drop("user_id")
    for part in (0, 1, 2, 2):
        feature_log.append(log.filter(F.col("version") % 3 == part), path)
    return path


@query("bucketed_latest", v.sql(_LATEST, "cache_log"))
def bucketed_latest(spark, folder):
    """Before and after a compaction the same rows: those of the log, less those of its compacted form that differ."""
    path = _stored_log(spark, folder)
    before = feature_log.latest(spark, path, ["value"])
    feature_log.compact(spark, path)
    return feature_log.latest(spark, path, ["value"]).join(before.select("key", "version"), ["key", "version"])


@query(
    "bucketed_lookup",
    v.sql(f", l AS ({_LATEST}) SELECT o_orderkey, l.value, l.key IS NOT NULL AS hit FROM orders LEFT JOIN l ON sha256(o_custkey::varchar) = l.key", "cache_log"),
)
def bucketed_lookup(spark, folder):
    orders = v.table(spark, folder, "orders").select("o_orderkey", F.sha2(F.col("o_custkey").cast("string"), 256).alias("key"))
    return feature_log.lookup(orders, _stored_log(spark, folder), ["value"]).select("o_orderkey", "value", "hit")


@query("bucketed_missing", v.sql(f", l AS ({_LATEST}) SELECT c_custkey FROM customer c ANTI JOIN l ON sha256(c_custkey::varchar) = l.key", "cache_log"))
def bucketed_missing(spark, folder):
    customers = v.table(spark, folder, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("key"))
    return feature_log.missing(customers, _stored_log(spark, folder)).select("c_custkey")


@query(
    "feature_plausible",
    """SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN false WHEN 4 THEN false ELSE true END AS ok,
       CASE vec_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 END AS frames FROM embeddings""",
)
def feature_plausible(spark, folder):
    """Matrices of 64 bins: missing, two frames, two frames transposed, one frame, wrong width."""
    kind = F.col("vec_id") % 5
    x = F.col("embedding").cast("array<double>")
    two = F.array(x, x)
    swapped = F.transform(x, lambda e: F.array(e, e))
    matrix = F.when(kind == 1, two).when(kind == 2, swapped).when(kind == 3, F.array(x)).when(
        kind == 4, F.array(F.slice(x, 1, 50))
    )
    rows = v.table(spark, folder, "embeddings").select("vec_id", matrix.alias("m"))
    fixed = features.oriented(F.col("m"), 64)
    return rows.select(
        "vec_id", features.feature_plausible(F.col("m"), 64, F.lit(2)).alias("ok"),
        F.when(fixed.isNotNull(), F.size(fixed)).alias("frames"),
    )


@query(
    "discover_manifests",
    v.sql("SELECT source, count(*) AS n, count(path) AS paths FROM manifest GROUP BY source", "manifest"),
)
def discover_manifests(spark, folder):
    """Manifests below nested folders, with Parquet beside them that is ignored as there are TSV files."""
    path = scratch_path(spark, "manifests")
    rows = v.manifest(spark, folder).select("id", "sentence", "source", "path")
    late = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    manifests.write_tsv(rows.filter(late), f"{path}/a/b")
    manifests.write_tsv(rows.filter(~late).withColumnRenamed("id", "utterance"), f"{path}/c")
    rows.limit(1).write.parquet(f"{path}/d")
    renamed = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in ("a/b", "c"):
        _as_tsv(spark, renamed, f"{path}/{name}")
    found = manifests.read_manifests(spark, path)
    return found.groupBy("source").agg(F.count("*").alias("n"), F.count("path").alias("paths"))


def _as_tsv(spark, hadoop, folder: str) -> None:
    """Spark's writer names its files .csv; manifests are found by their suffix."""
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.endswith(".csv"):
            fs.rename(status.getPath(), hadoop.Path(root, name.replace(".csv", ".tsv")))


@query("reuse_records", v.sql("SELECT utterance_id, split FROM records", "records"))
def reuse_records(spark, folder):
    """A table that is there is read; building it again would fail."""
    path = scratch_path(spark, "reused")
    rows = v.records(spark, folder).select("utterance_id", "split")
    records.write_records(rows, path, {"seed": 13})

    def never():
        raise AssertionError("the table is complete")

    return records.open_or_build(spark, path, never, {"seed": 13})


@query(
    "log_every",
    "SELECT o_orderkey, CASE WHEN n <= 0 THEN 1 ELSE greatest(1000, least(50000, n // 20)) END AS every FROM (SELECT o_orderkey, o_orderkey * (o_custkey % 9) AS n FROM orders)",
)
def log_every(spark, folder):
    from uttera.operators import ranking

    n = F.col("o_orderkey") * (F.col("o_custkey") % 9)
    return v.table(spark, folder, "orders").select("o_orderkey", ranking.progress_interval(n).alias("every"))
