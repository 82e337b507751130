"""Text functions, ids, chunks and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttera.catalog import views as v
from uttera.catalog.base import query
from uttera.functions import text
from uttera.operators import chunks, quality, redact

DOCS = "documents"


@query("normalize_ws", f"SELECT doc_id, {v.sql_strip(f'regexp_replace(text, {chr(39)}{v.WS}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} AS text FROM documents")
def normalize_ws(spark, folder):
    return v.table(spark, folder, DOCS).select("doc_id", text.normalize_ws(F.col("text")).alias("text"))


@query("symbol_ratio", f"SELECT doc_id, round({v.sql_symbol_ratio('text')}, 12) AS ratio FROM documents")
def symbol_ratio(spark, folder):
    return v.table(spark, folder, DOCS).select("doc_id", F.round(text.symbol_ratio(F.col("text")), 12).alias("ratio"))


@query("char_count", f"SELECT doc_id, {v.sql_char_count('text')}::int AS n FROM documents")
def char_count(spark, folder):
    return v.table(spark, folder, DOCS).select("doc_id", text.char_count(F.col("text")).alias("n"))


@query("word_count", f"SELECT doc_id, len({v.sql_words('text')})::int AS n FROM documents")
def word_count(spark, folder):
    return v.table(spark, folder, DOCS).select("doc_id", text.word_count(F.col("text")).alias("n"))


_JOINED = r"""CASE WHEN l = '' THEN r WHEN r = '' THEN l
   WHEN regexp_matches(l, '[ \n]$') OR regexp_matches(r, '^[ \n,.!?:;]') THEN l || r ELSE l || ' ' || r END"""


@query(
    "join_transcripts",
    f"SELECT conv_id, turn, {_JOINED} AS joined FROM (SELECT conv_id, turn, text AS l, substr(text, 1 + (turn % 7)::bigint * 3) AS r FROM conversations)",
)
def join_transcripts(spark, folder):
    left = F.col("text")
    right = F.substring(left, (F.col("turn") % 7 * 3 + 1).cast("int"), F.length(left))
    return v.table(spark, folder, "conversations").select(
        "conv_id", "turn", text.join_transcripts(left, right).alias("joined")
    )


_SAFE = r"regexp_replace(regexp_replace({c}, '[^\pL\pN\-_.]', '_', 'g'), '^[._]+|[._]+$', '', 'g')"


@query(
    "safe_id",
    f"""SELECT page_id, CASE WHEN s = '' THEN substr(sha256(url), 1, 16) WHEN s = url THEN s
        ELSE substr(s, 1, 96) || '_' || substr(sha256(url), 1, 8) END AS name FROM (SELECT page_id, url, {_SAFE.format(c='url')} AS s FROM pages)""",
)
def safe_id(spark, folder):
    return v.table(spark, folder, "pages").select("page_id", text.safe_id(F.col("url")).alias("name"))


@query(
    "preview_name",
    v.sql(
        r"""SELECT row_index, 'sample_' || CASE WHEN length(row_index::varchar) >= 6 THEN row_index::varchar ELSE lpad(row_index::varchar, 6, '0') END || '_' ||
        substr(regexp_replace(coalesce(nullif(regexp_replace(regexp_replace(path, '[^A-Za-z0-9_.\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'utt' || row_index),
        '(?i)\.(wav|flac|mp3|opus|ogg|m4a|aac)$', ''), 1, 80) AS name FROM manifest""",
        "manifest",
    ),
)
def preview_name(spark, folder):
    return v.manifest(spark, folder).select("row_index", text.preview_name(F.col("row_index"), F.col("path")).alias("name"))


@query(
    "run_name",
    r"""SELECT event_id, regexp_replace(regexp_replace(event_type || ' run!', '[^A-Za-z0-9._\-]+', '-', 'g'), '^-+|-+$', '', 'g') || '_' ||
        strftime(ts, '%Y%m%d_%H%M%S') || CASE WHEN user_id > 75 THEN '_resume-e' || lpad((user_id % 9 + 1)::varchar, 4, '0') || '-s' || lpad(user_id::varchar, 8, '0') ELSE '' END AS name
        FROM (SELECT event_id, event_type, ts, user_id FROM events)""",
)
def run_name(spark, folder):
    resumed = F.col("user_id") > 75
    step = F.when(resumed, F.col("user_id")).otherwise(0)
    epoch = F.when(resumed, F.col("user_id") % 9 + 1).otherwise(1)
    name = text.run_name(
        F.concat("event_type", F.lit(" run!")), F.col("ts").cast("timestamp"), epoch, step
    )
    return v.table(spark, folder, "events").select("event_id", name.alias("name"))


@query("is_url", "SELECT page_id, regexp_matches(url, '^(?i)https?:') AS url, regexp_matches(substr(url, 1 + (page_id % 3)::bigint), '^(?i)https?:') AS cut FROM pages")
def is_url(spark, folder):
    cut = F.substring("url", (F.col("page_id") % 3 + 1).cast("int"), F.length("url"))
    return v.table(spark, folder, "pages").select("page_id", text.is_url(F.col("url")).alias("url"), text.is_url(cut).alias("cut"))


@query(
    "source_suffix",
    r"""SELECT page_id, lower(regexp_extract(regexp_replace(u, '[?#].*$', ''), '[^/](\.[^./]+)$', 1)) AS suffix FROM
        (SELECT page_id, regexp_replace(url, '\?', CASE WHEN page_id % 2 = 0 THEN '.TSV?' ELSE '?' END) AS u FROM pages)""",
)
def source_suffix(spark, folder):
    renamed = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", r"\?", ".TSV?")).otherwise(F.col("url"))
    return v.table(spark, folder, "pages").select("page_id", text.source_suffix(renamed).alias("suffix"))


@query(
    "hub_id",
    r"""SELECT doc_id, NOT regexp_matches(s, '^(?i)https?:') AND NOT regexp_matches(s, '^(/|\./|\.\./|~/)') AND NOT regexp_matches(s, '\.(parquet|tsv)$')
        AND contains(s, '/') AS hub FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN source || '/' || lang WHEN 2 THEN './' || source || '/x'
        WHEN 3 THEN source || '/a.tsv' ELSE 'http://' || source || '/x' END AS s FROM documents)""",
)
def hub_id(spark, folder):
    kind, source = F.col("doc_id") % 5, F.col("source")
    name = (
        F.when(kind == 0, source)
        .when(kind == 1, F.concat(source, F.lit("/"), F.col("lang")))
        .when(kind == 2, F.concat(F.lit("./"), source, F.lit("/x")))
        .when(kind == 3, F.concat(source, F.lit("/a.tsv")))
        .otherwise(F.concat(F.lit("http://"), source, F.lit("/x")))
    )
    return v.table(spark, folder, DOCS).select("doc_id", text.is_hub_id(name).alias("hub"))


# --- filters on whole documents and lines ---------------------------------------------


@query(
    "filter_duration",
    v.sql("SELECT row_index, CASE WHEN duration < 0.01 THEN 'audio_too_short' WHEN duration > 30 THEN 'audio_too_long' END AS reason FROM manifest", "manifest"),
)
def filter_duration(spark, folder):
    return v.manifest(spark, folder).select("row_index", quality.duration_reason(F.col("duration")).alias("reason"))


@query(
    "filter_transcript",
    v.sql(
        f"""SELECT row_index, CASE WHEN length(transcript) < 5 THEN 'too_short' WHEN length(transcript) > 300 THEN 'too_long'
        WHEN {v.sql_symbol_ratio('transcript')} > 0.05 THEN 'symbol_ratio' WHEN NOT regexp_matches(transcript, '[\\pL\\pN]') THEN 'no_alnum' END AS reason FROM picked""",
        "picked",
    ),
)
def filter_transcript(spark, folder):
    from uttera.config import FilterConfig
    from uttera.operators.common import computed_once

    cfg = FilterConfig(min_chars=5, max_chars=300, max_symbol_ratio=0.05)
    rows = computed_once(v.manifest(spark, folder), t=text.normalize_transcript(F.col("sentence")))
    return rows.select("row_index", quality.transcript_reason(F.col("t"), cfg).alias("reason"))


@query(
    "filter_alignment",
    v.sql(
        f"""SELECT row_index, CASE WHEN duration <= 0 OR c <= 0 OR w <= 0 THEN NULL WHEN c / duration < 5 THEN 'chars_per_second_too_low' WHEN c / duration > 14 THEN 'chars_per_second_too_high'
        WHEN w / duration < 1 THEN 'words_per_second_too_low' WHEN w / duration > 2.2::double THEN 'words_per_second_too_high'
        WHEN duration / c < 0.07::double THEN 'duration_per_char_too_low' WHEN duration / c > 0.08::double THEN 'duration_per_char_too_high'
        WHEN duration / w < 0.45::double THEN 'duration_per_word_too_low' WHEN duration / w > 0.6::double THEN 'duration_per_word_too_high' END AS reason
        FROM (SELECT row_index, duration, {v.sql_char_count('transcript')} AS c, len({v.sql_words('transcript')}) AS w FROM picked)""",
        "picked",
    ),
)
def filter_alignment(spark, folder):
    from uttera.config import FilterConfig

    cfg = FilterConfig(
        min_chars_per_second=5, max_chars_per_second=14, min_words_per_second=1, max_words_per_second=2.2,
        min_duration_per_char=0.07, max_duration_per_char=0.08, min_duration_per_word=0.45, max_duration_per_word=0.6,
    )
    rows = v.manifest(spark, folder)
    t = text.normalize_transcript(F.col("sentence"))
    rows = rows.select("row_index", "duration", text.char_count(t).alias("c"), text.word_count(t).alias("w"))
    return rows.select("row_index", quality.alignment_reason(F.col("c"), F.col("w"), F.col("duration"), cfg).alias("reason"))


@query(
    "pick_transcript",
    f"""SELECT doc_id, coalesce(CASE WHEN regexp_matches(a, '[^\\s\\pZ]') THEN a END, CASE WHEN regexp_matches(b, '[^\\s\\pZ]') THEN b END) AS picked FROM
       (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE text END AS a, lang AS b FROM documents)""",
)
def pick_transcript(spark, folder):
    kind = F.col("doc_id") % 3
    first = F.when(kind == 1, "  ").when(kind == 2, F.col("text"))
    rows = v.table(spark, folder, DOCS).select("doc_id", first.alias("sentence"), F.col("lang").alias("transcription"))
    return rows.select("doc_id", quality.pick_transcript(rows).alias("picked"))


@query(
    "pick_duration",
    """SELECT event_id, coalesce(nullif(a, 0), nullif(b, 0), c) AS duration FROM (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 0 WHEN user_id % 4 = 1 THEN NULL ELSE value END AS a,
        try_cast(CASE WHEN user_id % 3 = 0 THEN '0' WHEN user_id % 3 = 1 THEN 'n/a' ELSE value::varchar END AS double) AS b, CASE WHEN user_id % 5 = 0 THEN 0.0::double ELSE NULL END AS c FROM events)""",
)
def pick_duration(spark, folder):
    user, value = F.col("user_id"), F.col("value")
    rows = v.table(spark, folder, "events").select(
        "event_id",
        F.when(user % 4 == 0, 0.0).when(user % 4 == 1, F.lit(None)).otherwise(value).alias("duration"),
        F.when(user % 3 == 0, "0").when(user % 3 == 1, "n/a").otherwise(value.cast("string")).alias("duration_seconds"),
        F.when(user % 5 == 0, 0.0).alias("audio_duration"),
    )
    return rows.select("event_id", quality.pick_duration(rows).alias("duration"))


@query(
    "speaker_id",
    """SELECT doc_id, s AS speaker_id, s IS NOT NULL AS has_speaker_id FROM (SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''),
       CASE WHEN doc_id % 6 = 0 THEN lang END) AS s FROM documents)""",
)
def speaker_id(spark, folder):
    doc = F.col("doc_id")
    rows = v.table(spark, folder, DOCS).select(
        "doc_id", F.when(doc % 3 == 0, "").otherwise(F.col("source")).alias("client_id"), F.when(doc % 6 == 0, F.col("lang")).alias("speaker")
    )
    picked = rows.select("doc_id", quality.pick_speaker(rows).alias("speaker_id"))
    return picked.withColumn("has_speaker_id", F.col("speaker_id").isNotNull())


@query(
    "utterance_id",
    v.sql("""SELECT row_index, coalesce(CASE WHEN row_index % 3 = 0 THEN NULL WHEN row_index % 3 = 1 THEN nullif('', '') ELSE id END, CASE WHEN path IS NOT NULL THEN 'base/' || path END, row_index::varchar) AS utterance_id FROM manifest""", "manifest"),
)
def utterance_id(spark, folder):
    kind = F.col("row_index") % 3
    rows = v.manifest(spark, folder).withColumn("id", F.when(kind == 1, "").when(kind == 2, F.col("id")))
    path, _ = quality.resolve_audio(rows, F.lit("base"))
    return rows.select("row_index", quality.utterance_id(rows, path, F.col("row_index")).alias("utterance_id"))


@query(
    "resolve_audio",
    """SELECT page_id, CASE WHEN k = 0 THEN url WHEN k = 1 THEN '/abs/' || page_id WHEN k IN (2, 3) THEN 'base/dir/rel/' || page_id END AS audio_path,
       CASE WHEN k IN (3, 4) THEN strlen(html) END AS n FROM (SELECT page_id, url, html, page_id % 6 AS k FROM pages)""",
)
def resolve_audio(spark, folder):
    k, name = F.col("page_id") % 6, F.col("page_id").cast("string")
    path = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/abs/"), name)).when(k == 2, F.concat(F.lit("rel/"), name))
    audio = F.when(
        k.isin(0, 3, 4),
        F.struct(F.col("html").cast("binary").alias("bytes"), F.when(k == 3, F.concat(F.lit("rel/"), name)).alias("path")),
    )
    rows = v.table(spark, folder, "pages").select("page_id", path.alias("path"), audio.alias("audio"))
    resolved, data = quality.resolve_audio(rows, F.lit("base/dir/"))
    return rows.select("page_id", resolved.alias("audio_path"), F.octet_length(data).cast("bigint").alias("n"))


# --- chunks ---------------------------------------------------------------------------

v.VIEWS["chunks"] = (
    (),
    f"""SELECT doc_id, i, CASE WHEN i % 3 = 1 THEN substr(t, 2) ELSE t END AS t FROM (
        SELECT doc_id, i, array_to_string(w[25 * i + 1:25 * i + 30], ' ') AS t FROM (
        SELECT doc_id, w, unnest(range(0, greatest(1, ceil(len(w) / 25))::bigint)) AS i FROM (
        SELECT doc_id, {v.sql_words('text')} AS w FROM documents)))""",
)


def chunk_rows(spark, folder):
    """Windows of 30 words, 25 apart; every third one has lost its first character."""
    from uttera.operators.common import computed_once

    listed = computed_once(v.table(spark, folder, DOCS).select("doc_id", "text"), w=text.words(F.col("text")))
    n = F.greatest(F.lit(1), F.ceil(F.size("w") / 25)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(F.col("w"), i * 25 + 1, F.lit(30)), " ")
    )
    exploded = listed.select("doc_id", F.posexplode(pieces).alias("i", "t"))
    cut = F.when(F.col("i") % 3 == 1, F.substring("t", F.lit(2), F.length("t"))).otherwise(F.col("t"))
    return exploded.select("doc_id", "i", cut.alias("t"))


_MERGE = f"""CASE WHEN acc = '' THEN t WHEN t = '' THEN acc WHEN contains(acc, t) THEN acc WHEN contains(t, acc) THEN t
  WHEN kw IS NOT NULL THEN CASE WHEN kw >= len(tw) THEN acc ELSE acc || ' ' || array_to_string(tw[kw + 1:], ' ') END
  WHEN kc IS NOT NULL THEN acc || substr(t, kc + 1)
  ELSE {_JOINED.replace(' l ', ' acc ').replace(' r ', ' t ').replace('(l,', '(acc,').replace('(r,', '(t,').replace('THEN l', 'THEN acc').replace('THEN r', 'THEN t').replace('|| r', '|| t').replace('ELSE l', 'ELSE acc')} END"""


@query(
    "merge_chunks",
    v.sql(
        f""", c AS (SELECT doc_id, i, {v.sql_strip('t')} AS t FROM chunks),
        g(doc_id, i, acc) AS (
          SELECT doc_id, 0::bigint, t FROM c WHERE i = 0
          UNION ALL
          SELECT doc_id, i, {_MERGE} FROM (
            SELECT *, list_max(list_filter(range(1, least(len(aw), len(tw), 20) + 1), lambda k: aw[len(aw) - k + 1:] = tw[1:k])) AS kw,
              list_max(list_filter(range(9, least(length(tail), length(t), 120) + 1), lambda k: right(tail, k) = left(t, k))) AS kc
            FROM (SELECT c.doc_id, c.i, g.acc, c.t, string_split(c.t, ' ') AS tw, right(g.acc, 120) AS tail,
              string_split(g.acc, ' ')[-20:] AS aw FROM g JOIN c ON c.doc_id = g.doc_id AND c.i = g.i + 1)))
        SELECT doc_id, arg_max(acc, i) AS transcript FROM g GROUP BY doc_id""",
        "chunks",
        recursive=True,
    ),
)
def merge_chunks(spark, folder):
    return chunks.merge_chunks(chunk_rows(spark, folder), "doc_id", "i", "t")


@query(
    "chunk_plan",
    """WITH d AS (SELECT doc_id, length(text)::bigint * 1000 AS n FROM documents),
       l AS (SELECT *, n / 16000 > 45 AND n > 480000 AS long, greatest(1, ceil(greatest(n - 80000, 0) / 400000))::bigint AS k FROM d)
       SELECT doc_id, n AS num_samples, chunk::int AS chunk, chunk * 400000 AS "start", CASE WHEN long THEN least(n, chunk * 400000 + 480000) ELSE n END AS "end"
       FROM (SELECT *, unnest(range(0, CASE WHEN long THEN k ELSE 1 END)) AS chunk FROM l)""",
)
def chunk_plan(spark, folder):
    recordings = v.table(spark, folder, DOCS).select("doc_id", (F.length("text").cast("bigint") * 1000).alias("num_samples"))
    return chunks.chunk_plan(recordings)


# --- secrets --------------------------------------------------------------------------


def _sql_pattern(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_redact(c: str) -> str:
    inner = rf"""regexp_replace({c}, {_sql_pattern(redact.ASSIGNED)}, '\1"{redact.REDACTED}"', 'g')"""
    inner = f"regexp_replace({inner}, '{redact.BEARER}', 'Bearer {redact.REDACTED}', 'g')"
    inner = f"regexp_replace({inner}, '{redact.TOKEN}', '{redact.REDACTED}', 'g')"
    return rf"regexp_replace({inner}, {_sql_pattern(redact.BARE)}, '\1{redact.REDACTED}', 'g')"


@query("redact_secrets", f"SELECT doc_id, {_sql_redact('text')} AS text FROM documents")
def redact_secrets(spark, folder):
    return redact.redact(v.table(spark, folder, DOCS).select("doc_id", "text"), ["text"])


@query(
    "redact_json",
    f"""SELECT event_id, '{{"api_key":"{redact.REDACTED}","note":"Bearer {redact.REDACTED}","props":' || replace(props, ' ', '') || '}}' AS payload FROM events""",
)
def redact_json(spark, folder):
    token = F.concat(F.lit("hf_"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 24))
    raw = F.concat(
        F.lit('{"api_key":"'), token, F.lit('","note":"Bearer '), token, F.lit('","props":'),
        F.replace("props", F.lit(" "), F.lit("")), F.lit("}"),
    )
    return v.table(spark, folder, "events").select("event_id", redact.redact_json(raw).alias("payload"))


@query(
    "redact_json_values",
    f"""SELECT event_id, '{{"api_key":"{redact.REDACTED}","tokens":"{redact.REDACTED}","password":"{redact.REDACTED}","value":' || event_id || ',"note":"' || event_type || '"}}' AS payload FROM events""",
)
def redact_json_values(spark, folder):
    """Numbers, lists and objects under secret names."""
    number, kind = F.col("event_id").cast("string"), F.col("event_type")
    raw = F.concat(
        F.lit('{"api_key":'), number, F.lit(',"tokens":["a]",{"b":'), number, F.lit('}],"password":{"v":["'), kind,
        F.lit('"]},"value":'), number, F.lit(',"note":"'), kind, F.lit('"}'),
    )
    return v.table(spark, folder, "events").select("event_id", redact.redact_json(raw).alias("payload"))


@query(
    "redact_turns",
    f"""SELECT conv_id, turn, {_sql_redact("role || ' token=' || conv_id || 'x password: \"' || role || '\" ' || text")} AS said,
        '{redact.REDACTED}' AS session_token, CAST(NULL AS bigint) AS key_of_access, 'plain' AS other FROM conversations""",
)
def redact_turns(spark, folder):
    """Assignments inside texts, and secret fields of texts and numbers below a struct and a map."""
    conv = F.col("conv_id").cast("string")
    said = F.concat("role", F.lit(" token="), conv, F.lit('x password: "'), "role", F.lit('" '), "text")
    rows = v.table(spark, folder, "conversations").select(
        "conv_id", "turn", said.alias("said"),
        F.struct(conv.alias("session_token"), F.struct(F.col("conv_id").alias("id")).alias("access_key"), F.lit("plain").alias("other")).alias("s"),
        F.create_map(F.lit("secrets"), F.array(conv), F.lit("names"), F.array(F.lit("plain"))).alias("m"),
    )
    out = redact.redact(rows)
    kept = F.when(F.col("m")["secrets"][0] == redact.REDACTED, F.col("m")["names"][0])
    return out.select("conv_id", "turn", "said", "s.session_token", F.col("s.access_key.id").alias("key_of_access"), kept.alias("other"))
