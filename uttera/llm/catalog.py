"""The registered queries of this package, each applied to its whole table, and their SQL twins.

A query derives its columns from what its operator returns. Queries without SQL use what DuckDB does not have
(trained models, XXH64, byte-exact substring classes); tests/llm holds them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttera.llm import (
    blockmax,
    collisions,
    factorisation,
    feistel,
    fm_index,
    fragments,
    mixing,
    pii_tagger,
    simhash_ring,
    suffix_dedup,
    toxic_segments,
    warc_chunks,
    whitening,
)
from uttera.llm.common import is_held_out, table

SHARDS = 8
TOXIC_FROM = 0.7
GOOD_FROM = 0.5


def op1_factorisation_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    machine = factorisation.fit(docs, table(spark, folder, "labels"))
    return factorisation.score(docs, machine).select("record.doc_id", "score").select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted")
    )


def op2_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = toxic_segments.fit(docs, table(spark, folder, "labels"))
    return toxic_segments.score(docs, lexicon).select("record.doc_id", "score", F.size("passages").alias("n_passages")).select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_passages"
    )


def op3_fm_index_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = fm_index.find_phrases(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    return found.select(
        "record.doc_id",
        "n_words",
        fm_index.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        fm_index.is_contaminated().alias("contaminated"),
    )


def op4_warc_chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    return warc_chunks.through_archives(table(spark, folder, "pages").select("page_id", "url", "html"))


def op5_golden_ratio_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents").select("doc_id", "text", "source"))


def op6_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32")
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return feistel.shard_rows(docs, order, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_collision_counting(spark: SparkSession, folder: str) -> DataFrame:
    return collisions.neighbours(table(spark, folder, "embeddings").select("vec_id", "embedding")).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(table(spark, folder, "documents").select("doc_id", "text"), with_text=False)
    length = F.aggregate(
        F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return cut.select(
        "doc_id",
        "n_bytes",
        length.alias("n_removed"),
        F.floor(F.size("runs") / 2).cast("long").alias("n_spans"),
        "kept_sha256",
    )


def op9_bilstm_crf_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii_tagger.find_personal_data(docs, pii_tagger.fit(docs))
    order = F.create_map(*[F.lit(x) for kv in zip(pii_tagger.KINDS, range(4), strict=True) for x in kv])

    def joined(spans):
        listed = F.array_sort(F.transform(spans, lambda s: F.struct(F.element_at(order, s["kind"]).alias("k"), s["start"], s["end"], s["kind"])))
        return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii_tagger.KINDS]
    return found.select(
        "record.doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans")
    )


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_ring.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op11_fragment_join(spark: SparkSession, folder: str) -> DataFrame:
    """Four words and a similarity of 0.85; see fragments.near_copies."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return fragments.near_copies(docs, words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op12_householder_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """One row per usable vector and component; vectors of a dimension without a component of positive variance have none."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    axes = whitening.fit(vectors)
    errors = whitening.identity_errors(vectors, axes)
    per_component = F.create_map(
        *[x for d, a in axes.items() for x in (F.lit(d), F.array(*[F.lit(float(v)) for v in a.explained]))], F.lit(-1), F.array(F.lit(0.0))
    )
    error = F.create_map(*[x for d, e in errors.items() for x in (F.lit(d), F.lit(e))], F.lit(-1), F.lit(0.0))
    size = F.size("record.embedding")
    rows = whitening.whiten(vectors, axes).select(
        "record.vec_id", "n", "deviation", F.element_at(error, size).alias("identity_error"),
        F.element_at(per_component, size).alias("shares"), F.posexplode("whitened").alias("at", "whitened"),
    )
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.element_at("shares", F.col("at") + 1).alias("explained"), "identity_error",
    )


def op13_block_max_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every item; see blockmax.search."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = blockmax.search(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    return found.select("record.item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_factorisation_quality,
        op2_toxic_segments,
        op3_fm_index_decontamination,
        op4_warc_chunk_table,
        op5_golden_ratio_mix,
        op6_feistel_shards,
        op7_collision_counting,
        op8_suffix_array_dedup,
        op9_bilstm_crf_pii,
        op10_simhash_near_dedup,
        op11_fragment_join,
        op12_householder_whitening,
        op13_block_max_search,
    )
}

_OP3 = r"""
WITH coded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS words FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM coded, lengths WHERE len(w) >= n),
found AS (
    SELECT doc_id, item_id, p, n
    FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS words FROM places) JOIN windows USING (n, words)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM found) GROUP BY doc_id),
listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM coded LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_OP4 = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
kept AS (SELECT html, max(page_id) AS kept FROM sized WHERE n >= 1000 GROUP BY html)
SELECT page_id, cast(n AS bigint) AS payload_bytes, sha1(s.html) AS payload_digest,
    CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < kept THEN kept END AS refers_to
FROM sized s LEFT JOIN kept ON s.html = kept.html AND s.n >= 1000
"""

_OP5 = r"""
WITH sized AS (
    SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size,
        md5(concat(coalesce(cast(doc_id AS varchar), ''), '|', md5(coalesce(text, '')))) AS key FROM documents),
per AS (SELECT source, count(*) AS n, cast(sum(size) AS bigint) AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, 2 * source_size AS cap,
        1.5::double * cast(sum(source_size) OVER () AS bigint) AS budget FROM per),
weights AS (SELECT *, ([5.0, 2.0, 1.0]::double[])[cast(sid % 3 + 1 AS int)] AS w FROM weighed),
filling AS (
    SELECT *, coalesce(cast(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint), 0) AS filled,
        sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened FROM weights),
level AS (
    SELECT budget - filled AS remains, opened AS shared FROM filling
    WHERE (budget - filled) / opened <= cap / w ORDER BY cap / w, sid LIMIT 1),
targets AS (
    SELECT source, sid, n, source_size, least(cast(cap AS double), remains * w / shared) AS target FROM filling, level),
placed AS (
    SELECT doc_id, size, source_size, target, least(cast(round(target) AS bigint), 2 * source_size) AS words,
        cast(sum(size) OVER (PARTITION BY sid ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) - size AS place
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
    greatest(0, least(place + size, words) - place) + greatest(0, least(source_size + place + size, words) - source_size - place) AS taken
FROM placed
"""



def _op6_sql() -> str:
    """Row numbers, CRC-32 from its polynomial, and the Feistel rounds one after the other, walking on while outside."""

    def mixed(x: str) -> str:
        once = f"(({x} * {feistel.MULTIPLY[0]} + keys[k % {feistel.ROUNDS} + 1]) & {feistel.MASK})"
        twice = f"((xor({once}, {once} >> 15) * {feistel.MULTIPLY[1]}) & {feistel.MASK})"
        return f"xor({twice}, {twice} >> 13)"

    inside = f"k > 0 AND k % {feistel.ROUNDS} = 0 AND l * b + r < n"
    return f"""
WITH RECURSIVE steps(i, c, k) AS (
    SELECT i, i::bigint, 0 FROM range(256) t(i) UNION ALL
    SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
polynomials AS (SELECT list(c ORDER BY i) AS crcs FROM steps WHERE k = 8),
coded AS (
    SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) AS bytes
    FROM documents),
summed AS (
    SELECT doc_id, len(bytes) + 1 AS size, CASE WHEN len(bytes) = 0 THEN 0 ELSE
        xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, crcs[(xor(a, x) & 255) + 1])), 4294967295) END AS crc
    FROM coded, polynomials),
numbered AS (
    SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS number, count(*) OVER () AS n FROM summed),
sided AS (SELECT *, greatest(2, floor(sqrt(n - 1))::bigint + 1) AS a FROM numbered),
halves AS (SELECT *, greatest(2, (n + a - 1) // a) AS b, {feistel.round_keys(1)} AS keys FROM sided),
net(number, n, a, b, keys, l, r, k) AS (
    SELECT number, n, a, b, keys, number // b, number % b, 0 FROM halves UNION ALL
    SELECT number, n, a, b, keys, CASE WHEN k % 2 = 0 THEN (l + {mixed('r')} % a) % a ELSE l END,
        CASE WHEN k % 2 = 1 THEN (r + {mixed('l')} % b) % b ELSE r END, k + 1 FROM net WHERE NOT ({inside})),
placed AS (SELECT number, l * b + r AS place FROM net WHERE {inside})
SELECT doc_id, size::bigint AS size, crc::bigint AS text_crc32, 'rows' AS law, (place % {SHARDS})::int AS shard,
    (place // {SHARDS})::bigint AS slot, NULL::int AS grown_shard FROM numbered JOIN placed USING (number)
"""


_OP11 = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 3], ' ') END AS gram, len(w) < 4 AS short
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b
    ON a.gram = b.gram AND a.short = b.short AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON lowest.a = doc_id
"""

_OP13 = r"""
WITH worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sized AS (SELECT doc_id, w, cast(len(w) AS bigint) AS n FROM worded WHERE len(w) > 0),
whole AS (SELECT count(*) AS docs, cast(sum(n) AS bigint) AS terms FROM sized),
held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM sized) GROUP BY doc_id, term),
asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
weighed AS (
    SELECT term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1))) AS bigint) AS w
    FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole),
normed AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM sized, whole),
scored AS (
    SELECT item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS bigint) AS score
    FROM asked JOIN held USING (term) JOIN weighed USING (term) JOIN normed USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


ORACLES: dict[str, str] = {
    "op3_fm_index_decontamination": _OP3,
    "op4_warc_chunk_table": _OP4,
    "op5_golden_ratio_mix": _OP5,
    "op6_feistel_shards": _op6_sql(),
    "op11_fragment_join": _OP11,
    "op13_block_max_search": _OP13,
}
