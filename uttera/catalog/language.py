"""Vocabularies, n-gram models and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttera.catalog import views as v
from uttera.catalog.base import query
from uttera.catalog.ctc import rounded
from uttera.functions import arrays
from uttera.operators import ngram, vocab
from uttera.session import cut_lineage

ORDER, ALPHA = 3, 0.1
SUBWORDS = 120

def _sql_grams(text: str, source: str, eos: str = ", ['</s>']") -> str:
    return f"""SELECT row_index, a || '␟' || b AS context, token FROM (
       SELECT row_index, unnest(h[1:len(h) - 2]) AS a, unnest(h[2:len(h) - 1]) AS b, unnest(h[3:]) AS token FROM (
       SELECT row_index, list_concat(['<s>', '<s>'], string_split({text}, ''){eos}) AS h FROM {source}))"""


v.VIEWS["grams"] = (("corpus",), _sql_grams("text", "corpus"))
v.VIEWS["lm_counts"] = (("grams",), "SELECT context, token, count(*) AS n FROM grams GROUP BY ALL")
v.VIEWS["lm_totals"] = (("lm_counts",), "SELECT context, sum(n)::bigint AS total FROM lm_counts GROUP BY context")
v.VIEWS["lm_size"] = (("lm_counts",), "SELECT count(DISTINCT token) AS vocab_size FROM lm_counts")


def model(spark, folder):
    return ngram.train(v.corpus(spark, folder).select("text"), "text", ORDER, ALPHA)


@query("ngram_counts", v.sql("SELECT * FROM lm_counts", "lm_counts"))
def ngram_counts(spark, folder):
    return ngram.ngram_counts(v.corpus(spark, folder).select("text"), "text", ORDER)


@query("ngram_context", v.sql("SELECT * FROM lm_totals", "lm_totals"))
def ngram_context(spark, folder):
    return ngram.context_totals(ngram.ngram_counts(v.corpus(spark, folder).select("text"), "text", ORDER))


@query(
    "lm_summary",
    v.sql(
        """SELECT sum(n) FILTER (token = '</s>')::bigint AS lines, count(DISTINCT token) AS vocab_size, 3 AS "order",
        0.1::double AS alpha FROM lm_counts""",
        "lm_counts",
    ),
)
def lm_summary(spark, folder):
    counts = ngram.ngram_counts(v.corpus(spark, folder).select("text"), "text", ORDER)
    return ngram.lm_meta(counts, ORDER, ALPHA)


@query(
    "map_nested",
    v.sql(
        "SELECT context, sum(n)::bigint AS total, string_agg(token || '=' || n, '|' ORDER BY token COLLATE \"C\") AS nexts FROM lm_counts GROUP BY context",
        "lm_counts",
    ),
)
def map_nested(spark, folder):
    counts = ngram.ngram_counts(v.corpus(spark, folder).select("text"), "text", ORDER)
    maps = ngram.context_maps(counts)
    entries = F.transform(
        F.array_sort(F.map_entries("nexts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return maps.select("context", "total", F.array_join(entries, "|").alias("nexts"))


def _sql_scored(source: str, eos: str) -> str:
    return f""", p AS ({_sql_grams('transcript', source, eos)}),
    s AS (SELECT row_index, sum(ln((coalesce(n, 0) + 0.1::double) / (coalesce(total, 0) + 0.1::double * vocab_size))) AS score
      FROM p LEFT JOIN lm_counts USING (context, token) LEFT JOIN lm_totals USING (context), lm_size GROUP BY row_index)"""


@query(
    "score_lm",
    v.sql(_sql_scored("records", ", ['</s>']") + " SELECT row_index, round(score, 6) AS score FROM s", "records", "lm_totals", "lm_size"),
)
def score_lm(spark, folder):
    texts = v.records(spark, folder).select("row_index", "transcript")
    return rounded(ngram.score_text(texts, "row_index", "transcript", model(spark, folder)), 6, "score")


@query(
    "score_extension",
    v.sql(
        """, p AS (SELECT row_index, array_to_string(h[len(h) - 2:len(h) - 1], '␟') AS context, h[len(h)] AS token FROM (
        SELECT row_index, list_concat(['<s>', '<s>'], string_split(transcript, '')) AS h FROM records))
        SELECT row_index, round(ln((coalesce(n, 0) + 0.1::double) / (coalesce(total, 0) + 0.1::double * vocab_size)), 9) AS score
        FROM p LEFT JOIN lm_counts USING (context, token) LEFT JOIN lm_totals USING (context), lm_size""",
        "records", "lm_totals", "lm_size",
    ),
)
def score_extension(spark, folder):
    texts = v.records(spark, folder).select("row_index", "transcript")
    return rounded(ngram.score_extension(texts, "row_index", "transcript", model(spark, folder)), 9, "score")


@query(
    "rescore_nbest",
    v.sql(
        """, c AS (SELECT utterance_id, row_index, ref AS text, -1.0::double * length(ref) AS acoustic FROM pairs
          UNION ALL SELECT utterance_id, row_index, hyp, -0.9::double * length(hyp) FROM pairs),
        t AS (SELECT DISTINCT text AS transcript, sha256(text) AS row_index FROM c)"""
        + _sql_scored("t", "")
        + """, r AS (SELECT utterance_id, text, acoustic + 0.5::double * score + 0.2::double * length(text) AS total
          FROM c JOIN t ON c.text = t.transcript JOIN s ON s.row_index = t.row_index)
        SELECT utterance_id, text, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY total DESC, text DESC) AS n FROM r) WHERE n = 1""",
        "pairs", "lm_totals", "lm_size",
    ),
)
def rescore_nbest(spark, folder):
    pairs = v.pairs(spark, folder)
    both = [F.struct(F.col(c).alias("text"), (F.length(c) * each).alias("acoustic")) for c, each in (("ref", -1.0), ("hyp", -0.9))]
    hyps = pairs.select("utterance_id", F.inline(F.array(*both)))  # the records are derived once for both
    best = ngram.rescore_nbest(hyps, model(spark, folder), 0.5, 0.2)
    return rounded(best, 6, "total")


@query(
    "token_logprob",
    v.sql(
        """SELECT context, token, round(ln((n + 0.1::double) / (total + 0.1::double * vocab_size)), 9) AS logp
        FROM lm_counts JOIN lm_totals USING (context), lm_size""",
        "lm_totals", "lm_size",
    ),
)
def token_logprob(spark, folder):
    lm = model(spark, folder)
    joined = lm.counts.join(lm.totals, "context")
    logp = ngram.token_logprob(F.col("n"), F.col("total"), lm.vocab_size(), ALPHA)
    return joined.select("context", "token", F.round(logp, 9).alias("logp"))


_VOCAB = """, c AS (SELECT unnest(string_split(transcript, '')) AS token FROM corpus),
   voc AS (SELECT '<blank>' AS token, 0 AS id UNION ALL SELECT token, row_number() OVER (ORDER BY token COLLATE "C")::int AS id
     FROM (SELECT token FROM c GROUP BY token HAVING count(*) >= {n}))"""


def char_table(spark, folder, least=1):
    return vocab.char_vocab(v.corpus(spark, folder), "transcript", least)


@query("char_vocab", v.sql(_VOCAB.format(n=3) + " SELECT * FROM voc", "corpus"))
def char_vocab(spark, folder):
    return char_table(spark, folder, 3)


@query(
    "encode_chars",
    v.sql(
        _VOCAB.format(n=1) + """ , x AS (SELECT row_index, unnest(string_split(transcript, '')) AS token, generate_subscripts(string_split(transcript, ''), 1) AS i FROM records)
        SELECT row_index, list(id ORDER BY i) AS ids FROM x JOIN voc USING (token) GROUP BY row_index""",
        "corpus", "records",
    ),
)
def encode_chars(spark, folder):
    texts = v.records(spark, folder).select("row_index", "transcript")
    return vocab.encode_chars(texts, "transcript", char_table(spark, folder)).select("row_index", "ids")


@query(
    "unknown_chars",
    v.sql(_VOCAB.format(n=500) + " SELECT token, count(*) AS n FROM c WHERE token NOT IN (SELECT token FROM voc) GROUP BY token", "corpus"),
)
def unknown_chars(spark, folder):
    return vocab.unknown_chars(v.corpus(spark, folder), "transcript", char_table(spark, folder, 500))


@query(
    "array_decode",
    v.sql("SELECT row_index, transcript AS text FROM records", "records"),
)
def array_decode(spark, folder):
    """Encoding and decoding again gives the text back. Both read one vocabulary, for which the corpus is counted once."""
    table = cut_lineage(char_table(spark, folder))
    ids = vocab.encode_chars(v.records(spark, folder).select("row_index", "transcript"), "transcript", table)
    return ids.select("row_index", vocab.decode_ids(F.col("ids"), table).alias("text"))


@query(
    "vocab_match",
    v.sql(
        _VOCAB.format(n=1)
        + """, w AS (SELECT '<blank>' AS token, 0 AS id UNION ALL SELECT token, row_number() OVER (ORDER BY token COLLATE "C")::int AS id
          FROM (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM benchmark))
        (SELECT token, id, 'left' AS only_in FROM (SELECT * FROM voc EXCEPT SELECT * FROM w))
        UNION ALL (SELECT token, id, 'right' FROM (SELECT * FROM w EXCEPT SELECT * FROM voc))""",
        "corpus",
    ),
)
def vocab_match(spark, folder):
    other = vocab.char_vocab(v.table(spark, folder, "benchmark"), "text")
    return vocab.vocab_match(char_table(spark, folder), other)


@query(
    "token_labels",
    v.sql(
        """, h AS (SELECT (list_position(logits, list_max(logits)) - 1)::int AS token_id, count(*) AS n FROM frames GROUP BY ALL)
        SELECT token_id, n, CASE WHEN token_id = 0 THEN '<blank>' WHEN token_id % 4 = 0 THEN '<id:' || token_id || '>'
          WHEN token_id % 4 = 1 THEN '▁' || chr(96 + token_id) ELSE chr(96 + token_id) END AS label FROM h""",
        "frames",
    ),
)
def token_labels(spark, folder):
    counts = v.frames(spark, folder).groupBy(arrays.argmax(F.col("logits")).alias("token_id")).agg(F.count("*").alias("n"))
    kind, text = F.col("token_id") % 4, F.decode(F.unhex(F.lpad(F.hex(F.col("token_id") + 96), 4, "0")), "UTF-16BE")
    names = counts.select(
        F.col("token_id").alias("id"),
        F.when(kind.isin(2, 3), text).otherwise("").alias("text"),
        F.when(kind == 1, F.concat(F.lit("▁"), text)).otherwise("").alias("piece"),
    )
    return vocab.label_tokens(counts, names).select("token_id", "n", "label")


@query("word_vocab", v.sql(
    f"""SELECT word AS piece, count(*) AS n FROM (SELECT unnest({v.sql_words('transcript')}) AS word FROM corpus)
    GROUP BY word ORDER BY n DESC, piece COLLATE "C" LIMIT 200""", "corpus"))
def word_vocab(spark, folder):
    from uttera.operators import subword

    return subword.subword_vocab(v.corpus(spark, folder), "transcript", 200, "word").select("piece", "n")


@query("char_pieces", v.sql(
    f"""SELECT piece, count(*) AS n FROM (SELECT unnest(string_split(w, '')) AS piece FROM (SELECT unnest({v.sql_words('transcript')}) AS w FROM corpus))
    GROUP BY piece ORDER BY n DESC, piece COLLATE "C" LIMIT 40""", "corpus"))
def char_pieces(spark, folder):
    from uttera.operators import subword

    return subword.subword_vocab(v.corpus(spark, folder), "transcript", 40, "char").select("piece", "n")


# One merge at a time: every row of a step is a word, and all of them are merged by the step's most frequent pair.
_BPE = f""", wc AS (SELECT w, count(*) AS n FROM (SELECT unnest({v.sql_words('transcript')}) AS w FROM corpus) GROUP BY w),
  letters AS (SELECT piece, sum(n)::bigint AS n FROM (SELECT unnest(string_split(w, '')) AS piece, n FROM wc) GROUP BY piece),
  merges AS (SELECT DISTINCT step, a, b, made FROM (
    WITH RECURSIVE t AS (
      SELECT 0 AS step, array_to_string(list_transform(string_split(w, ''), lambda x: chr(1) || x || chr(2)), '') AS framed, n::bigint AS n,
        '' AS a, '' AS b, 0::bigint AS made FROM wc
      UNION ALL
      SELECT t.step + 1, replace(t.framed, chr(1) || p.a || chr(2) || chr(1) || p.b || chr(2), chr(1) || p.a || p.b || chr(2)), t.n, p.a, p.b, p.made
      FROM t, (SELECT a, b, sum(n)::bigint AS made FROM (
          SELECT unnest(s[:len(s) - 1]) AS a, unnest(s[2:]) AS b, n FROM (
            SELECT string_split(substr(framed, 2, length(framed) - 2), chr(2) || chr(1)) AS s, n FROM t) WHERE len(s) > 1)
        GROUP BY a, b ORDER BY made DESC, a COLLATE "C", b COLLATE "C" LIMIT 1) p
      WHERE t.step < {SUBWORDS} - (SELECT count(*) FROM letters))
    SELECT * FROM t WHERE step > 0))
  SELECT piece, n, -1 AS rank FROM letters UNION ALL SELECT a || b, made, step - 1 FROM merges"""


@query("subword_vocab", v.sql(_BPE, "corpus"))
def subword_vocab(spark, folder):
    from uttera.operators import subword

    return subword.subword_vocab(v.corpus(spark, folder), "transcript", SUBWORDS, "bpe")


@query("unigram_vocab")
def unigram_vocab(spark, folder):
    from uttera.operators import subword

    return subword.subword_vocab(v.corpus(spark, folder), "transcript", 150, "unigram", seeds=600)
