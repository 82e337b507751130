"""Character n-gram language models as tables, and scoring by join.

Model tables: ``counts`` (context, token, n), ``maps`` (context, total, nexts: token -> n) and ``meta`` with
one row (lines, vocab_size, order, alpha). The start symbol pads contexts and is no part of
the vocabulary; the end symbol is.

With order 1 every context is empty, in training and in scoring alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from uttera.functions import text as tx
from uttera.operators.common import computed_once
from uttera.operators.vocab import characters
from uttera.session import scratch_path

# Padding symbols and the separator inside a context key.
BOS, EOS, SEP = "<s>", "</s>", "␟"


@dataclass(frozen=True)
class NgramModel:
    counts: DataFrame
    maps: DataFrame
    meta: DataFrame
    order: int
    alpha: float

    @property
    def totals(self) -> DataFrame:
        return self.maps.select("context", "total")

    def vocab_size(self) -> Column:
        """A scalar subquery over the one-row table."""
        return self.meta.select("vocab_size").scalar()


def _padded(symbols: Column, order: int, eos: bool = True) -> Column:
    head = F.array_repeat(F.lit(BOS), order - 1)
    return F.concat(head, symbols, F.array(F.lit(EOS))) if eos else F.concat(head, symbols)


def explode_ngrams(df: DataFrame, column: str, order: int, eos: bool = True, keep_empty: bool = False) -> DataFrame:
    """(context, token) at every position of every text; with ``keep_empty`` a text without
    positions gives one row with a null token.

    Positions are generated and read from the symbol array inside one generated-code
    stage, together with the partial count that follows; no array per position is made.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    width = order - 1
    history = computed_once(df, __h=_padded(characters(F.col(column)), order, eos))
    h, i = F.col("__h"), F.col("__i")
    last = F.size(h) - width
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    context = F.concat_ws(SEP, *[F.element_at(h, i + k) for k in range(width)]) if width else F.lit("")
    spread = F.explode_outer(at) if keep_empty else F.explode(at)
    return history.withColumn("__i", spread).select(
        *df.columns, context.alias("context"), F.element_at(h, i + width).alias("token")
    )


def ngram_counts(df: DataFrame, column: str, order: int) -> DataFrame:
    """Counts of (context, token). Equal n-grams are combined before the shuffle."""
    texts = df.select(tx.strip_ws(F.col(column)).alias("t")).filter(F.col("t") != "")
    return explode_ngrams(texts, "t", order).groupBy("context", "token").agg(F.count("*").alias("n"))


def context_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("context").agg(F.sum("n").alias("total"))


def context_maps(counts: DataFrame) -> DataFrame:
    """One row per context with its total and its token -> count map (bounded by the alphabet)."""
    return counts.groupBy("context").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "n")))).alias("nexts"),
    )


def lm_meta(counts: DataFrame, order: int, alpha: float) -> DataFrame:
    """Lines = ends of text; vocabulary = characters seen and the end symbol."""
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("token") == EOS, F.col("n"))), F.lit(0)).alias("lines"),
        F.count_distinct("token").alias("vocab_size"),
        F.lit(order).alias("order"),
        F.lit(alpha).alias("alpha"),
    )


def train(df: DataFrame, column: str, order: int = 3, alpha: float = 0.1, path: str | None = None) -> NgramModel:
    """Fits a model and keeps its tables below ``path`` (a new place in the shared folder by default)."""
    path = path or scratch_path(df.sparkSession, "lm")
    counts = ngram_counts(df, column, order)
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    counts = df.sparkSession.read.parquet(f"{path}/counts")
    _save(NgramModel(counts, context_maps(counts), lm_meta(counts, order, alpha), order, alpha), path)
    return load_lm(df.sparkSession, path)


def _save(model: NgramModel, path: str) -> None:
    model.maps.write.mode("overwrite").parquet(f"{path}/maps")
    model.meta.write.mode("overwrite").json(f"{path}/meta")


def save_lm(model: NgramModel, path: str) -> None:
    model.counts.write.mode("overwrite").parquet(f"{path}/counts")
    _save(model, path)


def load_lm(spark: SparkSession, path: str) -> NgramModel:
    schema = "lines bigint, vocab_size bigint, order int, alpha double"
    meta = spark.read.schema(schema).json(f"{path}/meta")
    row = meta.first()
    return NgramModel(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/maps"), meta, row["order"], row["alpha"])


def export_lm(model: NgramModel) -> DataFrame:
    """Interchange form: one JSON line per context."""
    return model.maps.select(
        F.to_json(F.struct("context", "total", F.col("nexts").alias("next"))).alias("value")
    )


def token_logprob(n: Column, total: Column, vocab_size: Column, alpha: float) -> Column:
    return F.log((F.coalesce(n, F.lit(0)) + alpha) / (F.coalesce(total, F.lit(0)) + vocab_size * alpha))


def _with_counts(positions: DataFrame, model: NgramModel) -> DataFrame:
    """Positions with (n, total) of the model, by one join on the context.

    The model's tables are files, so Spark knows their size: a small model is broadcast, a large one is joined by
    sort and merge, where adaptive execution splits frequent contexts.
    """
    return positions.join(model.maps, "context", "left").withColumn("n", F.try_element_at("nexts", F.col("token"))).drop("nexts")


def score_text(df: DataFrame, key: str, column: str, model: NgramModel, eos: bool = True) -> DataFrame:
    """Log probability of each text: sum over its positions, combined before the shuffle."""
    positions = explode_ngrams(df.select(key, column), column, model.order, eos, keep_empty=True)
    logp = token_logprob(F.col("n"), F.col("total"), model.vocab_size(), model.alpha)
    scored = _with_counts(positions.select(key, "context", "token"), model)
    return scored.groupBy(key).agg(
        F.sum(F.when(F.col("token").isNull(), 0.0).otherwise(logp)).alias("score")
    )


def score_extension(df: DataFrame, key: str, column: str, model: NgramModel) -> DataFrame:
    """Log probability of the last character of each text given those before it."""
    history = _padded(characters(F.col(column)), model.order, eos=False)
    width = model.order - 1
    tail = computed_once(df.select(key, F.col(column).alias("__t"), history.alias("__h")), __n=F.size("__h"))
    context = F.slice("__h", F.col("__n") - width, F.lit(width)) if width else F.array().cast("array<string>")
    # Null for the empty text, whose score is 0; its padding must not be read as a context.
    last = F.when(F.col("__t") != "", F.element_at("__h", -1))
    where = F.when(F.col("__t") != "", F.array_join(context, SEP))
    rows = tail.select(key, where.alias("context"), last.alias("token"))
    logp = token_logprob(F.col("n"), F.col("total"), model.vocab_size(), model.alpha)
    return _with_counts(rows, model).select(key, F.when(F.col("token").isNull(), 0.0).otherwise(logp).alias("score"))


# Log scores are summed in bands of this width, so that exp() neither overflows nor vanishes.
BAND = 64.0


def merge_nbest(hyps: DataFrame, k: int) -> DataFrame:
    """Hypotheses with equal tokens merged by log-sum-exp, the k best kept per utterance.

    Scores are first summed inside bands [64 b, 64 (b+1)): one map-side combined aggregate,
    however many copies there are. The few bands of a hypothesis are then put together
    relative to its highest one.
    """
    band = F.floor(F.col("log_prob") / BAND)
    parts = hyps.groupBy("utterance_id", "tokens", band.alias("band")).agg(
        F.sum(F.exp(F.col("log_prob") - band * BAND)).alias("s")
    )
    top = parts.groupBy("utterance_id", "tokens").agg(F.array_sort(F.collect_list(F.struct("band", "s"))).alias("xs"))
    peak = F.element_at("xs", -1)["band"]
    total = F.aggregate("xs", F.lit(0.0), lambda acc, x: acc + x["s"] * F.exp((x["band"] - peak) * BAND))
    merged = top.select("utterance_id", "tokens", (F.log(total) + peak * BAND).alias("log_prob"))
    best = Window.partitionBy("utterance_id").orderBy(F.desc("log_prob"), "tokens")
    return merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def best_hypothesis(merged: DataFrame) -> DataFrame:
    """Highest score per token."""
    score = F.col("log_prob") / F.greatest(F.size("tokens"), F.lit(1))
    best = F.max_by(F.struct("tokens", score.alias("score")), F.struct(score, F.col("tokens")))
    return merged.groupBy("utterance_id").agg(best.alias("b")).select("utterance_id", "b.tokens", "b.score")


def rescore_nbest(hyps: DataFrame, model: NgramModel, weight: float, bonus: float) -> DataFrame:
    """acoustic + weight * language model + bonus * length; the best text per utterance.

    Texts are scored once each, also where many utterances share them.
    """
    texts = hyps.select(F.col("text").alias("__text")).distinct().withColumn("__key", F.col("__text"))
    scores = score_text(texts, "__key", "__text", model, eos=False)
    joined = hyps.join(scores.withColumnRenamed("__key", "text"), "text")
    total = F.col("acoustic") + F.col("score") * weight + F.length("text") * bonus
    ranked = joined.withColumn("total", total)
    best = F.max_by(F.struct("text", "total"), F.struct("total", "text"))
    return ranked.groupBy("utterance_id").agg(best.alias("b")).select("utterance_id", "b.text", "b.total")
