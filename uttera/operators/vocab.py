"""Character vocabularies and token arrays."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttera.operators.common import computed_once

BLANK = "<blank>"


def characters(c: Column) -> Column:
    """Code points of a text as an array; the empty text gives an empty array."""
    return F.array_remove(F.split(c, ""), "")


def char_vocab(df: DataFrame, column: str, min_count: int = 1) -> DataFrame:
    """(token, id): the blank is 0, then every character seen often enough, sorted.

    Characters are counted in parallel. Only the result, at most one row per code point of
    Unicode, is numbered by a window.
    """
    counts = (
        df.select(F.explode(characters(F.col(column))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )
    numbered = counts.select("token", F.row_number().over(Window.orderBy("token")).alias("id"))
    blank = counts.sparkSession.range(1).select(F.lit(BLANK).alias("token"), F.lit(0).alias("id"))
    return blank.unionByName(numbered)


def id_table(vocab: DataFrame) -> Column:
    """Array from code point (+1) to id. The vocabulary is a fitted artifact with at most one
    entry per code point of Unicode, so it is read by the driver and becomes a constant."""
    rows = vocab.filter(F.length("token") == 1).select(F.ascii("token").alias("cp"), "id").collect()
    table: list[int | None] = [None] * (max((r["cp"] for r in rows), default=0) + 1)
    for r in rows:
        table[r["cp"]] = r["id"]
    return F.from_json(F.lit(json.dumps(table)), "array<int>")


def encode_chars(df: DataFrame, column: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """Characters to ids; a row with unknown characters fails the job and names them."""
    table = id_table(vocab)
    listed = computed_once(df, __chars=characters(F.col(column)))
    coded = computed_once(
        listed, __ids=F.transform("__chars", lambda x: F.try_element_at(table, F.ascii(x) + 1))
    )
    known = ~F.exists("__ids", lambda x: x.isNull())
    unknown = F.array_distinct(
        F.filter(F.col("__chars"), lambda x: F.try_element_at(table, F.ascii(x) + 1).isNull())
    )
    fail = F.raise_error(F.concat(F.lit("characters not in the vocabulary: "), F.array_join(unknown, " ")))
    ids = F.when(known, F.col("__ids")).otherwise(fail.cast("array<int>"))
    return coded.withColumn(out, ids).drop("__chars", "__ids")


def unknown_chars(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """Report of characters a vocabulary does not know, with counts."""
    seen = (
        df.select(F.explode(characters(F.col(column))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    return seen.join(vocab.select("token"), "token", "left_anti")


def fill_token_lengths(df: DataFrame, column: str, known: str = "token_length") -> DataFrame:
    """Keep a stored length where there is one, else count the tokens; at least one."""
    counted = F.length(column).cast("bigint")
    value = F.when(F.coalesce(F.col(known), F.lit(0)) > 0, F.col(known)).otherwise(counted)
    return df.withColumn(known, F.greatest(value, F.lit(1)))


def vocab_match(left: DataFrame, right: DataFrame, kinds: tuple[str, str] = ("character", "character")) -> DataFrame:
    """Rows in which two vocabularies differ; empty means identical.

    ``kinds`` are their types. Vocabularies of different types never match, whatever their tokens: a row (null, null)
    for each side then tells its type as ``only_in``.
    """
    a = left.select("token", "id", F.lit(True).alias("in_left"))
    b = right.select("token", "id", F.lit(True).alias("in_right"))
    joined = a.join(b, ["token", "id"], "full_outer")
    differing = joined.filter(F.col("in_left").isNull() | F.col("in_right").isNull()).select(
        "token", "id", F.when(F.col("in_left").isNull(), "right").otherwise("left").alias("only_in")
    )
    if kinds[0] == kinds[1]:
        return differing
    types = [(None, None, f"{side}: {kind}") for side, kind in zip(("left", "right"), kinds)]
    return differing.unionByName(left.sparkSession.createDataFrame(types, differing.schema))


def label_tokens(df: DataFrame, vocab: DataFrame, token: str = "token_id", blank: int = 0) -> DataFrame:
    """Display text of token ids: decoded text, else the raw piece, else ``<id:n>``.

    ``vocab`` has (id, text) and optionally ``piece``; it stays an ordinary left join, so
    Spark broadcasts it only if its measured size allows.
    """
    names = vocab.select(
        F.col("id").alias(token),
        F.col("text").alias("__text"),
        (F.col("piece") if "piece" in vocab.columns else F.lit(None).cast("string")).alias("__piece"),
    )

    def shown(c: str) -> Column:
        return F.nullif(F.replace(F.col(c), F.lit("\n"), F.lit("\\n")), F.lit(""))

    fallback = F.concat(F.lit("<id:"), F.col(token).cast("string"), F.lit(">"))
    label = F.when(F.col(token) == blank, F.lit(BLANK)).otherwise(F.coalesce(shown("__text"), shown("__piece"), fallback))
    return df.join(names, token, "left").withColumn("label", label).drop("__text", "__piece")


# Entries of a vocabulary that become a constant of the plan, at most.
TABLE_ROWS = 1 << 20


def token_table(vocab: DataFrame) -> Column:
    """Constant array from id (+1) to token. A vocabulary is a fitted artifact of bounded size; a table of more
    than TABLE_ROWS rows is refused, not cut."""
    rows = vocab.select("token", "id").limit(TABLE_ROWS + 1).collect()
    if len(rows) > TABLE_ROWS or any(not 0 <= r["id"] <= TABLE_ROWS for r in rows):
        raise ValueError(f"a vocabulary has at most {TABLE_ROWS} entries with ids from 0")
    table: list[str | None] = [None] * (max((r["id"] for r in rows), default=0) + 1)
    for r in rows:
        table[r["id"]] = r["token"]
    return F.from_json(F.lit(json.dumps(table)), "array<string>")


def decode_ids(ids: Column, vocab: DataFrame, blank: int = 0) -> Column:
    """Ids to text. The blank is left out; an id that the vocabulary does not have fails the job."""
    table = token_table(vocab)

    def token(x: Column) -> Column:
        told = F.concat(F.lit("id not in the vocabulary: "), F.coalesce(x.cast("string"), F.lit("null")))
        found = F.when(x >= 0, F.try_element_at(table, (x + 1).cast("int")))
        return F.coalesce(found, F.raise_error(told).cast("string"))

    spoken = F.filter(ids, lambda x: F.coalesce(x != blank, F.lit(True)))
    return F.array_join(F.transform(spoken, token), "")
