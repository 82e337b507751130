"""What the operators share: reading tables, batches of texts, labelled samples, word tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_table(is_word: Callable[[int], bool]) -> bytes:
    """A ``bytes.translate`` table: A-Z lowered, every byte that is no part of a word a space."""
    lowered = (c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
    return bytes(c if is_word(c) else 0x20 for c in lowered)


# [0-9a-z] and all of UTF-8's bytes beyond ASCII.
ALNUM = word_table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80)


def record_of(df: DataFrame) -> DataFrame:
    """The input row as one struct ``record``, so that added columns can clash with none of its names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"))


def texts_in(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes], pa.StructArray], list[pa.Array]]],
    fields: list[T.StructField],
    text: str = "text",
) -> DataFrame:
    """Add columns worked out from batches of texts: (record, *fields), one row per input row.

    ``make`` is called once per task and returns a function from the UTF-8 texts of a batch (and its
    records) to Arrow arrays. Batches are bounded by Spark in rows and bytes.
    """
    at = df.columns.index(text)
    source = record_of(df)
    schema = T.StructType([source.schema["record"], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            record = batch.column(0)
            yield pa.RecordBatch.from_arrays([record, *work(texts_in(record.flatten()[at]), record)], names=names)

    return source.mapInArrow(run, schema)


def is_held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3 = 1; a null id is never held out and never has a label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, per_class: int, metadata: list[str] | None = None
) -> DataFrame:
    """Training rows (doc_id, label, text, *metadata): at most ``per_class`` of each class, never held-out ones.

    Which rows are taken depends on a hash of their id alone. An id with contradicting labels is left
    out; an id with several texts gives its smallest row. At most 2 * per_class ids are broadcast.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("__most"))
        .filter(F.col("label") == F.col("__most"))
        .select("doc_id", "label", F.xxhash64("doc_id").alias("__h"))
    )
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy("__h", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    return (
        documents.select("doc_id", F.struct("text", *(metadata or [])).alias("row"))
        .join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("row").alias("row"))
        .select("doc_id", "label", "row.*")
    )


def label_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """How many training ids carry label 0 and label 1."""
    row = (
        labels.filter(F.col(label).isin(0, 1) & ~is_held_out())
        .agg(F.count(F.when(F.col(label) == 0, 1)).alias("n0"), F.count(F.when(F.col(label) == 1, 1)).alias("n1"))
        .first()
    )
    return row["n0"], row["n1"]


def ragged(lists: list, kind: pa.DataType) -> pa.ListArray:
    """A list column from arrays or lists of numbers."""
    ends = np.cumsum([0, *(len(x) for x in lists)])
    flat = np.concatenate([np.asarray(x) for x in lists]) if len(lists) and ends[-1] else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind))


def opened(address: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of an address that executors share; Hadoop also writes local ones with a single slash."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", address))
