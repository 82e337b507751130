"""Manifests: discovery, TSV and Parquet scans, unions, stable row numbers, text corpora."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.functions import text
from uttera.operators import quality
from uttera.session import cut_lineage
from uttera.sources import files, tsv


HEADERS_AT_ONCE = 32


def discover(spark: SparkSession, root: str) -> list[str]:
    """Manifest files below a root, sorted. Where there is any TSV, Parquet is ignored."""
    found = files.list_files(spark, root)
    tables = [p for p in found if p.lower().endswith(".tsv")]
    return tables or [p for p in found if p.lower().endswith(".parquet")]


def read_tsv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tab-separated files with a header, every column as text.

    Files may differ in their columns: files with equal headers form one scan, and the
    scans are joined by name.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = [p for root in paths for p in files.list_files(spark, root)]
    scans = []
    for header, members in _by_header(spark, found).items():
        names = tsv.header_names(header)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        scans.append(
            spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", '"')
            .option("escape", '"').option("enforceSchema", True).csv(members)
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def _by_header(spark: SparkSession, found: list[str]) -> dict[str, list[str]]:
    """Files by their first line, in their order. Tasks open the files; a store that only Spark's own readers know is asked from
    here, many files at a time, as a line each waits for the store and not for this machine."""
    groups: dict[str, list[str]] = {}
    if found and files.tasks_can_open(found[0]):
        headers = tsv.headers(spark, found)
    else:
        with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
            headers = list(pool.map(lambda p: files.first_line(spark, p), found))
    for path, header in zip(found, headers, strict=True):
        groups.setdefault(header, []).append(path)
    return groups


def read_mixed_tsv(spark: SparkSession, roots: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Tab-separated files of any headers in one scan, every column as text; see sources.tsv.

    ``columns`` are those of the result; without them they are the columns of all files, in the order of first sight.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    if columns is None:
        found = [p for root in roots for p in files.list_files(spark, root)]
        columns = list(dict.fromkeys(n for header in _by_header(spark, found) for n in tsv.header_names(header)))
    return tsv.register(spark).read.format(tsv.NAME).schema(tsv.schema_of(columns)).option("roots", json.dumps(roots)).load()


def stream_tsv(spark: SparkSession, root: str, columns: list[str], log: str) -> DataFrame:
    """New files below ``root`` as a stream of the given columns, whatever the headers of the files; see sources.tsv.

    ``log`` is a folder of this stream's own, beside its checkpoint, that tells which files belong to which step.
    """
    source = tsv.register(spark).readStream.format(tsv.NAME).schema(tsv.schema_of(columns))
    return source.option("roots", json.dumps([root])).option("log", log).load()


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated files that read_tsv reads back as they are: nulls, empty texts and outer blanks stay apart."""
    (
        df.write.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_parquet(spark: SparkSession, paths: str | list[str], merge: bool = True) -> DataFrame:
    """Parquet manifests; optional columns of single files are merged into one schema. Without ``merge`` one footer
    tells the schema of all files, which saves reading the others."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.option("mergeSchema", merge).option("recursiveFileLookup", True).parquet(*paths)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    found = discover(spark, root)
    if not found:
        raise FileNotFoundError(f"no TSV or Parquet manifest below {root}")
    return read_tsv(spark, found) if found[0].lower().endswith(".tsv") else read_parquet(spark, found)


def union_sources(frames: list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """Several sources in order (``source_ord``); a source named twice counts once."""
    names = names or [str(i) for i in range(len(frames))]
    unique = dict(reversed(list(zip(names, frames))))
    ordered = [(i, n, unique[n]) for i, n in enumerate(dict.fromkeys(names))]
    parts = [df.withColumn("source_ord", F.lit(i)).withColumn("source", F.lit(n)) for i, n, df in ordered]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_row_index(df: DataFrame, out: str = "row_index") -> DataFrame:
    """Dense 0-based row number in file order for a DataFrame read from files.

    Parquet tells the row's number in its file, so only the files' sizes (from a scan that reads no column) are summed
    up. Other formats are numbered by block, see _by_block. Rows are neither sorted nor numbered twice.
    """
    try:
        marked = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return _by_block(df, out)
    sizes = df.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # over files
    starts = sizes.select("__file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__skip"))
    return marked.join(starts, "__file").withColumn(out, F.col("__at") + F.col("__skip")).drop("__file", "__at", "__skip")


def _by_block(df: DataFrame, out: str) -> DataFrame:
    """A file block is read by one task, in order, so the running id of the scan gives the place inside the
    block. Block sizes are one small row per block; their prefix sum gives each block its start."""
    marked = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
    )
    blocks = cut_lineage(marked.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__id").alias("__first")))
    in_file = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    over_files = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    per_file = blocks.groupBy("__file").agg(F.sum("__n").alias("__rows")).select(
        "__file", F.coalesce(F.sum("__rows").over(over_files), F.lit(0)).alias("__skip")
    )
    starts = blocks.withColumn("__inner", F.coalesce(F.sum("__n").over(in_file), F.lit(0))).join(per_file, "__file")
    starts = starts.select("__file", "__start", (F.col("__skip") + F.col("__inner") - F.col("__first")).alias("__shift"))
    return (
        marked.join(starts, ["__file", "__start"])
        .withColumn(out, F.col("__id") + F.col("__shift"))
        .drop("__file", "__start", "__id", "__shift")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text corpus, one stripped non-blank line per row."""
    stripped = text.strip_ws(F.col("value"))
    return spark.read.text(path).select(stripped.alias("text")).filter(F.col("text") != "")


def corpus_texts(
    df: DataFrame, dedup: bool = False, n: int | None = None, lowercase: bool = True, order: str = "row_index"
) -> DataFrame:
    """Normalised transcripts; duplicates keep their first position, then an ordered cap."""
    raw: Column = quality.pick_transcript(df)
    texts = df.select(F.col(order), raw.alias("__raw")).filter(F.col("__raw").isNotNull())
    texts = texts.select(order, text.normalize_transcript(F.col("__raw"), lowercase).alias("text"))
    if dedup:
        texts = dedup_transcripts(texts, "text", order)
    return texts.orderBy(order).limit(n) if n is not None else texts


def dedup_transcripts(df: DataFrame, column: str = "text", order: str = "row_index") -> DataFrame:
    """First occurrence of each text; copies are combined before the shuffle."""
    return df.groupBy(column).agg(F.min(order).alias(order))
