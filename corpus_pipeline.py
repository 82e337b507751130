"""From raw documents to shards: quality, near-duplicates, contamination, source mix, shards.

In all stages null texts count as empty ones, and an empty table gives no rows. Stages one to four return the columns they
were given, whatever their names: a row travels as one struct beside the columns worked out for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttera.llm import factorisation, feistel, fm_index, mixing, simhash_ring
from uttera.llm.catalog import GOOD_FROM, SHARDS
from uttera.llm.common import table
from uttera.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rates below GOOD_FROM go. It is fitted on the input's own labels.

    Empty and null texts are rated by their statistics alone; repeated rows are rated alike and stay or go together.
    """
    machine = factorisation.fit(docs, table(spark, sf_dir, "labels"))
    return factorisation.score(docs, machine).filter(F.col("score") >= GOOD_FROM).select("record.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Documents without words share a fingerprint, so they are in one group. Of repeated rows and repeated ids of a group one row
    stays; a null id stays only where its group has no other.
    """
    return simhash_ring.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which test items cover a twentieth of the words or more go; the others stay as they are.

    Documents without words have no hit and stay. Repeated rows go together; an empty table of items removes nothing.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return fm_index.find_phrases(docs, items).filter(~fm_index.is_contaminated()).select("record.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the amounts of the mix: left out, once, or twice.

    Null sources are one source. Repeated rows are shuffled like any rows and keep places of their own.
    """
    return mixing.mix_documents(docs).select("record.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the columns ``shard`` and ``slot``, which replace columns of these names.

    Rows with equal ids, texts and sources share their places in any way.
    Column names that begin with two underscores are reserved.
    """
    return feistel.shard_rows(docs, [F.col("doc_id"), F.xxhash64("text", "source")], SHARDS)


STAGES = [
    ("factorisation_quality", quality),
    ("simhash_near_dedup", near_dedup),
    ("fm_index_decontamination", decontaminate),
    ("golden_ratio_mix", mix),
    ("feistel_shards", shard),
]

# The fitted classifier and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
