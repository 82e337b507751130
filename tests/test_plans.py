"""What the plans must and must not contain."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from uttera.catalog import REGISTRY

# Queries that run Python in the tasks, by design.
PYTHON = {
    "beam_decode", "viterbi_align", "scorer_plugin", "decode_wav", "log_mel", "fbank_stacked", "augment_waveform",
    "extract_features", "stream_alert", "stream_warm", "unigram_vocab", "batch_max_frames", "batch_duration",
    "batch_adaptive", "batch_adaptive_frames", "assign_batch", "batch_plan", "feature_payload", "redact_json", "redact_json_values",
}


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["loader_summary", "wer", "ngram_counts", "ctc_segments", "latest_features", "merge_chunks", "score_lm", "epoch_shuffle", "char_vocab", "encode_chars"])
def test_no_python_in_the_plan(spark, folder, name):
    assert name not in PYTHON
    plan = plan_of(REGISTRY[name].run(spark, folder))
    assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_cross_join(spark, folder, name):
    if name.startswith("stream_") or name in ("subword_vocab", "unigram_vocab", "extract_features", "upsert_features"):
        pytest.skip("runs whole jobs while it is built")
    plan = plan_of(REGISTRY[name].run(spark, folder))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, folder):
    plan = plan_of(REGISTRY["latest_features"].run(spark, folder))
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "props" not in schema and "ts" not in schema
    held = spark.read.parquet(f"{folder}/lineitem.parquet").filter(F.col("l_quantity") > 49).select("l_orderkey")
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in plan_of(held)


def test_driver_contract(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 130
    assert entry.entry(spark).count() > 0


def test_entry_works_without_the_training_data_part():
    """The package may be shipped without uttera.llm and corpus_pipeline."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; "
        "assert len(e.queries()) > 130 and set(e.oracle_sql()) <= set(e.queries()); assert 'pipeline' not in e.queries()"
    )
    for gone in ("uttera.llm", "corpus_pipeline"):
        subprocess.run([sys.executable, "-c", code.format(gone=gone)], check=True, cwd=Path(__file__).parent.parent)


def test_bytes_are_not_sorted_where_blobs_are_deduplicated(spark, folder):
    from uttera.operators import blobs

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = blobs.dedupe_blobs(docs, "text", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
