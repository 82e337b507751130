"""Evaluation from end to end: pairs -> edits -> rates, buckets, speakers, examples."""

from __future__ import annotations

from pyspark.sql import DataFrame

from uttera.operators import metrics, ranking
from uttera.session import cut_lineage
from uttera.sources import records


def evaluate(
    refs: DataFrame, hyps: DataFrame, out: str | None = None, examples: int = 25, split: str = "validation",
    epoch: int = 0, step: int = 0,
) -> dict[str, DataFrame]:
    """``refs`` has utterance_id, speaker_id, has_speaker_id and ref; ``hyps`` utterance_id, hyp.

    Every id must occur once on either side. A null text counts as empty: a missing hypothesis loses all words.

    Edit distances are the costly part: they are counted once, kept on a reliable
    checkpoint, and all reports are sums over that table.
    """
    paired = metrics.pair_ref_hyp(
        refs.select("utterance_id", "ref", "speaker_id", "has_speaker_id"), hyps.select("utterance_id", "hyp")
    )
    edits = cut_lineage(metrics.with_edits(paired))
    reports = {
        "rollup": metrics.eval_rollup(edits),
        "buckets": metrics.bucket_metrics(edits),
        "speakers": metrics.speaker_metrics(edits),
        "speaker_summary": metrics.speaker_summary(edits),
        "decoding": metrics.decode_debug(edits),
        "examples": ranking.examples_table(edits, examples, 13, split, epoch, step),
    }
    if out:
        for name, report in reports.items():
            records.write_report(report, f"{out}/{name}")
    return reports
