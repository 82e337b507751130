"""Times headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores;
BENCH_QUERIES may name other registered queries. Each query is run once to warm up and then
BENCH_RUNS times (default 3); the median is reported. Results are written to Spark's no-op
sink, so every row is produced and none is collected. The manifest and the usable records, from which
most queries start, are written once beforehand, so that a query's time is that of its operators.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from uttera.catalog import REGISTRY, views  # noqa: E402
from uttera.session import clear_scratch, local_session, scratch_path  # noqa: E402

HEADLINE = (
    "loader_summary normalize_transcript assign_split split_audit wer cer eval_rollup speaker_metrics "
    "batch_length_bucket batch_max_frames batch_duration batch_adaptive shard_rows ngram_counts score_lm "
    "char_vocab encode_chars ctc_frame_stats ctc_collapse ctc_segments mean_pool latest_features "
    "join_features merge_chunks redact_secrets dedup_transcripts blob_store"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = local_session("bench", cores)
    views.hold(spark, folder, scratch_path(spark, "bench"))
    times: dict[str, float] = {}
    for name in names:
        spent = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    clear_scratch(spark)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall_seconds", "value": total, "unit": "sec", "queries": times, "sf": folder}))


if __name__ == "__main__":
    main()
