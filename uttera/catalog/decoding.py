"""Search jobs over the posteriors table and plug-in scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttera.catalog import views as v
from uttera.catalog.base import query
from uttera.operators import ctc, decode

TOKENS = [""] + [chr(96 + i) for i in range(1, 64)]


@query("beam_decode")
def beam_decode(spark, folder):
    frames = ctc.log_softmax(v.frames(spark, folder))
    return decode.beam_decode(frames, TOKENS, width=4, length_bonus=0.1)


@query(
    "viterbi_align",
    v.sql("SELECT utterance_id, frame, (list_position(logits, list_max(logits)) - 1)::bigint AS label FROM frames", "frames"),
)
def viterbi_align(spark, folder):
    """Alignment of the greedy transcript: no path beats the frame-wise best labels."""
    frames = ctc.log_softmax(v.frames(spark, folder))
    tokens = ctc.ctc_tokens(ctc.with_argmax(v.frames(spark, folder)))
    targets = tokens.groupBy("utterance_id").agg(
        F.array_sort(F.collect_list(F.struct("frame", "label")))["label"].alias("ids")
    )
    return decode.viterbi_align(frames, targets)


@query("scorer_plugin", v.sql("SELECT row_index, -1.0::double * length(transcript) AS score FROM records", "records"))
def scorer_plugin(spark, folder):
    texts = v.records(spark, folder)
    score = decode.scorer_column("uttera.catalog.decoding:length_scorer:-1.0", F.col("transcript"))
    return texts.select("row_index", score.alias("score"))


def length_scorer(weight: str):
    """A plug-in factory: so many points per character."""
    factor = float(weight)
    return lambda text: factor * len(text)
