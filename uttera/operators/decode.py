"""Sequence decoding over a table of frames: prefix beam search and best-path alignment.

Frames are partitioned by utterance, sorted inside the partition and streamed in Arrow
batches. The search carries its state from batch to batch, so an utterance is never held
whole; alignment keeps one small row of back pointers per frame.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEG = -math.inf


def _by_utterance(frames: DataFrame, *order: str) -> DataFrame:
    return frames.repartition("utterance_id").sortWithinPartitions("utterance_id", *order)


class _Prefixes:
    """Prefix search over a trellis (Hannun et al. 2014): every kept prefix has two log masses, of paths that end in
    the blank and of paths that end in its last token. A frame moves all prefixes at once, as a matrix of prefixes
    by tokens."""

    def __init__(self, width: int, considered: int, blank: int, bonus: float, extend: Callable[[tuple], float] | None):
        self.width, self.considered, self.blank, self.bonus = width, considered, blank, bonus
        self.extend = extend or (lambda prefix: 0.0)
        self.words: list[tuple] = [()]
        self.mass = np.array([[0.0, NEG]])  # ending in the blank, ending in the last token
        self.language: dict[tuple, float] = {}

    def advance(self, scores: np.ndarray) -> None:
        heard = np.full(scores.size, NEG)
        strongest = np.argsort(-scores, kind="stable")[: self.considered]
        heard[strongest] = scores[strongest]
        whole = np.logaddexp(self.mass[:, 0], self.mass[:, 1])
        last = np.array([w[-1] if w else -1 for w in self.words])
        repeated = np.where(last >= 0, heard[last], NEG)
        moved = dict(zip(self.words, np.stack([whole + heard[self.blank], self.mass[:, 1] + repeated], axis=1), strict=True))
        # A token after itself is a new token only behind a blank.
        tokens = np.array([t for t in strongest if t != self.blank], np.int64)
        longer = np.where(last[:, None] == tokens, self.mass[:, :1], whole[:, None]) + heard[tokens]
        for row, column in np.argwhere(longer > NEG):
            word = (*self.words[row], int(tokens[column]))
            if word not in self.language:
                self.language[word] = self.extend(word)
            mass = moved.setdefault(word, np.array([NEG, NEG]))
            mass[1] = np.logaddexp(mass[1], longer[row, column] + self.language[word])
        ranked = sorted(moved, key=lambda w: (-self.value(w, moved[w]), w))[: self.width]
        self.words, self.mass = ranked, np.array([moved[w] for w in ranked])

    def value(self, word: tuple, mass: np.ndarray) -> float:
        return float(np.logaddexp(*mass)) + self.bonus * len(word)

    def best(self) -> tuple:
        return self.words[0]


def beam_decode(
    frames: DataFrame,
    tokens: list[str],
    width: int = 8,
    blank: int = 0,
    length_bonus: float = 0.0,
    scorer: Callable[[str], float] | None = None,
    lm_weight: float = 0.0,
    column: str = "log_probs",
    considered: int | None = None,
) -> DataFrame:
    """Best text per utterance. Equal scores are decided by the token ids.

    Of each frame the ``considered`` strongest tokens (the blank among them) can extend a prefix, four times
    ``width`` unless told otherwise; ``width`` prefixes are kept.
    """
    considered = considered or 4 * width
    kind = frames.schema["utterance_id"].dataType.simpleString()

    def text_of(prefix: tuple) -> str:
        return "".join(tokens[i] for i in prefix)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extend = None if scorer is None else (lambda prefix: lm_weight * float(scorer(text_of(prefix))))
        current, beam = None, None
        for part in parts:
            done = []
            for utt, scores in zip(part["utterance_id"], part[column]):
                if beam is None or utt != current:
                    if beam is not None:
                        done.append((current, text_of(beam.best())))
                    current, beam = utt, _Prefixes(width, considered, blank, length_bonus, extend)
                beam.advance(np.asarray(scores, np.float64))
            yield pd.DataFrame(done, columns=["utterance_id", "hyp"])
        if beam is not None:
            yield pd.DataFrame([(current, text_of(beam.best()))], columns=["utterance_id", "hyp"])

    ordered = _by_utterance(frames.select("utterance_id", "frame", column), "frame")
    return ordered.mapInPandas(run, f"utterance_id {kind}, hyp string")


class _Path:
    """Best path of one utterance through blank-interleaved tokens."""

    def __init__(self, ids: np.ndarray, blank: int):
        self.states = np.full(2 * len(ids) + 1, blank)
        self.states[1::2] = ids
        skip = np.zeros(len(self.states), bool)
        skip[2:] = (self.states[2:] != blank) & (self.states[2:] != self.states[:-2])
        self.skip = skip
        self.score: np.ndarray | None = None
        self.back: list[np.ndarray] = []

    def step(self, scores: np.ndarray) -> None:
        here = scores[self.states]
        if self.score is None:
            self.score = np.full(len(self.states), NEG)
            self.score[:2] = here[:2]
            self.back.append(np.zeros(len(self.states), np.int8))
            return
        old = self.score
        one = np.concatenate([[NEG], old[:-1]])
        two = np.where(self.skip, np.concatenate([[NEG, NEG], old])[: len(old)], NEG)
        moves = np.stack([old, one, two])
        move = moves.argmax(axis=0)
        self.score = moves[move, np.arange(len(old))] + here
        self.back.append(move.astype(np.int8))

    def labels(self) -> np.ndarray:
        at = len(self.states) - 1
        if at > 0 and self.score[at - 1] > self.score[at]:
            at -= 1
        path = np.empty(len(self.back), np.int64)
        for t in range(len(self.back) - 1, -1, -1):
            path[t] = at
            at -= int(self.back[t][at])
        return self.states[path]


def viterbi_align(frames: DataFrame, targets: DataFrame, blank: int = 0, column: str = "log_probs") -> DataFrame:
    """(utterance_id, frame, label) of the best alignment of each utterance's tokens.

    The tokens travel as one extra row in front of the frames, so nothing is joined.
    """
    kind = frames.schema["utterance_id"].dataType.simpleString()
    rows = frames.select("utterance_id", "frame", F.col(column).cast("array<double>").alias("x"))
    head = targets.select(
        "utterance_id", F.lit(-1).cast("bigint").alias("frame"), F.col("ids").cast("array<double>").alias("x")
    )

    def finish(utt, first, path: _Path) -> pd.DataFrame:
        labels = path.labels() if path.back else np.empty(0, np.int64)
        return pd.DataFrame(
            {"utterance_id": [utt] * len(labels), "frame": np.arange(first, first + len(labels)), "label": labels}
        )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, path = None, None
        for part in parts:
            for utt, frame, x in zip(part["utterance_id"], part["frame"], part["x"]):
                if path is None or utt != current:
                    if path is not None:
                        yield finish(current, 0, path)
                    ids = np.asarray(x, np.int64) if frame < 0 else np.empty(0, np.int64)
                    current, path = utt, _Path(ids, blank)
                    if frame < 0:
                        continue
                path.step(np.asarray(x, np.float64))
        if path is not None:
            yield finish(current, 0, path)

    both = rows.withColumn("frame", F.col("frame").cast("bigint")).unionByName(head)
    return _by_utterance(both, "frame").mapInPandas(run, f"utterance_id {kind}, frame bigint, label bigint")


# "package.module:name", with the argument of a factory behind a second colon.
SPEC = re.compile(r"(?P<place>[\w.]+:[\w.]+)(?::(?P<argument>.*))?", re.DOTALL)


def resolve_scorer(spec: str) -> Callable[[str], float]:
    """The scorer that a text names: a function from text to score, or what a factory makes of its argument."""
    parts = SPEC.fullmatch(spec)
    if not parts:
        raise ValueError(f"a scorer is named as module:name or module:factory:argument, not {spec!r}")
    made = pkgutil.resolve_name(parts["place"])
    stages = {"named object": made}
    if parts["argument"] is not None and callable(made):
        stages["factory's result"] = made = made(parts["argument"])
    for stage, thing in stages.items():
        if not callable(thing):
            raise TypeError(f"the {stage} of {spec!r} cannot be called with a text")
    return made


def scorer_column(spec: str, text: Column) -> Column:
    """Scores of a plug-in. It is resolved here once to fail early and once per task."""
    resolve_scorer(spec)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = resolve_scorer(spec)
        for batch in batches:
            yield batch.map(scorer).astype("float64")

    return score(text)
