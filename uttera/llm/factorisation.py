"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The pairwise term is worked out in time linear in a document's features by the sum-of-squares identity. The
model is fitted with AdaGrad on a bounded sample of labelled rows; every document is scored whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.llm.common import ASCII_LOWER, label_counts, labelled_sample, map_texts

WORD_BUCKETS = 1 << 12
BINS = 16
RANK = 8
#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 2000

_KINDS = {"lower": range(0x61, 0x7B), "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "wide": range(0x80, 0x100),
          "space": (0x20, 9, 10, 11, 12, 13), "stop": b".,;:!?'\"()-"}
_CLASS = np.full(256, len(_KINDS), np.uint8)
for _k, _members in enumerate(_KINDS.values()):
    _CLASS[list(_members)] = _k

STATISTICS = (
    "length words word_length distinct top_word adjacent lower upper digit wide space stop other lines line_repeats "
    "line_length long_words doubled_stops byte_kinds"
).split()
METADATA = ("declared_length", "declared_gap")
DIMENSION = WORD_BUCKETS + (len(STATISTICS) + len(METADATA)) * BINS


def _bin_share(x: float) -> int:
    """Bins of a share in [0, 1], finer towards 0."""
    return min(BINS - 1, int(BINS * x**0.5))


def _bin_size(x: float) -> int:
    """Bins of a count, by powers of two."""
    return min(BINS - 1, int(x + 1).bit_length())


def _statistics(text: bytes, words: list[bytes], counts: Counter) -> list[int]:
    n, n_words = max(1, len(text)), max(1, len(words))
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=len(_KINDS) + 1) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = len(b"".join(words))
    return [
        _bin_size(len(text)),
        _bin_size(len(words)),
        _bin_size(4 * letters / n_words),
        _bin_share(len(counts) / n_words),
        _bin_share(max(counts.values(), default=0) / n_words),
        _bin_share(sum(map(eq, words, words[1:])) / n_words),
        *(_bin_share(x) for x in kinds),
        _bin_size(len(lines)),
        _bin_share(1 - len(set(lines)) / max(1, len(lines))),
        _bin_size(len(text) / max(1, len(lines))),
        _bin_share(sum(1 for w in counts if len(w) > 20) / max(1, len(counts))),
        _bin_share(min(1.0, (text.count(b"!!") + text.count(b"..") + text.count(b"??")) / n_words)),
        _bin_size(len(set(text)) / 4),
    ]


def _metadata(text: bytes, declared: int | None) -> list[int]:
    """Bins of the length that the row declares and of its distance from the text's; bin 0 if it declares none."""
    if declared is None or declared < 0:
        return [0, 0]
    gap = abs(declared - len(text.decode()))
    return [max(1, _bin_size(declared)), max(1, _bin_size(gap))]


def features(text: bytes, declared: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(index, value): damped word counts of unit length, then a 1 in the bin of each statistic."""
    words = text.split()
    counts = Counter(words)
    bucket: dict[int, float] = {}
    for word, n in Counter(text.translate(ASCII_LOWER).split()).items():
        k = zlib.crc32(word) % WORD_BUCKETS
        bucket[k] = bucket.get(k, 0.0) + n
    index = np.fromiter(bucket, np.int64, len(bucket))
    value = np.sqrt(np.fromiter(bucket.values(), np.float64, len(bucket)))
    if len(value):
        value /= np.sqrt((value * value).sum())
    bins = np.array([*_statistics(text, words, counts), *_metadata(text, declared)])
    index = np.concatenate([index, WORD_BUCKETS + np.arange(len(bins)) * BINS + bins])
    return index, np.concatenate([value, np.full(len(bins), len(bins) ** -0.5)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        summed = value @ self.factors[index]
        squares = (value * value) @ (self.factors[index] ** 2)
        return float(self.bias + value @ self.weights[index] + 0.5 * (summed * summed - squares).sum())


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], prior: float, epochs: int = 12, batch: int = 64) -> Machine:
    """Fits on (label, index, value). ``prior`` is the share of label 1 among all labelled rows; the classes of
    the sample are weighted alike and the bias is moved to that share afterwards. With one class only, the
    model is that prior alone."""
    rng = np.random.default_rng(7)
    machine = Machine(0.0, np.zeros(DIMENSION), rng.normal(0, 0.02, (DIMENSION, RANK)))
    shift = float(np.log(prior / (1 - prior)))
    labels = np.array([r[0] for r in rows], np.float64)
    if len(set(labels)) < 2:
        machine.bias, machine.factors[:] = shift, 0
        return machine
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    g_bias, g_w, g_v = 1e-8, np.full(DIMENSION, 1e-8), np.full((DIMENSION, RANK), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            sizes = np.array([len(rows[k][1]) for k in part])
            index = np.concatenate([rows[k][1] for k in part])
            value = np.concatenate([rows[k][2] for k in part])[:, None]
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            vx = machine.factors[index] * value
            summed = np.add.reduceat(vx, starts)
            linear = np.add.reduceat(machine.weights[index] * value[:, 0], starts)
            logit = machine.bias + linear + 0.5 * (summed**2 - np.add.reduceat(vx * vx, starts)).sum(axis=1)
            slope = (_sigmoid(logit) - labels[part]) * weight[part] / len(part)
            per = np.repeat(slope, sizes)[:, None] * value
            grad_w = np.bincount(index, weights=per[:, 0], minlength=DIMENSION) + 1e-6 * machine.weights
            grad_v = np.zeros_like(machine.factors)
            np.add.at(grad_v, index, per * (np.repeat(summed, sizes, axis=0) - vx))
            grad_v += 1e-6 * machine.factors
            g_bias += slope.sum() ** 2
            g_w += grad_w**2
            g_v += grad_v**2
            machine.bias -= 0.3 * slope.sum() / g_bias**0.5
            machine.weights -= 0.3 * grad_w / np.sqrt(g_w)
            machine.factors -= 0.1 * grad_v / np.sqrt(g_v)
    machine.bias += shift
    return machine


def _declared(record: pa.StructArray, column: str | None) -> list:
    if column is None:
        return [None] * len(record)
    return record.flatten()[record.type.get_field_index(column)].to_pylist()


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", declared: str | None = "n_chars",
        per_class: int = PER_CLASS) -> Machine:
    """Model for the share of label 1. Features of the sampled rows (at most 2 * per_class rows of at most
    DIMENSION features) come to the driver, where the model is fitted."""
    n0, n1 = label_counts(labels, label)
    sample = labelled_sample(documents, labels, label, per_class, [declared] if declared else [])

    def make():
        def work(texts, record):
            pairs = [features(t, d) for t, d in zip(texts, _declared(record, declared), strict=True)]
            return [
                pa.array([p[0] for p in pairs], pa.list_(pa.int64())),
                pa.array([p[1] for p in pairs], pa.list_(pa.float64())),
            ]

        return work

    fields = [T.StructField("i", T.ArrayType(T.LongType())), T.StructField("x", T.ArrayType(T.DoubleType()))]
    made = map_texts(sample, make, fields).select("record.label", "record.doc_id", "i", "x")
    rows = sorted(((r["doc_id"], r["label"], np.array(r["i"]), np.array(r["x"])) for r in made.toLocalIterator()), key=lambda r: r[0])
    return train([r[1:] for r in rows], (n1 + 1) / (n0 + n1 + 2))


def score(documents: DataFrame, machine: Machine, text: str = "text", declared: str | None = "n_chars") -> DataFrame:
    """(record, score) per document: the probability of label 1, also for empty and null texts (their
    statistics alone). Repeated rows score alike; an empty table gives no rows. Nothing is shuffled."""
    def make():
        def work(texts, record):
            logits = [machine.logit(*features(t, d)) for t, d in zip(texts, _declared(record, declared), strict=True)]
            return [pa.array(_sigmoid(np.array(logits, np.float64)))]

        return work

    return map_texts(documents, make, [T.StructField("score", T.DoubleType())], text)
