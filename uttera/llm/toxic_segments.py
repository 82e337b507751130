"""Toxicity by maximum-scoring segments.

Every token has a log-odds score: how much likelier it is in toxic than in clean text, with an informative Dirichlet
prior taken from the whole corpus. All tokens without evidence share one negative score. One linear scan finds
all maximal scoring segments of a document (Ruzzo and Tompa 1999). Scores of such segments follow an extreme-value law
(Karlin and Altschul 1990), by which each segment gets its expected number of chance occurrences in clean text of the
same length. A document's evidence is the sum over its significant segments; a logistic curve fitted on the
sample turns it into a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.llm.common import ALNUM, label_counts, labelled_sample, map_texts

#: Labelled rows of each class that the scores are fitted on, at most.
PER_CLASS = 2000
#: z-score and size of the log-odds from which a word is evidence.
MIN_Z, MIN_ODDS = 3.0, 2.0
#: Weight of the corpus prior, as a share of the sample's words.
PRIOR_SHARE = 0.2
#: Segments with at most so many expected chance occurrences in a clean text of that length are significant.
MAX_EXPECTED = 0.05


@dataclass
class Lexicon:
    scores: dict[bytes, float]  # of the words with evidence
    other: float  # of every other word, negative
    decay: float  # lambda of the extreme-value law
    level: float  # log K of the extreme-value law
    slope: float
    intercept: float


def tokens(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def segments(words: list[bytes], lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in words, in one scan.

    Between two words with positive scores the sums fall in a straight line or by negative scores, so only
    the words of the lexicon are visited.
    """
    known = lexicon.scores
    if known.keys().isdisjoint(words):
        return []
    total, after = 0.0, 0  # sum of the scores of the words before position ``after``
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sums before and behind, link
    for at, word in enumerate(words):
        score = known.get(word)
        if score is None:
            continue
        total += (at - after) * lexicon.other
        before, total, after = total, total + score, at + 1
        if score <= 0:
            continue
        start, left, right = at, before, total
        while True:
            # The nearest segment that begins at a smaller sum; a link skips those that begin higher.
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k = found[k][4]
            if k < 0 or found[k][3] >= right:
                found.append((start, at + 1, left, right, k))
                break
            start, left = found[k][0], found[k][2]
            del found[k:]
    return [(s, e, right - left) for s, e, left, right, _ in found]


def significant(words: list[bytes], lexicon: Lexicon) -> list[tuple[int, int, float, float]]:
    """(start, end, score, expected chance occurrences) of the significant segments."""
    size = np.log(max(1, len(words)))
    rated = [(s, e, x, float(np.exp(min(50.0, lexicon.level + size - lexicon.decay * x)))) for s, e, x in segments(words, lexicon)]
    return [r for r in rated if r[3] <= MAX_EXPECTED]


def evidence(found: list[tuple[int, int, float, float]]) -> float:
    """Summed -log of the expected chance occurrences, over significant segments."""
    return float(sum(-np.log(max(r[3], 1e-300)) for r in found))


def probability(x: float, lexicon: Lexicon) -> float:
    return float(1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.intercept, -30, 30))))


def _log_odds(toxic: Counter, clean: Counter, prior: dict[bytes, float], strength: float) -> dict[bytes, tuple[float, float]]:
    """(log-odds difference, z-score) of each word of ``prior`` (its share of the corpus)."""
    n1, n0 = sum(toxic.values()), sum(clean.values())
    out = {}
    for word, share in prior.items():
        a = max(share * strength, 0.01)
        y1, y0 = toxic[word] + a, clean[word] + a
        d = np.log(y1 / (n1 + strength - y1)) - np.log(y0 / (n0 + strength - y0))
        out[word] = (float(d), float(d / np.sqrt(1 / y1 + 1 / y0)))
    return out


def _sketch(words: list[bytes]) -> tuple[int, ...]:
    """Three minimum hashes of the three-word shingles; near copies mostly share them, other texts hardly ever do."""
    shingles = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    hashes = np.array([zlib.crc32(x) for x in shingles], np.uint64)
    return tuple(int(((hashes * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in (1, 2654435769, 2246822519))


def corpus_counts(documents: DataFrame, words: list[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents of the whole corpus each of the words occurs, and the sum of that over all words.

    Each task sends one row per word found, so what is shuffled does not grow with the texts.
    """
    wanted = frozenset(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                parts = set(tokens(t or b""))
                total += len(parts)
                seen.update(wanted & parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b"", *seen], pa.binary()), pa.array([total, *seen.values()], pa.int64())], names=["word", "n"]
        )

    counted = documents.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r["word"]): r["n"] for r in counted.collect()}  # at most one row per wanted word
    return found, found.pop(b"", 0)


def _decay(shares: np.ndarray, scores: np.ndarray) -> float:
    """The positive solution of sum(share * exp(decay * score)) = 1, by bisection."""
    low, high = 0.0, 1.0
    f = lambda x: float((shares * np.exp(np.minimum(x * scores, 500))).sum())
    while f(high) < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept with a slight pull to zero, by Newton steps."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-2 * beta
        hessian = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Lexicon:
    """Scores from at most ``per_class`` labelled rows of each class and from the counts of the whole corpus.

    With one class only (or no labels) no word is evidence and every document gets the share of label 1.
    The sampled texts come to the driver; the model, words of the toxic sample at most, is sent to the tasks.
    """
    n0, n1 = label_counts(labels, label)
    prior = (n1 + 1) / (n0 + n1 + 2)
    odds = float(np.log(prior / (1 - prior)))
    sample = labelled_sample(documents, labels, label, per_class)
    counts, sizes, bags = [Counter(), Counter()], [0, 0], []
    for row in sample.toLocalIterator():
        bags.append((row["doc_id"], row["label"], (row["text"] or "").encode()))
    bags.sort(key=lambda b: b[0])
    seen = set()
    for _, y, text in bags:
        sizes[y] += 1
        # Counted by document, and near copies once, so that neither a long text nor a copied one makes evidence.
        words = tokens(text)
        if (mark := (y, _sketch(words))) not in seen:
            seen.add(mark)
            counts[y].update(set(words))
    nothing = Lexicon({}, -1.0, 1.0, 0.0, 0.0, odds)
    if not all(sizes):
        return nothing
    # Words that the sample alone makes likely evidence; the corpus then gives their prior.
    both = sum(counts[0].values()) + sum(counts[1].values())
    rough = _log_odds(counts[1], counts[0], {w: (counts[0][w] + counts[1][w]) / both for w in counts[1]}, PRIOR_SHARE * both)
    wanted = [w for w, (d, z) in rough.items() if z >= MIN_Z / 2 and d > 0]
    in_corpus, total = corpus_counts(documents, wanted)
    rated = _log_odds(counts[1], counts[0], {w: in_corpus.get(w, 0) / max(1, total) for w in wanted}, PRIOR_SHARE * both)
    scores = {w: d for w, (d, z) in rated.items() if z >= MIN_Z and d >= MIN_ODDS}
    if not scores:
        return nothing
    mass = [(sum(c[w] for w in scores) + 0.5) / (sum(c.values()) + 1) for c in counts]
    other = float(min(np.log1p(-min(mass[1], 0.999)) - np.log1p(-min(mass[0], 0.999)), -1e-4))
    n = sum(counts[0].values())
    shares = np.array([(counts[0][w] + 0.5 / len(scores)) / (n + 1) for w in scores] + [1 - mass[0]])
    values = np.array([*scores.values(), other])
    lexicon = Lexicon(scores, other, _decay(shares, values), 0.0, 1.0, 0.0)
    # log K: in clean texts of n words the expected number of segments above x is K n exp(-decay x).
    clean = [tokens(t) for _, y, t in bags if y == 0]
    best = [(len(w), max((x for *_, x in segments(w, lexicon)), default=0.0)) for w in clean if w]
    hits = [np.exp(min(50.0, lexicon.decay * x)) / m for m, x in best if x > 0]
    hits = sorted(hits)[: len(hits) - len(hits) // 100]  # without the largest hundredth
    lexicon.level = float(np.clip(np.log((sum(hits) + 1e-6) / max(1, len(best))), -12.0, 0.0))
    x = np.array([evidence(significant(tokens(t), lexicon)) for _, _, t in bags])
    y = np.array([b[1] for b in bags], np.float64)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    lexicon.slope, lexicon.intercept = _logistic(x, y, weight)
    return lexicon


def score(documents: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """(record, score, passages) per document: the probability of label 1 and the significant passages as a list of
    structs (start, end in words, end exclusive; score; expected chance occurrences).

    Empty and null texts have no passage and the score of a text without evidence. Repeated rows score alike;
    an empty table gives no rows. Nothing is shuffled.
    """
    passage = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType()),
    ])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def make():
        def work(texts, _):
            found = [significant(tokens(t), lexicon) for t in texts]
            rows = [[dict(zip(("start", "end", "score", "expected"), f, strict=True)) for f in fs] for fs in found]
            return [pa.array([probability(evidence(f), lexicon) for f in found], pa.float64()), pa.array(rows, arrow)]

        return work

    return map_texts(documents, make, [T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(passage))], text)
