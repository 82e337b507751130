"""Subword vocabularies from a corpus: word, char, bpe and unigram.

The corpus is read once and reduced to distinct words with counts. All later rounds work on
that table, whose size follows the vocabulary of the language and not the corpus. A round is
a distributed count; only the winning pair (one row) or the pieces of the vocabulary, whose
number is a parameter, come back to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.functions import text as tx
from uttera.functions.arrays import log_add
from uttera.operators.common import computed_once
from uttera.operators.vocab import characters
from uttera.session import cut_lineage, scratch_path

# Control characters that frame each symbol of a word, so that one literal replace merges
# every non-overlapping occurrence of a pair from left to right.
OPEN, CLOSE = "\x01", "\x02"
# Merges after which the words are written anew.
WRITE_EVERY = 20


def word_counts(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(tx.words(F.col(column))).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")
    )


def _top(pieces: DataFrame, size: int) -> DataFrame:
    return pieces.orderBy(F.desc("n"), "piece").limit(size)


def _letters(words: DataFrame) -> DataFrame:
    return words.select(F.explode(characters(F.col("word"))).alias("piece"), "n").groupBy("piece").agg(
        F.sum("n").alias("n")
    )


def _symbols(framed: Column) -> Column:
    inner = F.substring(framed, F.lit(2), F.length(framed) - 2)
    return F.split(inner, CLOSE + OPEN)


def _framed(word: Column) -> Column:
    parts = F.transform(characters(word), lambda x: F.concat(F.lit(OPEN), x, F.lit(CLOSE)))
    return F.array_join(parts, "")


def _pair_rows(words: DataFrame) -> DataFrame:
    """(a, b, n) for every neighbouring symbol pair of every word, repeats included."""
    listed = words.select(_symbols(F.col("framed")).alias("s"), "n").filter(F.size("s") > 1)
    pairs = F.arrays_zip(
        F.slice("s", F.lit(1), F.size("s") - 1).alias("a"), F.slice("s", F.lit(2), F.size("s") - 1).alias("b")
    )
    return listed.select(F.explode(pairs).alias("p"), "n").select("p.a", "p.b", "n")


def pair_counts(words: DataFrame) -> DataFrame:
    """Neighbouring symbol pairs over all words, weighted by the word counts."""
    return _pair_rows(words).groupBy("a", "b").agg(F.sum("n").alias("n"))


def _merged(framed: Column, merges: list[tuple[str, str, int]]) -> Column:
    for a, b, _ in merges:
        framed = F.replace(framed, F.lit(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}"), F.lit(f"{OPEN}{a}{b}{CLOSE}"))
    return framed


def pair_changes(words: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """(a, b, n): what pairs gain and lose by the merges. Only words that hold a merged pair are taken apart."""
    both = computed_once(words, __after=_merged(F.col("framed"), merges)).filter(F.col("__after") != F.col("framed"))
    after = F.struct(F.col("__after").alias("framed"), F.col("n").alias("n"))
    before = F.struct(F.col("framed").alias("framed"), (-F.col("n")).alias("n"))
    return _pair_rows(both.select(F.inline(F.array(after, before))))


def _certain(top: list[tuple[str, str, int]], known: set[str], floor: int, limit: int) -> list[tuple[str, str, int]]:
    """The leading pairs whose order one-at-a-time merging could not change.

    ``top`` holds the most frequent pairs in order; any other pair counts at most ``floor``.
    After merging (a, b), pairs with a or b can only lose, and a new pair with "ab" cannot
    count more than the pair (x, a) or (b, y) it grew from. So the next pair is certain if
    it shares no symbol with those accepted and counts more than every such new pair.
    """
    sure: list[tuple[str, str, int]] = []
    used: set[str] = set()
    bound = floor - 1
    for a, b, n in top[:limit]:
        if a in used or b in used or (sure and (n <= bound or a + b in known)):
            break
        sure.append((a, b, n))
        used |= {a, b}
        grown = [m for x, y, m in top if y == a or x == b]
        bound = max([bound, floor, *grown])
        if a + b in known:
            break
    return sure


def bpe_merges(words: DataFrame, merges: int, ahead: int = 500) -> tuple[list[tuple[str, str, int]], DataFrame]:
    """The merge list in order, and the word table after it. Ties: smallest pair first.

    Words are read at a round, and counted only where its merges changed them: pair counts are a written table, to which the
    changes of every round are added. One look at the counts serves as many merges as are certain from it.
    """
    table = _written(words.select(_framed(F.col("word")).alias("framed"), F.col("n").cast("bigint").alias("n")), "words")
    counts = _written(pair_counts(table), "pairs")
    done: list[tuple[str, str, int]] = []
    known: set[str] = set()
    pending: list[tuple[str, str, int]] = []
    while len(done) < merges:
        rows = counts.orderBy(F.desc("n"), "a", "b").limit(ahead).collect()
        if not rows:
            break
        top = [(r["a"], r["b"], int(r["n"])) for r in rows]
        known |= {x for pair in top for x in pair[:2]}
        floor = top[-1][2] if len(top) == ahead else 0
        sure = _certain(top, known, floor, merges - len(done))
        known |= {a + b for a, b, _ in sure}
        done += sure
        if len(done) < merges:
            counts = _written(_changed_counts(counts, _up_to_date(table, pending), sure), "pairs")
        pending += sure
        if len(pending) >= WRITE_EVERY:
            table, pending = _written(_up_to_date(table, pending), "words"), []
    return done, _up_to_date(table, pending)


def _up_to_date(table: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """The words after merges that the written table lacks."""
    return computed_once(table.select(F.col("framed").alias("__old"), "n"), framed=_merged(F.col("__old"), merges)).select("framed", "n")


def _changed_counts(counts: DataFrame, words: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    if not merges:
        return counts
    both = counts.unionByName(pair_changes(words, merges))
    return both.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"bpe-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bpe(words: DataFrame, size: int, ahead: int) -> DataFrame:
    """All letters plus merged pieces, with the count each piece had when it was made."""
    words = _written(words, "counted")
    letters = cut_lineage(_letters(words))
    merges = max(0, size - letters.count())
    made, _ = bpe_merges(words, merges, ahead)
    every = letters.withColumn("rank", F.lit(-1))
    if not made:
        return every
    rows = [(i, a + b, n) for i, (a, b, n) in enumerate(made)]
    merged = words.sparkSession.createDataFrame(rows, "rank int, piece string, n bigint")
    return every.unionByName(merged).select("piece", "n", "rank")


# --- unigram model --------------------------------------------------------------------


# Words longer than this, and words of a probability below the other bound, are worked out in logarithms, one by one.
LONG, LEAST = 200, 1e-200


class _Pieces:
    """A model in arrays: edges of the tree of all pieces, ordered by (node, character), and the pieces at its nodes."""

    def __init__(self, logp: dict[str, float], longest: int):
        self.logp, self.longest, self.names = logp, longest, list(logp)
        self.letters = np.array(sorted({ord(c) for piece in logp for c in piece}), "u4")
        at = {int(c): i for i, c in enumerate(self.letters)}
        edges: dict[int, int] = {}
        ends = [-1]
        for i, piece in enumerate(self.names):
            node = 0
            for c in piece:
                edge = node * len(at) + at[ord(c)]
                if edge not in edges:
                    edges[edge] = len(ends)
                    ends.append(-1)
                node = edges[edge]
            ends[node] = i
        self.edges = np.array(sorted(edges), "i8")
        self.nodes = np.array([edges[int(e)] for e in self.edges], "i8")
        self.ends = np.array(ends, "i8")
        self.p = np.exp(np.array([logp[name] for name in self.names]))

    def spans(self, words: list[str], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, pieces, probabilities) for every length: arrays by start and word, -1 and 0 where there is no piece."""
        codes = np.ascontiguousarray(np.array(words, f"<U{size}").view("<u4").reshape(len(words), size).T)
        letters = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        letters[self.letters[letters] != codes] = -1
        nodes = np.zeros(codes.shape, "i8")
        for length in range(1, min(size, self.longest) + 1):
            nodes, last = nodes[: size - length + 1], letters[length - 1 :]
            alive = np.nonzero((nodes >= 0) & (last >= 0))
            wanted = nodes[alive] * len(self.letters) + last[alive]
            found = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            nodes = np.full(nodes.shape, -1, "i8")
            nodes[alive] = np.where(self.edges[found] == wanted, self.nodes[found], -1)
            pieces = np.where(nodes >= 0, self.ends[nodes], -1)
            yield length, pieces, np.where(pieces >= 0, self.p[pieces], 0.0)

    def add(self, words: list[str], n: np.ndarray, sums: np.ndarray) -> list[int]:
        """Adds the expected counts of words of one length to ``sums``; returns the places of words of too small a probability."""
        size, many = len(words[0]), len(words)
        spans = list(self.spans(words, size))
        head, tail = np.zeros((size + 1, many)), np.zeros((size + 1, many))
        head[0] = tail[size] = 1.0
        for j in range(1, size + 1):
            for length, _, p in spans[:j]:
                head[j] += head[j - length] * p[j - length]
        for i in range(size - 1, -1, -1):
            for length, _, p in spans[: size - i]:
                tail[i] += p[i] * tail[i + length]
        fine = head[size] >= LEAST
        share = np.where(fine, n / np.where(fine, head[size], 1.0), 0.0)
        for length, pieces, p in spans:
            there = np.nonzero(pieces >= 0)
            expected = (head[: size - length + 1] * p * tail[length:] * share)[there]
            sums += np.bincount(pieces[there], expected, len(sums))
        return np.nonzero(~fine)[0].tolist()

    def add_by_logs(self, word: str, n: float, place: dict[str, int], sums: np.ndarray) -> None:
        size = len(word)
        spans = []
        head, tail = [-math.inf] * (size + 1), [-math.inf] * (size + 1)
        head[0] = tail[size] = 0.0
        for i in range(size):
            for j in range(i + 1, min(size, i + self.longest) + 1):
                p = self.logp.get(word[i:j])
                if p is not None:
                    spans.append((i, j, p))
                    head[j] = log_add(head[j], head[i] + p)
        if head[size] == -math.inf:
            return
        for i, j, p in reversed(spans):
            tail[i] = log_add(tail[i], p + tail[j])
        for i, j, p in spans:
            sums[place[word[i:j]]] += n * math.exp(head[i] + p + tail[j] - head[size])


def _expected_counts(logp: dict[str, float], longest: int):
    """Expected piece counts of one batch of words under the current model.

    For each word the probabilities of all prefixes and suffixes are summed over its
    segmentations; a piece at [i, j) is then expected prefix(i) * p * suffix(j) / total times.
    Words of one length are worked out together.
    """
    model = _Pieces(logp, longest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(model.names))
        place = {name: i for i, name in enumerate(model.names)}
        for frame in frames:
            words, counts = frame["word"].to_numpy(), frame["n"].to_numpy("f8")
            sizes = np.fromiter(map(len, words), "i8", len(words))
            for size in np.unique(sizes):
                rows = np.nonzero(sizes == size)[0]
                if 0 < size <= LONG:
                    rows = rows[model.add(words[rows].tolist(), counts[rows], sums)]
                for row in rows:
                    model.add_by_logs(words[row], counts[row], place, sums)
        seen = np.nonzero(sums)[0]
        yield pd.DataFrame({"piece": [model.names[i] for i in seen], "n": sums[seen]})

    return run


def _normalized(pieces: dict[str, float]) -> dict[str, float]:
    total = sum(pieces.values())
    return {k: math.log(max(n, 1e-12) / total) for k, n in pieces.items()}


def _unigram(
    words: DataFrame, size: int, longest: int, seeds: int | None = None, rounds: int = 2, keep: float = 0.75
) -> DataFrame:
    """Expectation-maximisation over the distinct words, shrinking to ``size`` pieces.

    The model sent to the tasks has at most ``seeds`` longer pieces (by default ten times the wanted
    size), none over ``longest`` characters, and all letters. Each round is one pass with map-side sums; pieces expected least are
    dropped, letters are always kept so that every word stays writable.
    """
    words = cut_lineage(words)
    seeds = seeds or size * 10
    # Starts and lengths are generated one after the other, beside the partial count; no array of pieces is made.
    begun = words.filter(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"))
    most = F.least(F.lit(longest), F.length("word") - F.col("i") + 1)
    lengths = F.when(most >= 2, F.sequence(F.lit(2), most)).otherwise(F.array().cast("array<int>"))
    spans = begun.select("word", "n", "i", F.explode(lengths).alias("k"))
    longer = spans.groupBy(F.substring("word", F.col("i"), F.col("k")).alias("piece")).agg(F.sum("n").alias("n"))
    letters = {r["piece"]: float(r["n"]) for r in _letters(words).collect()}  # code points, so at most Unicode's
    longer = longer.orderBy(F.desc(F.col("n") * F.length("piece")), "piece")
    pieces = {r["piece"]: float(r["n"]) for r in longer.limit(seeds).collect()} | letters
    while True:
        for _ in range(rounds):
            work = _expected_counts(_normalized(pieces), longest)
            sums = words.mapInPandas(work, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))
            expected = {r["piece"]: r["n"] for r in sums.collect()}
            pieces = {k: expected.get(k, 0.0) for k in pieces if k in letters or expected.get(k, 0.0) > 0.0}
        if len(pieces) <= max(size, len(letters)):
            break
        target = max(size, len(letters), int(len(pieces) * keep))
        ranked = sorted((k for k in pieces if k not in letters), key=lambda k: (-pieces[k], k))
        kept = ranked[: target - len(letters)]
        pieces = {k: pieces[k] for k in (*letters, *kept)}
    logp = _normalized(pieces)
    rows = [(k, pieces[k], logp[k]) for k in sorted(pieces)]
    return words.sparkSession.createDataFrame(rows, "piece string, n double, logp double")


def subword_vocab(
    df: DataFrame, column: str, size: int, kind: str = "bpe", seeds: int | None = None, longest: int = 8, ahead: int = 500
) -> DataFrame:
    """Pieces of a vocabulary of about ``size`` entries.

    "word" and "char" give the ``size`` most frequent words and characters. "bpe" and "unigram" keep all letters
    of the corpus, also where there are more than ``size``, so that every word stays writable. ``seeds`` and
    ``longest`` bound the number and the length of the pieces that "unigram" starts from; ``ahead`` is the number of
    pairs that "bpe" looks at in a round, which changes its speed and not its result.
    """
    words = word_counts(df, column)
    if kind == "word":
        return _top(words.withColumnRenamed("word", "piece"), size)
    if kind == "char":
        return _top(_letters(words), size)
    if kind == "bpe":
        return _bpe(words, size, ahead)
    if kind == "unigram":
        return _unigram(words, size, longest, seeds)
    raise ValueError("kind must be 'word', 'char', 'bpe' or 'unigram'")
