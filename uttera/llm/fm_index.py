"""Benchmark decontamination with an FM-index over each shard of training text.

Words are `[0-9a-z]` and non-ASCII characters after lower-casing A-Z. A test item is cut into windows of
``window`` consecutive words (one window if it is shorter). Every shard of training words gets an FM-index: the
Burrows-Wheeler transform in a wavelet matrix, and suffix positions sampled at every ``SAMPLE``-th word. All
windows are searched backwards at once by wavelet ranks, and the rows found are walked to the next sampled
position to locate them. The located windows of a document are merged into removal spans.

The alphabet of an index is the words of the test items. Any other word is a separator, as no window holds it, and
a run of known words that is shorter than the shortest window is left out, as none fits into it. Neither loses
an occurrence.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttera.llm.common import ALNUM, opened, ragged, record_of, texts_in
from uttera.session import cut_lineage, scratch_path

WINDOW = 13
SAMPLE = 16
#: Words in one index at most; longer input makes several.
SHARD = 1 << 20
#: Bytes of test text that are searched for at once; more are searched for block by block.
BLOCK_BYTES = 8 << 20
#: Bytes of documents that a task holds while it goes through several blocks.
HELD_BYTES = 32 << 20
END, BREAK, FIRST = 0, 1, 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions in suffix order, by prefix doubling; the last symbol must be unique and smallest."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.r_[False, ordered[1:] != ordered[:-1]]
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks and symbols of an integer sequence, one bit level at a time, for whole arrays of questions."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(bit) - int(ones[-1])
            self.levels.append((level, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros_like(end)
        for level, ones, zeros in self.levels:
            up = (symbol >> level) & 1 == 1
            a, b = ones[start], ones[end]
            start, end = np.where(up, zeros + a, start - a), np.where(up, zeros + b, end - b)
        return end - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it occurs before it."""
        start, symbol = np.zeros_like(at), np.zeros_like(at)
        for level, ones, zeros in self.levels:
            a, b = ones[start], ones[at]
            up = ones[at + 1] > b
            symbol = symbol | (up.astype(symbol.dtype) << level)
            start, at = np.where(up, zeros + a, start - a), np.where(up, zeros + b, at - b)
        return symbol, at - start


class FmIndex:
    """Count and locate integer patterns in an integer text whose last symbol is END."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        self.size = len(text)
        self.sigma = int(text.max()) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=self.sigma))]
        self.wavelet = WaveletMatrix(text[order - 1].astype(np.int64), max(1, (self.sigma - 1).bit_length()))
        marked = order % sample == 0
        self.marked = marked
        self.marks = np.r_[0, np.cumsum(marked)]
        self.sampled = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern; patterns are right-aligned rows of a matrix."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        width = patterns.shape[1]
        for back in range(width):
            live = np.flatnonzero((lengths > back) & (low < high))
            symbol = patterns[live, width - 1 - back]
            known = symbol < self.sigma
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.marked[at])
        while len(live):
            symbol, rank = self.wavelet.symbol_and_rank(at[live])
            at[live] = self.before[symbol] + rank
            steps[live] += 1
            live = live[~self.marked[at[live]]]
        return self.sampled[self.marks[at]] + steps


class Phrases:
    """Windows of a block of test items, coded in the block's own vocabulary."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.codes: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = (text or "").encode().translate(ALNUM).split()
            coded = [self.codes.setdefault(w, len(self.codes) + FIRST) for w in words]
            for k in range(max(1, len(coded) - window + 1) if coded else 0):
                holders.setdefault(tuple(coded[k : k + window]), set()).add(item_id or "")
        self.windows = list(holders)
        self.holders = [sorted(x) for x in holders.values()]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        width = int(self.lengths.max()) if self.windows else 1
        self.matrix = np.zeros((len(self.windows), width), np.int64)
        for k, w in enumerate(self.windows):
            self.matrix[k, width - len(w) :] = w


def _runs(coded: np.ndarray, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of runs of known words that can hold a window; very long ones are cut with overlap."""
    known = np.r_[False, coded >= FIRST, False]
    edge = np.flatnonzero(known[1:] != known[:-1])
    start, end = edge[::2], edge[1::2]
    fits = end - start >= shortest
    start, end = start[fits], end[fits]
    if len(start) and (end - start).max() > SHARD:
        step = SHARD - longest
        pieces = [(s, min(s + SHARD, e)) for a, e in zip(start, end, strict=True) for s in range(a, max(a + 1, e - longest + 1), step)]
        start, end = np.array(pieces, np.int64).T
    return start, end


def _occurrences(coded: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of every occurrence in coded words; documents are parted by BREAK."""
    found_w, found_p = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if phrases.windows:
        start, end = _runs(coded, int(phrases.lengths.min()), int(phrases.lengths.max()))
        filled = np.cumsum(end - start + 1)
        shard = filled // SHARD if len(filled) else filled
        for k in np.unique(shard):
            s, e = start[shard == k], end[shard == k]
            at = np.r_[0, np.cumsum(e - s + 1)]
            text = np.full(at[-1] + 1, BREAK, np.int64)
            source = np.arange(at[-1]) - np.repeat(at[:-1] - s, e - s + 1)
            inside = source < np.repeat(e, e - s + 1)
            text[:-1][inside] = coded[source[inside]]
            text[-1] = END
            index = FmIndex(text)
            low, high = index.search(phrases.matrix, phrases.lengths)
            count = high - low
            rows = np.arange(count.sum()) + np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count)
            position = index.locate(rows)
            run = np.searchsorted(at, position, "right") - 1
            found_w.append(np.repeat(np.arange(len(count)), count))
            found_p.append(position - at[run] + s[run])
    return np.concatenate(found_w), np.concatenate(found_p)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


@lru_cache(maxsize=1)
def _loaded(address: str | None, window: int) -> Phrases:
    """The block in a file; the last one asked for stays with the Python worker."""
    if address is None:
        return Phrases([], window)
    files, path = opened(address)
    block = pq.read_table(path, filesystem=files)
    return Phrases(list(zip(block["id"].to_pylist(), block["text"].to_pylist(), strict=True)), window)


def _add(phrases: Phrases, texts: list[bytes], spans: list[list[int]], items: list[list[str]]) -> list[int]:
    """Adds what a block finds in the texts of a batch to their spans and items; words of each text."""
    code = phrases.codes.get
    words, pieces = [], []
    for t in texts:
        w = t.translate(ALNUM).split()
        words.append(len(w))
        pieces.append(np.fromiter((code(x, BREAK) for x in chain(w, (b"",))), np.int32, len(w) + 1))
    starts = np.r_[0, np.cumsum(np.array(words, np.int64) + 1)]
    window, position = _occurrences(np.concatenate(pieces) if pieces else np.empty(0, np.int32), phrases)
    doc = np.searchsorted(starts, position, "right") - 1
    order = np.argsort(doc, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(doc[order])) + 1).tolist(), len(order)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:  # nothing found in the batch
            continue
        rows = order[a:b]
        d = doc[rows[0]]
        first = position[rows] - starts[d]
        known = list(zip(spans[d][::2], spans[d][1::2], strict=True))
        merged = _merge(known + list(zip(first.tolist(), (first + phrases.lengths[window[rows]]).tolist(), strict=True)))
        spans[d] = [x for span in merged for x in span]
        items[d] = sorted({*items[d], *(x for w in np.unique(window[rows]) for x in phrases.holders[w])})
    return words


def _search(blocks: list[str | None], window: int, text_at: int, names: list[str]):
    def answer(held: list[pa.RecordBatch], blocks: list[str | None]) -> Iterator[pa.RecordBatch]:
        found = [([[] for _ in range(len(b))], [[] for _ in range(len(b))]) for b in held]
        words: list[list[int]] = []
        for address in blocks:
            phrases = _loaded(address, window)
            words = [_add(phrases, texts_in(b.column(0).flatten()[text_at]), *f) for b, f in zip(held, found, strict=True)]
        for batch, n, (spans, items) in zip(held, words, found, strict=True):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), ragged(spans, pa.int64()), pa.array(items, pa.list_(pa.string()))],
                names=names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, list(blocks)
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(turn) == 1 or size >= HELD_BYTES:
                yield from answer(held, turn)
                held, size, turn = [], 0, turn[::-1]  # back from the block that is loaded
        yield from answer(held, turn if held else [])

    return run


def _blocks(phrases: DataFrame) -> list[str | None]:
    """Files in the shared folder with the items (id, text) in blocks of bounded bytes, written by tasks; at least one entry."""
    spark, most, folder = phrases.sparkSession, BLOCK_BYTES, scratch_path(phrases.sparkSession, "items")
    item, text = phrases.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        block, size = ([], []), 0

        def put() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.parquet"
            files.create_dir(base, recursive=True)
            rows = pa.table({"id": pa.array(block[0], pa.string()), "text": pa.array(block[1], pa.string())})
            pq.write_table(rows, f"{base}/{name}", filesystem=files)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                block[0].append(key.as_py())
                block[1].append(value.as_py())
                size += len((block[1][-1] or "").encode())
                if size > most:
                    yield put()
                    block, size = ([], []), 0
        if block[0]:
            yield put()

    bytes_of = phrases.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    tasks = max(1, min(-(-bytes_of // most), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Only files of attempts that came through are in the list.
    written = cut_lineage(phrases.select(item, text).repartition(tasks).mapInArrow(write, "path string"))
    return sorted(r["path"] for r in written.collect()) or [None]


def find_phrases(docs: DataFrame, phrases: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(record, n_words, spans, items) per document.

    ``record`` is the input row. ``spans`` lists start, end, start, end ... of the merged spans in words (end
    exclusive), ``items`` the distinct ids (as strings, sorted) of the items with an occurring window.
    ``phrases`` has the columns (id, text). Null texts have no words; a null id counts as an empty one; an
    empty table of either kind is searched like any other. Documents are neither shuffled nor collected;
    items do not pass through the driver: they are written to the shared folder in files of at most BLOCK_BYTES and
    one item, which each task reads one after the other.
    """
    item, item_text = phrases.columns
    phrases = phrases.select(F.col(item).cast("string"), item_text)
    df = record_of(docs)
    schema = T.StructType([df.schema["record"], *FIELDS])
    return df.mapInArrow(_search(_blocks(phrases), window, docs.columns.index(text), schema.names), schema)


def n_hit() -> Column:
    """Words inside the spans."""
    ends = F.filter("spans", lambda x, i: i % 2 == 1)
    starts = F.filter("spans", lambda x, i: i % 2 == 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return total(ends) - total(starts)


def is_contaminated() -> Column:
    """At least a twentieth of the words are inside spans."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def cut_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of find_phrases with the words of the spans cut out of the text: (record, kept_text)."""
    at = found.schema["record"].dataType.names.index(text)
    schema = T.StructType([found.schema["record"], T.StructField("kept_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            record, spans = batch.columns
            kept = []
            for t, s in zip(texts_in(record.flatten()[at]), spans.to_pylist(), strict=True):
                if s:
                    marked = np.frombuffer(t.translate(ALNUM), np.uint8) != 0x20
                    edge = np.flatnonzero(np.diff(np.r_[False, marked, False]))
                    parts, last = [], 0
                    for a, b in zip(s[::2], s[1::2], strict=True):
                        parts.append(t[last : edge[2 * a]])
                        last = int(edge[2 * b - 1])
                    t = b"".join([*parts, t[last:]])
                kept.append(t.decode())
            yield pa.RecordBatch.from_arrays([record, pa.array(kept, pa.string())], names=schema.names)

    return found.select("record", "spans").mapInArrow(run, schema)

