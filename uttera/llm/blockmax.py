"""Ranked lexical search by Block-Max MaxScore over shards of documents.

The first pass reads the texts once and keeps, per document, its length and how often it holds each term of the
queries (a forward index, a few percent of the texts). The second cuts it into shards of at most ``SHARD_DOCS`` documents;
a task inverts a shard into lists of postings, cut into blocks of ``BLOCK`` postings. A block is stored compressed (document
offsets and counts in as few bytes as its list needs) beside its first and last document and the largest
score in it.

A query's lists are ordered by their largest score. Lists whose maxima together stay below the k-th best score so far
are non-essential: a document found in none of the others cannot enter the result. Candidates come from the
essential lists alone. Block maxima of the non-essential lists then reject candidates before any of those blocks is
decompressed, and what is left looks only into the blocks that may hold it. The k best of a shard are the start of
the next one's; the heaps of all tasks are merged by rank.

All scores are whole numbers. Nothing is approximate: only documents that cannot enter the result are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uttera.llm.common import ALNUM, opened, ragged, record_of, texts_in
from uttera.session import cut_lineage, scratch_path
from uttera.sources.files import list_files

K = 10
#: Postings in a block.
BLOCK = 64
#: Documents, and postings, of one shard at most.
SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 22
#: Documents that are searched before the best score so far is looked at again.
WINDOW = 1 << 12
#: Queries, and bytes of query texts, that are answered in one go.
QUERIES = 4096
QUERY_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1)))."""
    return np.floor(1000.0 * np.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def length_norms(n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """100 - 75 + ((75 * n * N) div L); in Python's integers where the product could leave 64 bits."""
    most = int(n_terms.max(initial=0))
    if 75 * most * n_docs < 1 << 63:
        return 25 + (75 * n_terms.astype(np.int64) * n_docs) // max(all_terms, 1)
    return np.array([25 + (75 * int(n) * n_docs) // all_terms for n in n_terms], np.int64)


def impacts(weights: np.ndarray, tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Score of one occurrence of a term in a query."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 8 * norms))


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


class PostingList:
    """Documents and counts of one term in a shard, compressed block by block."""

    def __init__(self, docs: np.ndarray, tf: np.ndarray, impact: np.ndarray):
        starts = np.arange(0, len(docs), BLOCK)
        self.size = len(docs)
        self.first = docs[starts]
        self.last = docs[np.minimum(starts + BLOCK, len(docs)) - 1]
        self.block_max = np.maximum.reduceat(impact, starts)
        self.max = int(self.block_max.max())
        self.offsets = _narrow(docs - np.repeat(self.first, BLOCK)[: len(docs)])
        self.counts = _narrow(tf)

    def decompress(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, counts) of the given blocks."""
        at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        if len(blocks) and blocks[-1] == len(self.first) - 1:
            at = at[at < self.size]
        docs = np.repeat(self.first[blocks], BLOCK)[: len(at)] + self.offsets[at]
        return docs, self.counts[at].astype(np.int64)


class Shard:
    """Inverted lists of documents numbered from 0 in the order of their ids."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, terms: np.ndarray, docs: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        self.ids, self.norms, self.weights = ids, norms, weights
        self.blocks_read = self.blocks_there = 0
        self.lists: dict[int, PostingList] = {}
        order = np.lexsort((docs, terms))
        terms, docs, tf = terms[order], docs[order], tf[order]
        impact = impacts(weights[terms], tf, norms[docs])
        cuts = np.flatnonzero(np.diff(terms)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(terms)], strict=True):
            if b > a:
                self.lists[int(terms[a])] = PostingList(docs[a:b], tf[a:b], impact[a:b])

    def _read(self, term: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.blocks_read += len(blocks)
        docs, tf = self.lists[term].decompress(blocks)
        return docs, impacts(self.weights[term], tf, self.norms[docs])

    def search(self, query: list[tuple[int, int]], best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of what is in ``best`` and in this shard, best first. ``query`` has (term, times)."""
        known = [(times * self.lists[t].max, t, times) for t, times in query if t in self.lists]
        known = sorted(x for x in known if x[0] > 0)
        if not known:
            return best
        maxima = np.cumsum([x[0] for x in known])
        lists = [(self.lists[t], t, times) for _, t, times in known]
        self.blocks_there += sum(len(p.first) for p, _, _ in lists)
        scores, ids = best
        high, step = 0, max(1, WINDOW >> 4)  # short windows first: they give the bound that later ones are held against
        while high < len(self.ids):
            low, high = high, min(high + step, len(self.ids))
            step = min(2 * step, WINDOW)
            least = int(scores[-1]) if len(scores) == k else 1
            essential = int(np.searchsorted(maxima, least, "left"))  # lists before it add up to less than the k-th score
            if essential == len(lists):
                break
            total = np.zeros(high - low, np.int64)
            for postings, t, times in lists[essential:]:
                blocks = np.arange(np.searchsorted(postings.last, low, "left"), np.searchsorted(postings.first, high, "left"))
                if len(blocks):
                    docs, score = self._read(t, blocks)
                    inside = (docs >= low) & (docs < high)
                    total[docs[inside] - low] += times * score[inside]
            found = np.flatnonzero(total) + low
            total = total[found - low]
            found, total = self._complete(lists[:essential], maxima, found, total, least)
            if len(found):
                scores, ids = _best(np.concatenate([scores, total]), np.concatenate([ids, self.ids[found]]), k)
        return scores, ids

    def _complete(self, lists: list, maxima: np.ndarray, docs: np.ndarray, total: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Adds the scores of the non-essential lists to the candidates that can still reach ``least``."""
        keep = total + (int(maxima[len(lists) - 1]) if lists else 0) >= least
        docs, total = docs[keep], total[keep]
        at, bound = [], []
        for postings, _, times in lists:
            block = np.minimum(np.searchsorted(postings.last, docs, "left"), len(postings.last) - 1)
            inside = (postings.first[block] <= docs) & (docs <= postings.last[block])
            at.append(block)
            bound.append(np.where(inside, times * postings.block_max[block], 0))
        rest = np.sum(bound, axis=0) if lists else np.zeros(len(docs), np.int64)
        alive = np.flatnonzero(total + rest >= least)
        docs, total, rest = docs[alive], total[alive], rest[alive]
        for i in range(len(lists) - 1, -1, -1):
            if not len(docs):
                break
            postings, t, times = lists[i]
            may = bound[i][alive]
            blocks = np.unique(at[i][alive][may > 0])
            if len(blocks):
                there, score = self._read(t, blocks)
                place = np.minimum(np.searchsorted(there, docs), len(there) - 1)
                total = total + np.where((there[place] == docs) & (may > 0), times * score[place], 0)
            rest = rest - may
            keep = total + rest >= least
            alive, docs, total, rest = alive[keep], docs[keep], total[keep], rest[keep]
        return docs, total


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _read_items(files: list[str]) -> tuple[list, list[list[bytes]]]:
    """(rows of the items, their terms) of the files of one block, in the files' order."""
    numbers, terms = [], []
    for address in files:
        system, path = opened(address)
        rows = pq.read_table(path, filesystem=system, columns=["number", "text"])
        numbers += rows["number"].to_pylist()
        terms += [terms_of(x) for x in texts_in(rows["text"].combine_chunks())]
    return numbers, terms


def _vocabulary(terms: list[list[bytes]]) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(sorted({t for item in terms for t in item}))}


def forward_index(docs: DataFrame, files: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, terms, counts) of every document with at least one term: its number of terms, and the terms of the
    queries in ``files`` that it holds, as positions in their sorted vocabulary, with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _vocabulary(_read_items(files)[1])
        for batch in batches:
            n, terms, counts = [], [], []
            for t in texts_in(batch.column(1)):
                words = terms_of(t)
                codes = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                found, times = np.unique(codes[codes >= 0], return_counts=True)
                n.append(len(words))
                terms.append(found)
                counts.append(times)
            whole = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), ragged(terms, pa.int32()), ragged(counts, pa.int64())],
                names=["id", "n", "terms", "counts"],
            )
            yield whole.filter(pa.array(np.array(n, np.int64) > 0))

    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def _answer(files: list[str], weights: np.ndarray, n_docs: int, all_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, terms = _read_items(files)
        code = _vocabulary(terms)
        queries = []
        for item in terms:
            found, times = np.unique(np.array([code[t] for t in item], np.int64), return_counts=True)
            queries.append(list(zip(found.tolist(), times.tolist(), strict=True)))
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]

        def add(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows["id"].fill_null(NO_ID).to_numpy()
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sizes = pa.compute.list_value_length(rows["terms"]).to_numpy()
            norms = length_norms(rows["n"].to_numpy(), n_docs, all_terms)[order]
            flat = [pa.compute.list_flatten(rows[c]).to_numpy().astype(np.int64) for c in ("terms", "counts")]
            shard = Shard(ids[order], norms, flat[0], np.repeat(place, sizes), flat[1], weights)
            for q, query in enumerate(queries):
                best[q] = shard.search(query, best[q], k)

        held, docs, postings = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_DOCS):
                part = batch.slice(at, SHARD_DOCS)
                size = pa.compute.sum(pa.compute.list_value_length(part.column(2))).as_py() or 0
                if held and (docs + part.num_rows > SHARD_DOCS or postings + size > SHARD_POSTINGS):
                    add(held)
                    held, docs, postings = [], 0, 0
                held.append(part)
                docs, postings = docs + part.num_rows, postings + size
        if held:
            add(held)
        for number, (scores, ids) in zip(numbers, best, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(ids), pa.int64()), pa.array(ids, mask=ids == NO_ID), pa.array(scores)],
                    names=["number", "doc_id", "score"],
                )

    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", item_text: str = "text"
) -> DataFrame:
    """(record, rank, doc_id, score): the k best documents of every item, best first, equal scores by rising id.

    ``record`` is the item's row as a struct; ``items`` may have any columns. Every row of ``items`` is a query of its own, also
    a repeated one; every row of ``docs`` is a document of its own, also one with a repeated or null id (null comes
    last). Null and empty texts have no terms: such documents count nowhere, such items have no result. With fewer
    than k documents of positive score all of them are returned.

    Items go to the shared folder in blocks of at most about QUERIES rows or QUERY_BYTES bytes (and one item); a block's vocabulary
    is what tasks and driver hold. Every block reads the documents once.
    """
    spark = docs.sparkSession
    numbered = cut_lineage(record_of(items).withColumn("number", F.monotonically_increasing_id()))
    queries = numbered.select("number", F.col(f"record.`{item_text}`").alias("text"))
    size = queries.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    blocks = max(-(-size["n"] // QUERIES), -(-(size["bytes"] or 0) // QUERY_BYTES), 1)
    folder = scratch_path(spark, "search-items")
    placed = queries.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))
    placed.repartition(int(min(blocks, 200)), "block").write.partitionBy("block").parquet(folder)
    files: dict[str, list[str]] = {}
    for path in list_files(spark, folder):
        if path.endswith(".parquet"):
            files.setdefault(path.rsplit("/", 2)[1], []).append(path)
    found = spark.createDataFrame([], "number long, doc_id long, score long")
    for own in files.values():
        path = scratch_path(spark, "search-forward")
        forward_index(docs, own, doc_id, text).write.parquet(path)
        index = spark.read.parquet(path)
        whole = index.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
        counted = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toPandas()
        if not len(counted):
            continue
        df = np.zeros(int(counted["t"].max()) + 1, np.int64)
        df[counted["t"].to_numpy()] = counted["df"].to_numpy()
        run = _answer(own, term_weights(df, whole["n"]), whole["n"], whole["terms"], k)
        found = found.unionAll(index.mapInArrow(run, "number long, doc_id long, score long"))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return numbered.join(ranked, "number").select("record", "rank", "doc_id", "score")


