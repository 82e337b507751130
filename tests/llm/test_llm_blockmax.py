import math
import re
from collections import Counter

import numpy as np
import pytest

from uttera.llm import blockmax as bm


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    counts = [c for c in counts if c[2]]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in counts:
            m = 100 - 75 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def corpus(n=400):
    rng = np.random.default_rng(4)
    weights = 1 / np.arange(1, 301) ** 1.1
    vocabulary = [f"t{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    docs = [(int(i), some(int(rng.integers(1, 80)))) for i in rng.permutation(n)]
    docs += [(n + 1, None), (n + 2, ""), (n + 3, "-- \x7f"), (None, some(30)), (7, docs[3][1]), (7, docs[3][1]), (n + 4, "t5 " * 30000), (n + 5, "Über ÜBER über T5")]
    items = [(i, some(int(rng.integers(1, 25)))) for i in range(25)]
    items += [(3, "t1 t1 t1 t2"), (3, "t1 t1 t1 t2"), (None, "t9, T5; Über"), (40, None), (41, "nowhere"), (42, "")]
    return docs, items


@pytest.mark.parametrize(("shard", "window", "queries"), [(bm.SHARD_DOCS, bm.WINDOW, bm.QUERIES), (64, 16, 5)])
def test_search_against_brute_force(spark, monkeypatch, shard, window, queries):
    for name, value in (("SHARD_DOCS", shard), ("WINDOW", window), ("QUERIES", queries), ("BLOCK", 8 if shard == 64 else bm.BLOCK)):
        monkeypatch.setattr(bm, name, value)
    docs, items = corpus()
    frame = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, score int, rank string").repartition(3)
    asked = spark.createDataFrame([(d, t, 0) for d, t in items], "item_id long, text string, doc_id int")
    found = bm.search(frame, asked).select("record.item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_shards_skip_blocks_and_lose_nothing():
    rng = np.random.default_rng(8)
    n, size = 20000, 60
    norms = rng.integers(40, 400, n)
    terms_, docs_, tf = [], [], []
    for t in range(size):
        held = np.sort(rng.choice(n, int(n / (t + 1.5) ** 1.5), replace=False))
        terms_.append(np.full(len(held), size - 1 - t))
        docs_.append(held)
        tf.append(rng.integers(1, 6, len(held)))
    df = np.array([len(x) for x in docs_[::-1]])
    weights = bm.term_weights(df, n)
    shard = bm.Shard(np.arange(n) * 3, norms, np.concatenate(terms_), np.concatenate(docs_), np.concatenate(tf), weights)
    for chosen in [*(rng.choice(size, 8, replace=False) for _ in range(5)), *[[0, 3, 5, 56, 57, 58, 59]] * 5]:
        query = [(int(t), int(rng.integers(1, 3))) for t in chosen]
        want = np.zeros(n, np.int64)
        for t, times in query:
            d = docs_[size - 1 - t]
            want[d] += times * bm.impacts(weights[t], tf[size - 1 - t], norms[d])
        order = np.lexsort((np.arange(n), -want))[:10]
        scores, ids = shard.search(query, (np.empty(0, np.int64), np.empty(0, np.int64)), 10)
        assert scores.tolist() == want[order].tolist() and ids.tolist() == (order * 3).tolist()
    assert shard.blocks_read < 0.9 * shard.blocks_there


def test_lists_are_compressed_and_come_back():
    docs = np.array([0, 3, 70, 71, 500, 1000, 70000, 70001] * 20) + np.repeat(np.arange(20) * 80000, 8)
    tf = np.arange(len(docs)) * 7 + 1
    held = bm.PostingList(docs, tf, tf)
    assert held.counts.dtype == np.uint16 and held.max == tf.max()
    blocks = np.arange(len(held.first))
    assert [x.tolist() for x in held.decompress(blocks)] == [docs.tolist(), tf.tolist()]
    some = held.decompress(blocks[[0, len(blocks) - 1]])[0]
    assert some.tolist() == [*docs[: bm.BLOCK], *docs[(len(blocks) - 1) * bm.BLOCK :]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert bm.search(docs, items.limit(0)).count() == 0
    assert bm.search(docs.limit(0), items).count() == 0
    assert bm.search(docs.filter("doc_id = 2"), items).count() == 0
    assert [tuple(r)[1:] for r in bm.search(docs, items).collect()] == [(1, 1, 287 * ((10**9) // (1000 + 800)))]
