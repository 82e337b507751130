import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from uttera.llm import fm_index as fm


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=60), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=5), min_size=1, max_size=8))
def test_index_counts_and_locates(text, patterns):
    index = fm.FmIndex(np.array([*text, fm.END]), sample=4)
    lengths = np.array([len(p) for p in patterns])
    matrix = np.zeros((len(patterns), lengths.max()), np.int64)
    for k, p in enumerate(patterns):
        matrix[k, lengths.max() - len(p) :] = p
    low, high = index.search(matrix, lengths)
    for p, a, b in zip(patterns, low, high, strict=True):
        places = [i for i in range(len(text)) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window=13):
    out = []
    for d, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, phrase in items:
            p = words_of(phrase)
            for k in range(max(1, len(p) - window + 1) if p else 0):
                w = p[k : k + window]
                for i in range(len(words) - len(w) + 1):
                    if words[i : i + len(w)] == w:
                        hit |= set(range(i, i + len(w)))
                        found.add("" if item is None else str(item))
        out.append((d, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [fm.BLOCK_BYTES, 10])
def test_phrases_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fm, "BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    vocabulary = ["ab", "cd", "ef", "é1", "Über"]
    some = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = some(20)
    items = [(1, passage), (2, some(14)), (10, "ab cd"), (3, ""), (4, None), (None, "Über, ef. cd"), (2, some(13)), (5, "zz zz")]
    docs = [(i, some(int(rng.integers(0, 60)))) for i in range(30)]
    docs += [(40, f"x {passage} y {passage}"), (41, None), (42, ""), (42, ""), (None, passage.upper()), (43, some(3000)), (44, "--- ... \x7f")]
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, spans string, record int")
    found = fm.find_phrases(frame, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(
        ((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.select("record.doc_id", "n_words", fm.n_hit().alias("n_hit"), "items").collect()),
        key=str,
    )
    assert got == brute(docs, items)
    cut = {r["record"]["doc_id"]: r["kept_text"] for r in fm.cut_spans(found).collect()}
    assert words_of(cut[44]) == [] and cut[44] == "--- ... \x7f"
    hits = {d: (n, h) for d, n, h, _ in got}
    assert all(len(words_of(t)) == hits[d][0] - hits[d][1] for d, t in cut.items())


def test_items_stay_out_of_the_driver_and_the_plan(spark, monkeypatch):
    words = [f"w{k}" for k in range(5000)]
    docs = [(k, " ".join(words[k : k + 60])) for k in range(0, 4900, 70)]
    items = [(f"i{k:04}", " ".join(words[k : k + 20])) for k in range(0, 4900, 35)]
    monkeypatch.setattr(fm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(fm, "HELD_BYTES", 3000)
    phrases = spark.createDataFrame(items, "item_id string, text string").repartition(2)

    def refuse(*_, **__):
        raise AssertionError("items pass through the driver")

    monkeypatch.setattr(type(phrases), "toLocalIterator", refuse)
    found = fm.find_phrases(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), phrases)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r["record"]["doc_id"]: (r["n_words"], list(r["spans"]), list(r["items"])) for r in found.collect()}
    for k, _ in docs:
        n, spans, hits = got[k]
        reach = [int(i[1:]) for i, _ in items if max(int(i[1:]), k) + fm.WINDOW <= min(int(i[1:]) + 20, k + 60)]
        assert n == 60 and hits == [f"i{x:04}" for x in reach]
        inside = sorted({w - k for x in reach for w in range(max(x, k), min(x + 20, k + 60))})
        assert inside == [w for a, b in zip(spans[::2], spans[1::2], strict=True) for w in range(a, b)]


def test_empty_tables_and_the_rule(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a " + "x " * 30)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["spans"], r["items"]) for r in fm.find_phrases(docs, none).collect()] == [(3, [], []), (31, [], [])]
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    found = fm.find_phrases(docs, item).select("record.doc_id", fm.is_contaminated().alias("c")).collect()
    assert {r["doc_id"]: r["c"] for r in found} == {1: True, 2: False}
    assert fm.find_phrases(docs.limit(0), item).count() == 0


def test_long_runs_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(fm, "SHARD", 50)
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 3, 400)]
    phrases = fm.Phrases([("1", " ".join(words[90:110])), ("2", "w0 w1")], 13)
    coded = np.array([phrases.codes.get(w.encode(), fm.BREAK) for w in words] + [fm.BREAK])
    window, place = fm._occurrences(coded, phrases)
    got = set(zip(window.tolist(), place.tolist(), strict=True))
    want = {
        (k, i) for k, w in enumerate(phrases.windows) for i in range(len(words)) if tuple(coded[i : i + len(w)].tolist()) == w
    }
    assert got == want
