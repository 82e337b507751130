import hashlib
from functools import partial

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from uttera.llm import suffix_dedup as sd


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=70), st.integers(1, 40))
def test_suffix_order_up_to_a_depth(symbols, depth):
    s = np.array(symbols, np.int64)
    order = sd.suffix_order(s, depth)
    assert sorted(order.tolist()) == list(range(len(s)))
    prefixes = [symbols[i : i + depth] for i in order]
    assert prefixes == sorted(prefixes)


def brute(docs):
    """Rows (id, bytes) in their order -> (n_bytes, removed positions, kept)."""
    seen, out = set(), []
    for _, b in docs:
        covered = np.zeros(len(b) + 1, int)
        fresh = []
        for k in range(len(b) - sd.LENGTH + 1):
            w = b[k : k + sd.LENGTH]
            if w in seen:
                covered[k] += 1
                covered[k + sd.LENGTH] -= 1
            seen.add(w)
            fresh.append(w)
        gone = np.cumsum(covered[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        out.append((len(b), edges.tolist(), kept))
    return out


def compare(spark, rows):
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, h int, bucket string").repartition(3)
    got = sorted(
        ((str(r["doc_id"]), r["n_bytes"], r["runs"], bytes(r["kept"]), r["kept_sha256"]) for r in sd.without_repeats(frame).collect()), key=repr
    )
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = brute([(d, (t or "").encode()) for d, t in ordered])
    assert got == sorted(((str(d), n, e, k, hashlib.sha256(k).hexdigest()) for (d, _), (n, e, k) in zip(ordered, want, strict=True)), key=repr)


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdeéß"), rng.integers(1, 9))) for _ in range(400)]
    return lambda n: " ".join(rng.choice(vocabulary, n))


def test_copies_passages_periods_and_odd_rows(spark, prose):
    base, passage = prose(300), prose(40)
    rows = [(1, base), (2, base), (3, prose(50) + passage + prose(50)), (4, prose(10) + passage[7:] + prose(90)), (5, passage)]
    rows += [(6, "ab" * 400), (7, "x" * 350), (8, "x" * 99), (9, "x" * 100), (10, ""), (11, None), (12, base[500:1500] + prose(30) + base[:900])]
    rows += [(13, prose(40)), (13, base[:200]), (20, base), (None, passage + " " + prose(20)), (21, "é" * 80 + base[40:400])]
    rows += [(22, passage[:99]), (23, passage[:100]), (24, prose(20000) + passage), (25, prose(3) + base + base)]
    compare(spark, rows)


def test_a_hot_passage_in_many_documents(spark, prose):
    passage, line = prose(30), prose(12)
    rows = [(i, prose(20) + passage + prose(15) + "\n" + line) for i in range(120)]
    compare(spark, rows)


def test_heavy_bands_are_spread_and_give_the_same(spark, prose, monkeypatch):
    passage, line, short = prose(60), prose(20), prose(14)[:60]
    rows = [(i, prose(12) + passage + prose(9) + "\n" + line + "\n" + short + prose(8)) for i in range(150)]
    rows += [(200 + i, passage[i:] + prose(1 + i % 4)) for i in range(40)] + [(3, rows[3][1]), (None, rows[7][1])]
    bound = 40 * (sd.LENGTH + sd.BAND)
    bytes_of = []
    compare_bucket, heavy_windows = sd._pieces, sd._heavy_windows

    def weighed(marked, heavy):
        rest = marked.mapInArrow(compare_bucket(1 << 30, heavy), "bucket int, d array<long>, h array<int>, lo array<long>, n array<int>, text binary")
        per_key = rest.selectExpr("bucket", "aggregate(n, 0, (s, x) -> s + x + 99) as bytes").groupBy("bucket").sum("bytes")
        bytes_of.append((len(heavy), max(r[1] for r in per_key.collect())))
        return heavy_windows(marked, heavy)

    monkeypatch.setattr(sd, "_heavy_windows", weighed)
    whole = sd.without_repeats
    monkeypatch.setattr(sd, "without_repeats", partial(whole, heavy_bytes=bound))
    compare(spark, rows)
    (heavy, most), = bytes_of
    assert heavy > 4 and most <= bound
    monkeypatch.setattr(sd, "without_repeats", whole)
    compare(spark, rows)
    assert len(bytes_of) == 1


def test_repeated_rows_go_whole_but_one(spark, prose):
    text = prose(60)
    frame = spark.createDataFrame([(1, text), (1, text), (2, "short"), (2, "short")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["runs"], bytes(r["kept"]).decode()) for r in sd.without_repeats(frame).collect())
    n = len(text.encode())
    assert got == [(1, [], text), (1, [0, n], ""), (2, [], "short"), (2, [], "short")]


def test_empty_table(spark):
    assert sd.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sample_table_against_brute_force(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    compare(spark, rows)


@pytest.mark.parametrize("large", ["true", "false"])
def test_both_widths_of_arrow_offsets(spark, prose, large):
    key = "spark.sql.execution.arrow.useLargeVarTypes"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, large)
    try:
        shared = prose(60)
        compare(spark, [(1, shared), (2, "a" + shared), (3, None), (4, ""), (5, prose(80)), (6, shared * 2)])
    finally:
        spark.conf.set(key, before)
