import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from uttera.llm import simhash_ring as ring
from uttera.llm.components import connected_components

SCHEMA = "doc_id long, text string, fingerprint string, root int"


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc rows (id, fingerprint) -> smallest reachable id per distinct fingerprint."""
    fps = sorted({f for _, f in prints})
    group = {f: f for f in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                group[find(b)] = find(a)
    low = {}
    for d, f in prints:
        r = find(f)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return {f: low.get(find(f)) for f in fps}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\t\n\x0b\x1c ", max_size=60))
def test_fingerprint_of_any_text(text):
    assert ring.fingerprint(text.encode()) == plain_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_every_near_pair_meets_and_passes_the_ring(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    fps = np.array([x, y], np.uint64)
    keys, owners, probes = ring._chain_keys(fps, 4)
    stored = {(int(k), int(o)) for k, o, p in zip(keys, owners, probes, strict=True) if not p}
    assert any((int(k), int(y)) in stored for k, o, p in zip(keys, owners, probes, strict=True) if p and o == x) or any(
        (int(k), int(x)) in stored for k, o, p in zip(keys, owners, probes, strict=True) if p and o == y
    )
    assert ring._ring_passes(np.array([x ^ y], np.uint64), 4).all()


def test_near_duplicates_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [(10**9, "", "x", 1), (10**9 + 1, None, "x", 1), (None, "one two", None, 2), (7, "one two", None, 2), (7, "one two", None, 2),
             (8, "word " * 40000, None, None)]
    odd = spark.createDataFrame(extra, SCHEMA)
    both = docs.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    got = ring.near_duplicates(both).collect()
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in both.collect()]
    low = plain_components(rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"] & (2**64 - 1), r["component_id"]) for r in got) == sorted(
        (str(d), f, low[f]) for d, f in rows
    )


def test_dense_group_leaves_few_links_in_blocks_too(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (900, 2))} | {int(x) for x in rng.integers(0, 2**63, 50)}
    low = plain_components([(f, f) for f in fps])
    df = spark.createDataFrame([(f,) for f in fps], "fingerprint long").repartition(3)
    for block in (ring.BLOCK, 16):
        links = ring.links_of(df, 4, block).cache()
        if block == ring.BLOCK:
            assert links.count() < 40 * len(fps)
        found = {r["node"]: r["root"] for r in connected_components(links).collect()}
        assert {f: found.get(f, f) for f in fps} == low


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    df = spark.createDataFrame([*chain, *star, (500, 500), (100, 101), (None, 3)], "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}
    assert connected_components(df.limit(0)).count() == 0


def test_keep_one_keeps_whole_rows_of_one_member(spark):
    rows = [(5, "a b c d e f", "f", 1), (3, "a b c d e f", "g", 2), (3, "a b c d e f", "g", 2), (9, "q w e r t z u i o p", None, None), (4, None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = ring.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 9]
    assert ring.keep_one(docs.limit(0)).count() == 0
    assert ring.near_duplicates(docs.filter(F.lit(False))).count() == 0
