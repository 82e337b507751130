"""Mixing and sharding."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from uttera.llm import feistel, mixing
from uttera.llm.catalog import op5_golden_ratio_mix, op6_feistel_shards

MIX = "doc_id long, text string, source string, size int, target string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes):
    """Targets by sharing again and again what lies above a source's cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / total for s in free}
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]


def mix_rows(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 5}" if i % 5 else "é", i, "t") for i in range(400)]
    rows += [(1000 + i, "a b\tc\x0bd " * 3, "big", i, "t") for i in range(300)]
    rows += [(5000, None, None, 1, None), (5001, "x " * 50, None, 1, None), (5002, "", "empty", 1, None), (5003, "q", "one", 0, ""),
             (None, "y z", "one", 0, ""), (7, "w " * 7, "s2", 1, "t"), (7, "w " * 7, "s2", 1, "t"), (9000, "long " * 30000, "long", 1, "t")]
    return rows, spark.createDataFrame(rows, MIX)


def test_targets_and_taken_words(spark):
    rows, docs = mix_rows(spark)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += size_of(text)
    targets = fill(sizes)
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), size_of(t)) for d, t, *_ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    per = defaultdict(int)
    for r in got:
        per[(r["source_size"], round(r["target"], 6))] += r["taken"]
    want = defaultdict(int)
    for s, n in sizes.items():
        want[(n, round(targets[s], 6))] += min(round(targets[s]), 2 * n)
    assert {k: v for k, v in per.items()} == pytest.approx(dict(want), abs=1)
    again = mixing.mixture(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_slots_follow_the_weights_everywhere_in_the_schedule(spark):
    targets = spark.createDataFrame([(f"s{k}", k, 1, 10**6, t) for k, t in enumerate([5e5, 2e5, 1e5, 2.0])], "source string, sid long, rows long, source_size long, target double")
    plan = mixing.schedule(targets, 100).orderBy("slot").collect()
    assert [r["slot"] for r in plan][:8000] == list(range(8000))
    seen = defaultdict(int)
    for k, r in enumerate(plan[:8000], 1):
        assert r["rank"] == seen[r["sid"]]
        seen[r["sid"]] += 1
        for sid, share in enumerate((5 / 8, 2 / 8, 1 / 8)):
            assert abs(seen[sid] - k * share) < 6
    assert [r["slots"] for r in plan if r["sid"] == 3] == [1]


def test_pieces_tile_each_stream(spark):
    _, docs = mix_rows(spark)
    slim = docs.select("doc_id", "source", mixing.word_count("text").alias("size"), mixing.shuffle_key("doc_id", "text").alias("key"))
    targets = mixing.source_targets(slim)
    plan = mixing.schedule(targets, 64)
    pieces = mixing.mix_words(mixing.streams(slim, targets), plan).filter("slot is not null").collect()
    spans = defaultdict(list)
    for r in pieces:
        begin = r["__at"] + r["pass"] * r["source_size"]
        spans[r["sid"]].append((begin + r["start"], begin + r["end"]))
    words = {r["sid"]: r["words"] for r in plan.collect()}
    for sid, found in spans.items():
        found.sort()
        assert found[0][0] == 0 and found[-1][1] == words[sid]
        assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))


def test_mixed_documents_keep_their_rows(spark):
    rows, docs = mix_rows(spark)
    mixed = mixing.mix_documents(docs)
    assert mixed.select("record.*").columns == docs.columns
    counted = {(r["doc_id"], r["text"], r["source"]): r["n"] for r in mixed.select("record.*").groupBy("doc_id", "text", "source").agg(F.count("*").alias("n")).collect()}
    assert all(n <= 2 * sum((d, t, s) == k for d, t, s, *_ in rows) for k, n in counted.items())
    assert mixing.mix_documents(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0
    assert mixing.mixture(docs.filter("doc_id = 5002")).collect()[0]["taken"] == 0


def place(number, n, seed):
    a, b = feistel._sides(n)
    keys = feistel.round_keys(seed)

    def mix(x, key):
        x = (x * feistel.MULTIPLY[0] + key) & feistel.MASK
        x ^= x >> 15
        x = (x * feistel.MULTIPLY[1]) & feistel.MASK
        return x ^ x >> 13

    while True:
        left, right = divmod(number, b)
        for i, key in enumerate(keys):
            if i % 2 == 0:
                left = (left + mix(right, key) % a) % a
            else:
                right = (right + mix(left, key) % b) % b
        number = left * b + right
        if number < n:
            return number


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 64, 97, 1000, 4099])
def test_permutation_is_one_to_one_and_computable(spark, n):
    got = [r[0] for r in spark.range(n).select(feistel.permuted(F.col("id"), n, 3)).collect()]
    assert sorted(got) == list(range(n))
    assert got == [place(i, n, 3) for i in range(n)]


def test_huge_tables_stay_within_bigint(spark):
    n = (1 << 60) - 3
    numbers = [0, 1, n - 1, n // 2, 12345678901234567]
    df = spark.createDataFrame([(x,) for x in numbers], "id long")
    got = [r[0] for r in df.select(feistel.permuted(F.col("id"), n, 1)).collect()]
    assert got == [place(x, n, 1) for x in numbers]


def test_shards_of_odd_rows(spark):
    rows = [(i % 50, None if i % 7 == 0 else f"t{i % 9}", i, "x") for i in range(401)] + [(None, None, 1, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard string").repartition(7)
    got = feistel.shard_rows(df, [F.col("doc_id"), F.col("text")], 8)
    assert got.columns == ["doc_id", "text", "shard", "slot"]
    by = defaultdict(list)
    for r in got.collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and sum(map(len, by.values())) == len(rows)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(got) == key(feistel.shard_rows(df.repartition(2), [F.col("doc_id"), F.col("text")], 8))
    assert feistel.shard_rows(df.limit(0), [F.col("doc_id")], 8).count() == 0


def test_shard_query_follows_row_numbers(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    order = sorted(docs, key=lambda r: r["doc_id"])
    want = {}
    for k, r in enumerate(order):
        p = place(k, len(order), 1)
        data = (r["text"] or "").encode()
        want[r["doc_id"]] = (len(data) + 1, zlib.crc32(data), "rows", p % 8, p // 8, None)
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) for r in op6_feistel_shards(spark, folder).collect()}
    assert got == want


def test_no_python_in_the_plans(spark, folder):
    for query in (op5_golden_ratio_mix, op6_feistel_shards):
        plan = query(spark, folder)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|MapInArrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_shuffle_key_is_md5_of_id_and_text(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert [r[0] for r in df.select(mixing.shuffle_key("doc_id", "text")).collect()] == [md5("1|" + md5("a")), md5("|" + md5(""))]
