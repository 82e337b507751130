import re

import pytest
from pyspark.sql import functions as F

from uttera.functions import hashing, text
from uttera.operators import chunks, redact


def one(spark, value, fn, *more):
    df = spark.createDataFrame([(value, *more)], "a string" + "".join(f", x{i} string" for i in range(len(more))))
    return df.select(fn(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize(
    "raw, lower, want",
    [
        (" Це   Тест ", True, "це тест"),
        (" Це   Тест ", False, "Це Тест"),
        ("Привіт , світе!", False, "Привіт, світе!"),
        (" «так» ’ні’ \t\x85 ok", True, "\"так\" 'ні' ok"),
        ("a , . b", True, "a,. b"),
        ("", True, ""),
    ],
)
def test_normalize(spark, raw, lower, want):
    assert one(spark, raw, lambda c: text.normalize_transcript(c, lower)) == want


def test_white_space_is_that_of_python():
    spaces = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(text.OTHER_WS) | {" "} == spaces


@pytest.mark.parametrize("raw", ["a b  c", "", "   ", "\tx y ", "one", "😀 b　c"])
def test_counts(spark, raw):
    assert one(spark, raw, text.char_count) == sum(not c.isspace() for c in raw)
    assert one(spark, raw, text.word_count) == len(raw.split())
    assert one(spark, raw, text.normalize_ws) == re.sub(r"\s+", " ", raw).strip()


def test_normalized_counts(spark):
    for value in ("", "a", "ab c d'e"):
        df = spark.createDataFrame([(value,)], "a string").select(*text.normalized_counts(F.col("a")))
        assert tuple(df.first()) == (len(value.replace(" ", "")), len(value.split()))


@pytest.mark.parametrize("raw, want", [("", 1.0), ("a-b'c d", 0.0), ("a!!b", 0.5), ("є😀", 0.5)])
def test_symbol_ratio(spark, raw, want):
    assert one(spark, raw, text.symbol_ratio) == want


@pytest.mark.parametrize(
    "left, right, want",
    [("a", "b", "a b"), ("", "b", "b"), ("a", "", "a"), ("a ", "b", "a b"), ("a", ", b", "a, b"), ("a\n", "b", "a\nb")],
)
def test_join(spark, left, right, want):
    assert one(spark, left, text.join_transcripts, right) == want


def merge_by_hand(old, new):
    """Plain restatement of the merge rules for the test."""
    if not old or not new:
        return old or new
    if new in old or old in new:
        return old if new in old else new
    a, b = old.split(" "), new.split(" ")
    for k in range(min(len(a), len(b), 20), 0, -1):
        if a[len(a) - k :] == b[:k]:
            return " ".join(a + b[k:])
    for k in range(min(len(old), len(new), 120), 8, -1):
        if old.endswith(new[:k]):
            return old + new[k:]
    return old + ("" if new[0] in ",.!?:;" else " ") + new


def test_merge_chunks(spark):
    cases = {
        "words": ["one two three four", "three four five", "five six"],
        "letters": ["abcdefghijkl mnopqr", "jkl mnopqrst uv"],
        "inside": ["the whole text here", "whole text", "here , and more"],
        "punctuation": ["first part", ", second"],
        "empty": ["", "  ", "x"],
        "longer": ["bc", "a bc d"],
        "repeat": ["a a a", "a a b"],
    }
    rows = [(k, i, t) for k, parts in cases.items() for i, t in enumerate(parts)]
    df = spark.createDataFrame(rows, "rec string, i int, t string").orderBy(F.desc("i"))
    got = {r["rec"]: r["transcript"] for r in chunks.merge_chunks(df, "rec", "i", "t").collect()}
    for key, parts in cases.items():
        want = ""
        for part in parts:
            want = merge_by_hand(want, " ".join(part.split()))
        assert got[key] == want, key


def test_merge_chunks_on_random_windows(spark):
    """Few words and letters, so that overlaps of any size, containment and near misses are frequent."""
    import random

    rng, rows = random.Random(7), []
    for rec in range(400):
        letters = rng.choice(["ab", "a", "ab.,", "é😀", "a$\\(", "abcdefghijklmnopq"])
        words = ["".join(rng.choices(letters, k=rng.choice([1, 2, 5, 12]))) for _ in range(rng.choice([2, 5, 40]))]
        source = " ".join(rng.choices(words, k=rng.choice([3, 30, 300])))
        at = 0
        for i in range(rng.randint(1, 12)):
            rows.append((rec, i, source[at : at + rng.choice([3, 20, 60, 400])]))
            at = max(0, at + rng.choice([-15, 0, 2, 10, 18, 55, 150, 390]))
    df = spark.createDataFrame(rows, "rec int, i int, t string")
    got = {r["rec"]: r["transcript"] for r in chunks.merge_chunks(df, "rec", "i", "t").collect()}
    want = dict.fromkeys(got, "")
    for rec, _, part in rows:
        want[rec] = merge_by_hand(want[rec], " ".join(part.split()))
    assert got == want


def test_merge_chunks_tries_no_size_one_by_one(spark):
    """The overlap is found by matching; a loop over 20 and 112 sizes at each window took most of the query's time."""
    df = spark.createDataFrame([(1, 0, "a b"), (1, 1, "b c"), (2, 0, "x"), (2, 1, None)], "rec int, i int, t string")
    merged = chunks.merge_chunks(df, "rec", "i", "t")
    assert "sequence(" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert {r["rec"]: r["transcript"] for r in merged.collect()} == {1: "a b c", 2: None}


def test_chunk_plan(spark):
    df = spark.createDataFrame([(1, 16000 * 40), (2, 16000 * 60), (3, 16000 * 55)], "id int, num_samples bigint")
    got = [(r["id"], r["chunk"], r["start"] // 16000, r["end"] // 16000) for r in chunks.chunk_plan(df).collect()]
    assert sorted(got) == [(1, 0, 0, 40), (2, 0, 0, 30), (2, 1, 25, 55), (2, 2, 50, 60), (3, 0, 0, 30), (3, 1, 25, 55)]
    with pytest.raises(ValueError):
        chunks.chunk_plan(df, length=5.0, overlap=5.0)


def test_names(spark):
    assert one(spark, "ok-1.a_b", text.safe_id) == "ok-1.a_b"
    changed = one(spark, "a/b c", text.safe_id)
    assert changed.startswith("a_b_c_") and len(changed) == len("a_b_c_") + 8
    assert len(one(spark, "///", text.safe_id)) == 16
    df = spark.createDataFrame([(7, "x/y é.WAV"), (8, "...")], "i int, c string")
    assert [r[0] for r in df.select(text.preview_name(F.col("i"), F.col("c"))).collect()] == [
        "sample_000007_x_y_", "sample_000008_utt8",
    ]
    assert one(spark, "https://h/a/b.TSV?x=1", text.source_suffix) == ".tsv"
    assert one(spark, "owner/data", text.is_hub_id) is True
    assert one(spark, "./data", text.is_hub_id) is False


def test_unit_hash(spark):
    import hashlib

    for key in ("a", "спікер", "42"):
        want = int(hashlib.sha256(f"13:{key}".encode()).hexdigest()[:16], 16) / float(16**16)
        assert one(spark, key, lambda c: hashing.unit_hash(c, 13)) == want


def test_redaction(spark):
    secret = "hf_abcdefghijklmnopqrstuvwxyz123456"
    rows = [(secret, "Bearer " + secret, {"api_key": "x", "name": "y"}, (secret, "plain"), [secret, "z"])]
    schema = "hf_token string, note string, m map<string,string>, s struct<authorization:string,other:string>, l array<string>"
    row = redact.redact(spark.createDataFrame(rows, schema)).first()
    assert row["hf_token"] == redact.REDACTED
    assert row["note"] == f"Bearer {redact.REDACTED}"
    assert row["m"] == {"api_key": redact.REDACTED, "name": "y"}
    assert tuple(row["s"]) == (redact.REDACTED, "plain")
    assert row["l"] == [redact.REDACTED, "z"]
    body = '{"training_args": {"api_key": "%s", "repo": "a/b"}, "n": 1}' % secret
    out = one(spark, body, redact.redact_json)
    assert secret not in out and '"repo": "a/b"' in out


def test_nothing_below_a_secret_name_is_shown(spark):
    schema = (
        "api_keys array<string>, secret int, m map<string,array<string>>, s struct<token:struct<a:string,n:int>,ok:string>, "
        "l array<struct<password:string,x:int>>, text string, n map<int,string>"
    )
    rows = [(["a", None, "b"], 7, {"token": ["t"], "names": ["sk-abcdefghij0123456789"]}, (("deep", 5), "fine"), [("p", 1), None],
             "password=hunter2 and token: 'x y' api_key = \"q\" secret:z", {1: "passwd=1"})]
    row = redact.redact(spark.createDataFrame(rows, schema)).first()
    mark = redact.REDACTED
    assert row["api_keys"] == [mark, None, mark] and row["secret"] is None
    assert row["m"] == {"token": [mark], "names": [mark]} and row["n"] == {1: f"passwd={mark}"}
    assert (tuple(row["s"]["token"]), row["s"]["ok"]) == ((mark, None), "fine")
    assert [x and tuple(x) for x in row["l"]] == [(mark, 1), None]
    assert row["text"] == f'password={mark} and token: "{mark}" api_key = "{mark}" secret:{mark}'


def test_json_values_of_any_type(spark):
    mark = f'"{redact.REDACTED}"'
    cases = {
        '{"api_key":12345,"n":1}': f'{{"api_key":{mark},"n":1}}',
        '{"token":["abcdef",{"x":"]"}], "a":[1]}': f'{{"token":{mark}, "a":[1]}}',
        '{"password":{"v":"hunter2"}}': f'{{"password":{mark}}}',
        '{"secret": true, "x": {"access_key": -1.5e3}}': f'{{"secret": {mark}, "x": {{"access_key": {mark}}}}}',
        '{"token":["cut': f'{{"token":{mark}',
        '{"a":"token","b":[1,2]}': '{"a":"token","b":[1,2]}',
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(redact.redact_json(F.col("c"))).collect()] == list(cases.values())
