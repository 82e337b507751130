"""Tab-separated manifests of differing headers: headers in tasks, one scan, and a stream."""

import os

import pytest
from pyspark.sql import functions as F

from uttera.sources import files, manifests, tsv
from uttera.streaming import jobs


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8", newline="") as out:
        out.write(text)


@pytest.fixture
def mixed(tmp_path):
    root = str(tmp_path / "m")
    put(root, "a.tsv", 'id\tsentence\tpath\n1\tthe "one"\tx.wav\n2\t\ty.wav\n3\t""\t\n')
    put(f"{root}/deep", "b.tsv", '﻿path\tid\tclient_id\r\nz.wav\t4\tann\r\n\t5\t"a ""b"" c"\r\n')
    put(root, "c.tsv", "id\tsentence\tpath\n6\tshort\n7\t long  \tq.wav\tsurplus\n\n8\tno end\tw.wav")
    put(root, "empty.tsv", "")
    put(root, "only.tsv", "id\tother\n")
    put(root, "_hidden.tsv", "id\n99\n")
    return root


WANT = [("1", 'the "one"', "x.wav", None), ("2", None, "y.wav", None), ("3", "", None, None), ("4", None, "z.wav", "ann"),
        ("5", None, None, 'a "b" c'), ("6", "short", None, None), ("7", " long  ", "q.wav", None), ("8", "no end", "w.wav", None)]


@pytest.mark.parametrize("size", [1, 7, 30, 1 << 20])
def test_one_scan_over_all_headers_at_any_range(spark, mixed, monkeypatch, size):
    columns = ["id", "sentence", "path", "client_id"]
    reader = tsv.TsvReader(tsv.schema_of(columns), {"roots": f'["{mixed}"]', "range": str(size)})
    rows = [tuple(r.values()) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert sorted(rows) == WANT


def test_columns_of_all_files_in_one_plan(spark, mixed):
    found = manifests.read_mixed_tsv(spark, mixed)
    assert set(found.columns) - {""} == {"id", "sentence", "path", "client_id", "other"}
    assert sorted(map(tuple, found.select("id", "sentence", "path", "client_id").collect())) == WANT
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("BatchScan") == 1


def test_equal_to_scans_by_header(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = spark.range(500).select(F.col("id").cast("string"), F.concat(F.lit("täxt \"q\" "), F.col("id")).alias("sentence"), F.lit(None).cast("string").alias("path"))
    manifests.write_tsv(rows, f"{path}/a")
    manifests.write_tsv(rows.select(F.lit(" c").alias("client"), "sentence", F.concat("id", F.lit("x")).alias("id")), f"{path}/b")
    old, new = manifests.read_tsv(spark, path), manifests.read_mixed_tsv(spark, path)
    assert sorted(old.columns) == sorted(new.columns)
    assert sorted(map(str, old.select(*new.columns).collect())) == sorted(map(str, new.collect()))


def test_headers_are_read_in_tasks(spark, mixed, monkeypatch):
    def never(*_):
        raise AssertionError("the driver opens a file")

    monkeypatch.setattr(files, "first_line", never)
    assert manifests.read_tsv(spark, f"{mixed}/a.tsv").count() == 3
    monkeypatch.setattr(tsv, "HEADERS", 1)
    found = files.list_files(spark, mixed)
    assert [tsv.header_names(h)[0] for h in tsv.headers(spark, found)] == ["id", "id", "path", "", "id"]


def test_stream_over_files_of_different_columns_and_restarts(spark, tmp_path):
    root, out, ckpt, log = (str(tmp_path / n) for n in ("in", "out", "ckpt", "log"))
    steps = [
        [("a.tsv", "id\tsentence\n1\tone\n")],
        [("b.tsv", "sentence\tpath\tid\ntwo\tp\t2\n"), ("c.tsv", "id\n3\n")],
        [],
        [("0.tsv", "path\tid\told\nq\t4\tz\n")],
    ]
    for step in steps:
        for name, text in step:
            put(root, name, text)
            os.utime(f"{root}/{name}", (1, 1) if name == "0.tsv" else None)  # an old time does not hide a new file
        os.makedirs(root, exist_ok=True)
        stream = manifests.stream_tsv(spark, root, ["id", "sentence", "path"], log)
        jobs.drain(stream, out, ckpt)
    rows = [tuple(r) for r in spark.read.parquet(out).select("id", "sentence", "path").collect()]
    assert sorted(rows) == [("1", "one", None), ("2", "two", "p"), ("3", None, None), ("4", None, "q")]


def test_a_stream_plans_a_step_again_as_it_was(tmp_path):
    root, log = str(tmp_path / "in"), str(tmp_path / "log")
    put(root, "a.tsv", "id\n1\n")
    options = {"roots": f'["{root}"]', "log": log}
    first = tsv.TsvStream(tsv.schema_of(["id"]), options)
    end = first.latestOffset()
    put(root, "b.tsv", "id\n2\n")
    again = tsv.TsvStream(tsv.schema_of(["id"]), options)
    planned = [[r[0].rsplit("/", 1)[1] for r in p.ranges] for p in again.partitions({"step": 0}, end)]
    assert planned == [["a.tsv"]] and again.latestOffset() == {"step": 2} and again.latestOffset() == {"step": 2}
    assert [b.to_pydict() for p in again.partitions(end, {"step": 2}) for b in again.read(p)] == [{"id": ["2"]}]
