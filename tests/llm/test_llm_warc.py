import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from uttera.llm import warc_chunks as wc

PAGES = "page_id long, url string, html string, chunk string, kept long"


def pages(spark):
    big = "<p>größe</p>\r\n\r\nWARC/1.1\r\n" * 60
    rows = [
        (1, "http://a/ b\r\nX: y", big), (2, None, big), (9, "http://c/é", big), (9, "http://c/d", big), (None, "http://n", big),
        (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", "x" * 1000), (6, "u", "x" * 1000), (7, "", None), (8, "e", ""),
        (None, "twin", "z" * 1500), (None, "twin", "z" * 1500), (10, "long", "ß0123456789" * 50000), (11, "once", "q" * 5000),
    ]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES)


def expected(rows):
    out, kept = [], {}
    for p, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000 and p is not None:
            kept[body] = max(kept.get(body, p), p)
    for p, _, html in rows:
        body = (html or "").encode()
        top = kept.get(body)
        revisit = top is not None and p != top
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_round_trip_of_odd_pages(spark):
    rows, df = pages(spark)
    got = wc.through_archives(df.repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
    assert wc.through_archives(df.limit(0)).count() == 0


@pytest.mark.parametrize(("chunk", "segment"), [(7, 1), (64, 3000), (1 << 20, 1 << 30)])
def test_chunks_carry_the_payload_and_running_digests(spark, tmp_path, chunk, segment):
    rows, df = pages(spark)
    rows = [r for r in rows if len(r[2] or "") < 10000]
    small = df.filter(F.coalesce(F.length("html"), F.lit(0)) < 10000).coalesce(2)
    index = wc.write_archives(wc.chunked(wc.plan_records(small), chunk), str(tmp_path / "w"), segment)
    found = wc.read_archives(index, chunk).collect()
    payloads, uris = {}, {}
    for r in sorted(found, key=lambda r: (r["record_id"], r["uri"] or "", r["chunk_no"])):
        key = (r["record_id"], r["uri"])
        whole = payloads[key] = payloads.get(key, b"") + bytes(r["chunk"])
        uris[key] = r["uri"]
        if r["record_type"] == "response" and r["page_id"] not in (9, None):
            assert r["payload_bytes"] == len(whole) and r["payload_digest"] == hashlib.sha1(whole).hexdigest()
    assert sum(r["last"] for r in found) == len(rows)
    assert max(len(r["chunk"]) for r in found) <= chunk
    assert not any(c in (u or "") for u in uris.values() for c in " \r\n")
    assert sum(r["records"] for r in index.collect()) == len(rows)


def test_urls_of_several_megabytes(spark, tmp_path):
    rows = [(1, "http://a/" + "é /" * 1_500_000, "x" * 1200), (2, "http://b/" + "y" * 3_000_000, "x" * 1200), (3, "u", "z" * 10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = wc.through_archives(df.repartition(2)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
    index = wc.write_archives(wc.chunked(wc.plan_records(df.coalesce(1))), str(tmp_path / "w"), 1)
    uris = {r["page_id"]: r["uri"] for r in wc.read_archives(index).filter("last").collect()}
    assert uris == {p: u.replace(" ", "%20") for p, u, _ in rows}
    assert min(r["longest_header"] for r in index.collect()) < 2000  # the short one's segment stays bounded by its own


def test_only_indexed_files_are_read(spark, tmp_path):
    _, df = pages(spark)
    index = wc.write_archives(wc.chunked(wc.plan_records(df)), str(tmp_path / "w"))
    (tmp_path / "w" / "part-00000-99-left.warc.gz").write_bytes(b"what a failed attempt left")
    assert wc.read_archives(index, payload=False).filter("last").count() == df.count()


def rewritten(spark, tmp_path, change):
    """The index of a one-record archive whose file has been changed."""
    df = spark.createDataFrame([(1, "u", "hello world")], "page_id long, url string, html string")
    wc.write_archives(wc.chunked(wc.plan_records(df)), str(tmp_path / "w"))
    path = next((tmp_path / "w").glob("*.warc.gz"))
    path.write_bytes(change(path.read_bytes()))
    return spark.createDataFrame([(str(path), 0, path.stat().st_size, 1)], wc.INDEX)


@pytest.mark.parametrize(
    ("change", "told"),
    [
        (lambda b: gzip.compress(gzip.decompress(b).replace(b"hello", b"jello")), "does not have its digest"),
        (lambda b: b[:-20], "ends within a"),
        (lambda b: gzip.compress(gzip.decompress(b)[:-9]), "ends within a record"),
        (lambda b: gzip.compress(b"no archive" + b"\r\n\r\n" * 2), "no WARC record"),
    ],
)
def test_a_damaged_archive_stops_the_read(spark, tmp_path, change, told):
    with pytest.raises(Exception, match=told):
        wc.read_archives(rewritten(spark, tmp_path, change)).collect()


def test_archives_are_plain_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://u", "hi")], "page_id long, url string, html string")
    wc.write_archives(wc.chunked(wc.plan_records(df)), str(tmp_path / "w"))
    head, http, rest = gzip.decompress(next((tmp_path / "w").glob("*.warc.gz")).read_bytes()).split(b"\r\n\r\n", 2)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and rest == b"hi\r\n\r\n"
    assert int(fields[b"Content-Length"]) == len(http) + 4 + 2


def test_many_segments_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wc, "READ_BYTES", 1 << 10)
    rows = [(i, "u", f"{hashlib.sha512(str(i).encode()).hexdigest()} " * 20, "c", 0) for i in range(50)]
    index = wc.write_archives(wc.chunked(wc.plan_records(spark.createDataFrame(rows, PAGES))), str(tmp_path / "w"), 1)
    assert index.count() == 50
    found = wc.read_archives(index, payload=False)
    tasks = found.select("page_id", F.spark_partition_id().alias("task")).collect()
    assert len(tasks) == 50 and len({r["task"] for r in tasks}) > 5
