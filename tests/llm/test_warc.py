"""Archives written and read back, and what the reader passes over."""

import gzip
import hashlib
import io
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from odflux.llm import warc
from odflux.llm.warc import member, read_pages, records, scan, write_pages

SCHEMA = "page_id long, url string, html string, digest string, page long, `first` string, payload string"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.fixture(scope="module")
def rows():
    body = "<p>" + "ä" * 60 + "</p>"
    out = [(k, f"http://x/{k}", f"<html>{k}" + "word " * (k * 7)) for k in range(40)]
    out += [(k, f"http://y/{k}", body) for k in range(100, 160)]  # one payload, many times
    out += [(3, "http://x/3", out[3][2]), (20, "http://x/20", out[20][2]), (20, "http://x/20", out[20][2])]
    out += [(200, None, None), (201, "u", ""), (202, "u\r\nWARC-Type: x", "short"), (203, "u", "short"), (None, "n", body), (None, None, None)]
    out += [(204, "u", "y" * 99), (205, "u", "y" * 99), (206, "u", "z" * 100), (207, "u", "z" * 100)]
    out += [(208, "u", "WARC/1.1\r\n\r\n\x1f\x8b" * 30000), (209, "u", "a\r\n\r\nb \x00 \U0001f600" * 20)]
    return [(*r, "clash", 1, "clash", "clash") for r in out]


def plain(rows):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for page_id, _, html, *_ in order:
        data = (html or "").encode()
        digest, again = hashlib.sha256(data).hexdigest(), None
        if len(data) >= 100:
            again = first.get(digest)
            first.setdefault(digest, (page_id,))
        out.append((page_id, len(data), digest, "revisit" if again else "response", again[0] if again else None))
    return out


def ordered(found):
    return sorted(found, key=lambda r: tuple((v is None, v) for v in r))


@pytest.fixture(scope="module")
def folder(spark, rows):
    return write_pages(spark.createDataFrame(rows, SCHEMA).repartition(3))


def files(folder):
    return sorted(Path(folder.removeprefix("file:")).glob("*.warc.gz"))


def test_round_trip(spark, rows, folder):
    got = [tuple(r) for r in read_pages(spark, folder).select(COLUMNS).collect()]
    assert ordered(got) == ordered(plain(rows))
    texts = scan(spark, folder, "record_type = 'response'", ["record_type", "payload"]).collect()
    first = {h or "" for _, _, h, *_ in rows}
    assert {bytes(t.payload).decode() for t in texts} == first


def test_any_gzip_reader_inflates_the_files(folder):
    for file in files(folder):
        data = gzip.decompress(file.read_bytes())
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")
        found = list(records(io.BytesIO(data), len(data)))
        assert [f for f, *_ in found] == [f for f, *_ in records(io.BytesIO(file.read_bytes()), file.stat().st_size)]


@pytest.mark.parametrize("test", [
    "record_type = 'revisit'", "record_type in ('revisit', 'x')", "refers_to is not null", "target_uri like 'http://x/%'", "target_uri <=> null",
    "record_type = 'response' and target_uri is not null",
])
def test_filters_reach_the_reader(spark, folder, test):
    found = scan(spark, folder, test)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", ""), plan
    ids = scan(spark, folder).select("record_id", F.coalesce(F.expr(test), F.lit(False)).alias("keep")).collect()
    assert sorted(r.record_id for r in found.collect()) == sorted(r.record_id for r in ids if r.keep)
    assert 0 < found.count() < len(ids)


def test_other_filters_stay_with_spark(spark, folder):
    kinds = [(r.record_type, r.content_length) for r in scan(spark, folder).collect()]
    found = scan(spark, folder, "content_length > 200 and record_type = 'response'", ["record_type", "content_length"])
    assert found.count() == sum(k == "response" and n > 200 for k, n in kinds)
    both = scan(spark, folder, "record_type = 'revisit'").union(scan(spark, folder, "record_type = 'response'"))
    assert both.count() == len(kinds)


def spoiled(n=5, size=200_000):
    """Members whose payloads cannot be inflated, between good ones; random bytes do not shrink."""
    out = []
    for k in range(n):
        body = b"".join(hashlib.sha256(b"%d %d" % (k, i)).digest() for i in range(size // 32))
        kind = "response" if k % 2 else "revisit"
        data = bytearray(member(warc.head("WARC/1.1", [("WARC-Type", kind), ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n"))
        if k % 2:
            for at in range(len(data) // 2, len(data) - 100):
                data[at] = 0xFF
        out.append(bytes(data))
    return b"".join(out)


def test_unwanted_payloads_are_not_inflated():
    data = spoiled()
    kept = list(records(io.BytesIO(data), len(data), lambda f: f["warc-type"] == "revisit"))
    assert len(kept) == 3 and all(len(b) == 200_000 for _, _, b in kept)
    with pytest.raises((zlib.error, ValueError)):
        list(records(io.BytesIO(data), len(data)))
    # Nor are they where only headers are asked for.
    assert len(list(records(io.BytesIO(data), len(data), payload=False))) == 5


def sample(n=30):
    for k in range(n):
        body = (b"text %d " % k) * (k * 500)
        yield warc.head("WARC/1.0", [("WARC-Type", "resource" if k % 3 else "metadata"), ("X-Folded", "a"), ("Content-Length", str(len(body)))]) + body + b"\r\n\r\n"


@pytest.mark.parametrize("wrap", [lambda r: r, gzip.compress, member], ids=["plain", "foreign gzip", "own gzip"])
@pytest.mark.parametrize("payload", [True, False])
def test_all_layouts_read_alike(wrap, payload):
    data = b"".join(map(wrap, sample()))
    for wanted in (lambda f: True, lambda f: f["warc-type"] == "metadata"):
        found = list(records(io.BytesIO(data), len(data), wanted, payload))
        assert [f["content-length"] for f, *_ in found] == [
            str(len((b"text %d " % k) * (k * 500))) for k in range(30) if wanted({"warc-type": "resource" if k % 3 else "metadata"})
        ]
        assert all((b is None) != payload and (b is None or len(b) == int(f["content-length"])) for f, _, b in found)


@pytest.mark.parametrize("wrap", [lambda r: r, gzip.compress, member], ids=["plain", "foreign gzip", "own gzip"])
def test_cut_off_records_are_errors(wrap):
    data = b"".join(map(wrap, sample(4)))[:-30]
    with pytest.raises((ValueError, zlib.error)):
        list(records(io.BytesIO(data), len(data)))
    with pytest.raises(ValueError):
        list(records(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n"), 19))


def test_files_are_planned_by_size(spark, folder):
    warc.register(spark)
    read = spark.read.format("warc").schema("record_type string")
    assert read.load(folder).rdd.getNumPartitions() == 1
    assert read.load(str(files(folder)[0])).count() < read.load(folder).count()
    assert read.option("partitionBytes", 1).load(folder).rdd.getNumPartitions() == len(files(folder)) > 1


def test_small_files_overwriting_and_no_rows(spark, rows, tmp_path):
    frame = spark.createDataFrame(rows, SCHEMA)
    target = str(tmp_path / "a")
    write_pages(frame, target)
    before = files(target)
    spark.read.format("warc").load(target).select(
        "record_type", "record_id", "target_uri", "refers_to", F.lit("2020-02-02T00:00:00Z").alias("date"), "payload_digest",
        F.col("http_headers")["content-length"].cast("long").alias("payload_length"), "payload",
    ).write.format("warc").option("fileBytes", 2000).mode("overwrite").save(target)
    assert not set(before) & set(files(target)) and len(files(target)) > len(before)
    got = [tuple(r) for r in read_pages(spark, target).select(COLUMNS).collect()]
    assert ordered(got) == ordered(plain(rows))
    assert scan(spark, target, None, ["date"]).distinct().collect() == [("2020-02-02T00:00:00Z",)]
    none = write_pages(frame.limit(0), str(tmp_path / "b"))
    assert files(none) == [] and read_pages(spark, none).collect() == []
    assert not list(Path(target).glob(".draft*"))


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    warc.register(spark)
    frame = spark.range(20).selectExpr(
        "'response' as record_type", "cast(id as string) as record_id", "cast(if(id = 13, raise_error('stop'), id) as long) as payload_length", "cast('x' as binary) as payload"
    ).repartition(4)
    with pytest.raises(Exception, match="stop"):
        frame.write.format("warc").mode("append").save(str(tmp_path / "c"))
    assert files(str(tmp_path / "c")) == []
