"""WARC archives: round trips, the sequential reader over damaged archives, and writing tasks that fail."""

import gzip
import hashlib
import io
import os
import random

import pytest

from doclake.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long, n int"
ROWS = [
    (1, "http://a", "x" * 200), (2, None, "x" * 200), (2, None, "x" * 200), (None, "u\r\nv: w", "x" * 200), (3, "c", "x" * 99), (4, "c", "x" * 99),
    (5, " ü ", None), (6, "", "é" * 3_000_000), (7, "d", "y" * 100), (7, "d", "y" * 100), (None, "e", "z" * 100), (None, "e", "z" * 100), (9, "f", "\r\n\r\nWARC/1.1\r\n\x1f"),
]


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def wanted():
    least = {}
    for i, _, t in ROWS:
        least[t] = min([x for x in (i, least.get(t)) if x is not None], default=None)
    out = []
    for i, u, t in ROWS:
        first = least[t] if len((t or "").encode()) >= 100 and least[t] is not None and i != least[t] else None
        out.append((i, u, len((t or "").encode()), sha(t), "response" if first is None else "revisit", first, None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [200_000, 0])
def test_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW_DIGESTS", few)
    pages = spark.createDataFrame([(*x, "other", 7, 1) for x in ROWS], SCHEMA).repartition(3)
    got = warc.round_trip(pages, archive_bytes=500)
    assert got.columns == ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"]
    assert sorted(map(tuple, got.collect()), key=repr) == wanted()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_and_archives(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    warc.write_warc(spark.createDataFrame([(*x, "", 7, 1) for x in ROWS], SCHEMA).repartition(3), folder, archive_bytes=500)
    names = (tmp_path / "archives" / warc.LISTING).read_text().split()
    assert len(names) > 3 and sorted(names) == sorted(n for n in os.listdir(tmp_path / "archives") if n.endswith(".gz"))
    got = [r for r in warc.read_warc(spark, folder).collect() if r["record_type"] == "response"]
    held = {sha(t): (t or "").encode() for _, _, t in ROWS}
    assert {r["payload_digest"]: bytes(r["payload"]) for r in got} == held
    for name in names:  # any reader of gzip reads them
        assert gzip.decompress((tmp_path / "archives" / name).read_bytes()).startswith(b"WARC/1.1\r\n")


def packed(i, payload):
    return gzip.compress(warc.record(i, f"http://{i}", payload, hashlib.sha256(payload).hexdigest()))


def test_reader_goes_on_after_damage():
    r = random.Random(3)
    good = [packed(i, bytes(r.choices(range(256), k=r.choice([0, 5, 1000, 300_000])))) for i in range(6)]
    read = lambda data: [(f.get("page_id"), "error" in f) for _, f in warc.read_records(io.BytesIO(data))]
    assert read(b"".join(good)) == [(str(i), False) for i in range(6)]
    for cut in (0, 1, 12, len(good[1]) // 2, len(good[1]) - 3):
        broken = bytearray(good[1])
        broken[cut] ^= 0x55
        got = read(good[0] + bytes(broken) + b"".join(good[2:]))
        if got != [(str(i), False) for i in range(6)]:  # byte 1 of the tail may be beyond what is checked
            assert got == [("0", False), (None, True), *((str(i), False) for i in range(2, 6))], cut
    assert read(good[0] + good[1][:-20]) == [("0", False), (None, True)]
    assert read(b"") == [] and read(b"no archive") == [(None, True)]
    whole = warc.record(1, "u", b"abc" * 50, hashlib.sha256(b"abc" * 50).hexdigest())
    for old, new in ((b"abcabc", b"abcabd"), (b"Content-Length: 150", b"Content-Length: 151"), (b"Content-Length", b"Content-Lenght"), (b"WARC/", b"CRAW/"), (b"\r\n\r\n", b"\r\n")):
        got = read(gzip.compress(whole.replace(old, new)) + good[2])
        assert got == [(None, True), ("2", False)], new


def test_reader_holds_little(monkeypatch):
    import tracemalloc

    data = packed(1, b"\0" * 50_000_000) + packed(2, b"q")
    tracemalloc.start()
    got = [f["payload_bytes"] for _, f in warc.read_records(io.BytesIO(data), payload=False)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [50_000_000, 1] and most < 2_000_000


def test_failed_tasks_leave_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.dataSource.register(warc.Warc)
    broken = F.udf(lambda i: bytes(1 // (5 - i)), "binary")
    rows = spark.range(10).repartition(2).select(F.col("id").cast("string").alias("page_id"), F.lit("u").alias("url"), broken("id").alias("payload"), F.lit("").alias("digest"), F.lit(None).cast("string").alias("first"))
    with pytest.raises(Exception, match="ZeroDivision"):
        rows.write.format("doclake_warc").mode("append").save(f"file://{tmp_path}/a")
    assert not os.path.exists(tmp_path / "a") or os.listdir(tmp_path / "a") == []
