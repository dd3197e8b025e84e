"""WARC bundles: round trips, the format as other readers see it, and odd rows."""

import glob
import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from concord.llm import warc

PAGES = "page_id long, url string, html string"


def pages(spark, n=60):
    r = random.Random(11)
    bodies = ["", "x" * 99, "y" * 100, "é" * 50, "z" * 5_000] + ["".join(r.choice("abc<>é😀\r\n ") for _ in range(r.randint(0, 3_000))) for _ in range(12)]
    rows = [(i, r.choice([None, "", "http://a.example/x y\r\nEvil: 1", "http://b.example/é"]), r.choice([None, *bodies])) for i in r.sample(range(1000), n)]
    return rows, spark.createDataFrame(rows, PAGES)


def brute(rows):
    bodies = [(i, (t or "").encode()) for i, _, t in rows]
    head = {}
    for i, b in bodies:
        if len(b) >= 100 and i is not None:
            head[b] = min(i, head.get(b, i))
    out = []
    for i, b in bodies:
        first = head.get(b)
        again = first is not None and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def answers(records):
    return sorted((tuple(r) for r in warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("frame_bytes,bundle_bytes", [(1, 1), (4_000, 3_000), (1 << 18, 1 << 30)])
def test_round_trip(spark, tmp_path, frame_bytes, bundle_bytes):
    rows, df = pages(spark)
    index = warc.write_bundles(df.repartition(3), str(tmp_path / "w"), frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)
    records = warc.read_records(index)
    assert answers(records) == brute(rows)
    # the payload itself comes back, and a look-up by identifier finds the same record
    texts = {i: (t or "").encode() for i, _, t in rows}
    full = records.where("record_type = 'response'").collect()
    assert all(bytes(r.payload) == texts[r.page_id] for r in full)
    some = warc.read_records(index.where(F.col("record_id").isin([r.record_id for r in full[:5]]))).collect()
    assert sorted(bytes(r.payload) for r in some) == sorted(bytes(r.payload) for r in full[:5])
    # an index that is lost is found anew in the bundles
    key = lambda df: sorted(tuple(r) for r in df.select("record_id", "bundle", "frame", "start", "length").collect())
    assert key(warc.rebuild_index(index)) == key(index)


def test_format_by_other_readers(spark, tmp_path):
    rows, df = pages(spark)
    warc.write_bundles(df.coalesce(1), str(tmp_path / "w"), frame_bytes=4_000)
    (path,) = glob.glob(f"{tmp_path}/w/*.warc.zst")
    with open(path, "rb") as f:
        data = f.read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # a plain reader skips the seek table
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and whole.endswith(b"\r\n\r\n") and whole.count(b"\r\nWARC-Record-ID: ") == len(rows)
    assert b"\r\nEvil" not in whole and b"x%20y%0D%0AEvil" in whole  # a url cannot add fields
    n, flags, mark = struct.unpack("<IBI", data[-9:])
    (magic, size) = struct.unpack("<II", data[-9 - 8 * n - 8 : -9 - 8 * n])
    assert (mark, flags, magic, size) == (0x8F92EAB1, 0, 0x184D2A5E, 8 * n + 9) and n > 3
    assert sum(struct.unpack(f"<{2 * n}I", data[-9 - 8 * n : -9])[0::2]) + 8 * n + 17 == len(data)


def test_what_failed_attempts_leave_is_not_read(spark, tmp_path):
    rows, df = pages(spark)
    index = warc.write_bundles(df, str(tmp_path / "w"))
    (tmp_path / "w" / "000000-999-0.warc.zst").write_bytes(b"half a bund")
    assert answers(warc.read_records(index)) == brute(rows)
    path = index.first().bundle
    with open(path, "r+b") as f:
        f.seek(20)
        f.write(b"\x00\xff\x00")
    with pytest.raises(Exception, match="ZstdError|decompress|payload"):
        warc.read_records(index).count()


def test_odd_rows(spark, tmp_path):
    body = "w" * 200
    rows = [(None, None, None), (None, "u", body), (5, "u", body), (5, "u", body), (5, "v", "other" * 40), (7, None, body), (8, "", ""), (9, "u", "q" * 150_000), (None, "t", "p" * 120), (None, "t", "p" * 120)]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("clash") for c in ("digest", "head", "n", "refers_to", "payload", "bundle", "frame", "record_id", "record_type")})
    assert answers(warc.read_records(warc.write_bundles(df, str(tmp_path / "a")))) == brute(rows)
    empty = warc.write_bundles(df.limit(0), str(tmp_path / "b"))
    assert empty.count() == 0 and answers(warc.read_records(empty)) == []


def test_many_repeats_are_dealt(spark, tmp_path, monkeypatch):
    from concord.operators import joins

    monkeypatch.setattr(joins, "FEW_ROWS", -1)
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    rows = [(i, "u", ("h" * 500 if i % 3 else f"{i}" * 60)) for i in range(300)]
    assert answers(warc.read_records(warc.write_bundles(spark.createDataFrame(rows, PAGES), str(tmp_path / "w")))) == brute(rows)
