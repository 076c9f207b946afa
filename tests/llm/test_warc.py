import base64
import gzip
import hashlib
import io
import random
import time

import pytest

from itinera.llm.warc import DamagedRecord, archive, checked_payload, parse, read_archives, read_split, record, record_id, round_trip

SCHEMA = "page_id long, url string, html string, digest string, keep_id string"


def test_every_split_owns_its_records():
    rng = random.Random(1)
    records = []
    for i in range(60):
        payload = bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 3000]))) + b"\x1f\x8b\x08" * 3
        if i == 7:
            payload = gzip.compress(b"not a record " * 50) + gzip.compress(b"WARD/1.1") + b"\x1f\x8b\x08\x00\x00"
        records.append(record(i, f"http://x/{i}", payload, None, False))
    data = b"".join(records)
    offsets = [sum(map(len, records[:i])) for i in range(60)]
    for split in (1, 37, 1000, 1 << 20):
        found = []
        for start in range(0, len(data), split):
            found += [(at, h["warc-page-id"]) for at, h, _ in read_split(io.BytesIO(data), len(data), start, min(len(data), start + split))]
        assert found == [(o, str(i)) for i, o in enumerate(offsets)], split


@pytest.mark.parametrize("chunk", [1, 3, 100, 517, 4097, 1 << 18])
def test_no_record_is_lost_where_a_chunk_ends(monkeypatch, chunk):
    """A head that is read in two chunks is a record like any other."""
    monkeypatch.setattr("itinera.llm.warc.CHUNK", chunk)
    records = [record(i, f"http://x/{i}", b"%d" % i * (i % 50), i // 2, i % 3 == 0) for i in range(300 if chunk < 100 else 6000)]
    data = b"".join(records)
    for split in (len(data) // 7, len(data)):
        found = []
        for start in range(0, len(data), split):
            found += [h["warc-page-id"] for _, h, _ in read_split(io.BytesIO(data), len(data), start, min(len(data), start + split))]
        assert found == [str(i) for i in range(len(records))]


def test_damage_between_records_is_skipped():
    good = [record(i, None, b"x" * 100, None, False) for i in range(3)]
    other = gzip.compress(b"no record at all")
    data = good[0] + b"junk \x1f\x8b\x08 junk" + good[1] + other + good[2] + other[:-4]
    assert [h["warc-page-id"] for _, h, _ in read_split(io.BytesIO(data), len(data), 0, len(data))] == ["0", "1", "2"]


def test_damaged_records_are_told():
    """Damage within a record and a cut at its end raise, with the place, from whichever split owns it."""
    rng = random.Random(4)
    good = [record(i, None, rng.randbytes(3000), None, False) for i in range(6)]
    at = len(good[0]) + len(good[1])
    broken = good[2][:1500] + b"\xff" * 8 + good[2][1508:]
    for data, place in ((b"".join([*good[:2], broken, *good[3:]]), at), (b"".join(good[:5]) + good[5][:-9], sum(map(len, good[:5])))):
        for split in (500, 1 << 20):
            with pytest.raises(DamagedRecord, match=f"byte {place}:"):
                for start in range(0, len(data), split):
                    list(read_split(io.BytesIO(data), len(data), start, min(len(data), start + split)))


def test_a_large_payload_is_read_in_linear_time():
    payload = random.Random(2).randbytes(50_000_000)
    data = record(1, None, b"a", None, False) + record(2, None, payload, None, False)
    began = time.process_time()
    found = list(read_split(io.BytesIO(data), len(data), 0, len(data)))
    assert checked_payload(*found[1][1:]) == payload and time.process_time() - began < 20


def test_record_is_plain_warc():
    headers, block = parse(gzip.decompress(record(5, "http://a/\r\nx", "é".encode(), None, False)))
    assert block.endswith(b"\r\n\r\n" + "é".encode()) and block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert checked_payload(headers, block) == "é".encode() and headers["warc-target-uri"] == "http://a/%0D%0Ax"
    assert headers["content-length"] == str(len(block)) and {"warc-date", "content-type", "warc-record-id", "warc-type"} <= set(headers)
    again, empty = parse(gzip.decompress(record(7, "http://a/", "é".encode(), 5, True)))
    assert again["warc-refers-to"] == headers["warc-record-id"] != again["warc-record-id"] and not empty
    assert record_id("revisit", 7, "D", "0/1") != record_id("revisit", 7, "D", "0/2")


def test_damaged_payload_is_told():
    headers, block = parse(gzip.decompress(record(5, "http://a/", b"abc", None, False)))
    with pytest.raises(ValueError):
        checked_payload(headers, block[:-1] + b"d")


def brute(rows):
    first = {}
    for page_id, html in rows:
        first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = set()
    for page_id, html in rows:
        data = (html or "").encode()
        response = first[html or ""] == page_id
        out.add((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first[html or ""]))
    return out


def test_round_trip_equals_brute_force(spark):
    rows = [(i, f"<p>page {i} ü𝒳</p>" * (i % 40)) for i in range(200)] + [(i, "hot page") for i in range(300, 500)]
    rows += [(600, None), (601, ""), (602, "y" * 900_000)]
    df = spark.createDataFrame([(i, f"http://h/{i}", h, "d", "k") for i, h in rows], SCHEMA).repartition(3)
    for split in (1 << 20, 700):
        got = round_trip(df, split).collect()
        assert len(got) == len(rows)
        assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(rows)


def test_archives_of_many_chunks_return_every_page(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", "", None, f"page {rng.random()}", "é" * rng.randrange(3000)])) for i in rng.sample(range(10**9), 8000)]
    got = round_trip(spark.createDataFrame([(i, f"http://h/{i}", h, "d", "k") for i, h in rows], SCHEMA).coalesce(1)).collect()
    assert len(got) == len(rows)
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", "a", "", ""), (1, "u", "a", "", ""), (None, "u", "a", "", ""), (None, None, "b", None, None)]
    got = round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("1", "response", None), ("1", "revisit", 1), ("None", "response", None), ("None", "revisit", 1)]


def test_blocks_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "text é", "", "")], SCHEMA)
    assert bytes(read_archives(spark, archive(df)).first().payload).decode() == "text é"
    assert round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
