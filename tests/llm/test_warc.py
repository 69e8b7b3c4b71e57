import hashlib
import io
import random

import pytest

from upshot.llm import warc as A
from upshot.llm.common import scratch_path


def page(i, n):
    body = (f"page {i} " + "x" * n).encode()
    return A.record("response", i, "http://a/", body, hashlib.sha256(body).hexdigest(), None)


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("step", [7, 64, 1 << 20])
def test_salvage(plain, step):
    r = random.Random(1)
    records = [page(i, r.choice([0, 5, 300, 5000])) for i in range(30)]
    parts = [bytearray(x if plain else A.member(x)) for x in records]
    whole = b"".join(map(bytes, parts))
    got = list(A.salvage(io.BytesIO(whole), step))
    assert [g[0] for g in got] == ["record"] * 30 and got[-1][2] == len(whole)
    parts[3][-6] ^= 0x55
    parts[10] = parts[10][:len(parts[10]) // 2]
    parts[20] += b"garbage WARC/1.1\r\n \x1f\x8b\x08 more"
    parts[29] = parts[29][:-5]
    data = b"".join(map(bytes, parts))
    got = list(A.salvage(io.BytesIO(data), step))
    ids = [int(g[3]["warc-record-id"][10:-1]) for g in got if g[0] == "record"]
    assert ids == [i for i in range(30) if i not in (3, 10, 29)]
    assert [g[1] for g in got[1:]] == [g[2] for g in got[:-1]] and got[-1][2] == len(data)  # gaps and records tile the file
    gaps = [data[g[1]:g[2]] for g in got if g[0] == "gap"]
    assert gaps[0] == bytes(parts[3]) and gaps[1] == bytes(parts[10]) and gaps[3] == bytes(parts[29])


def test_nothing_to_salvage():
    assert list(A.salvage(io.BytesIO(b""), 10)) == []
    assert [g[:3] for g in A.salvage(io.BytesIO(b"nothing"), 3)] == [("gap", 0, 7)]


def test_payload_with_line_ends_and_headers():
    body = b"\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    data = A.record("response", -4, "http://a\r\nX: y", body, hashlib.sha256(body).hexdigest(), None)
    (one,) = A.salvage(io.BytesIO(data), 5)
    assert one[4] == body and one[3]["warc-target-uri"] == "http://aX: y"


def test_round_trip(spark):
    long = "é" * 200
    rows = [(1, "u", long, "x"), (2, "u", long, "x"), (-3, None, long, "x"), (4, "u", "short", "x"), (5, "u", "short", "x"), (6, "u", None, "x"),
            (7, "u", "", "x"), (8, "u", "line\r\n\r\nWARC/1.1\r\n" * 9, "x"), (None, "u", long, "x"), (9, "u", "big " * 300_000, "x"), (9, "u", "big " * 300_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    back = A.read_archives(A.write_archives(pages, scratch_path(spark, "warc"))).collect()
    assert {r["kind"] for r in back} == {"record"} and len(back) == len(rows)
    got = sorted(((r["id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in back), key=str)
    want = []
    for i, _, text, _ in rows:
        raw = (text or "").encode()
        revisit = text == long and i not in (-3, None)
        want.append((i, "revisit" if revisit else "response", len(raw), hashlib.sha256(raw).hexdigest(), -3 if revisit else None))
    assert got == sorted(want, key=str)
    assert all((r["block"] == b"") if r["record_type"] == "revisit" else len(r["block"]) == r["payload_bytes"] for r in back)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, html string")
    assert A.read_archives(A.write_archives(pages, scratch_path(spark, "warc"))).count() == 0


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_members_of_several_records(step):
    records = [page(i, 40 * i) for i in range(6)]
    junk = b"junk WARC/1.1\r\n\x1f\x8b\x08"
    data = A.member(b"".join(records[:4])) + A.member(records[4] + junk + records[5] + b"tail") + A.member(b"no record") + A.member(records[0]) + records[1]
    got = list(A.salvage(io.BytesIO(data), step))
    assert [g[0] for g in got] == ["record"] * 4 + ["record", "gap", "record", "gap", "gap", "record", "record"]
    assert [int(g[3]["warc-record-id"][10:-1]) for g in got if g[0] == "record"] == [0, 1, 2, 3, 4, 5, 0, 1]
    inner = [g[5] for g in got]
    assert inner[0] == (0, len(records[0])) and inner[5] == (len(records[4]), len(records[4]) + len(junk)) and inner[8:] == [None] * 3
    ends = sorted({(g[1], g[2]) for g in got})
    assert [a for a, _ in ends[1:]] == [b for _, b in ends[:-1]] and ends[-1][1] == len(data)
    broken = bytearray(data)
    broken[len(A.member(b"".join(records[:4]))) // 2] ^= 1
    assert [int(g[3]["warc-record-id"][10:-1]) for g in A.salvage(io.BytesIO(bytes(broken)), step) if g[0] == "record"] == [4, 5, 0, 1]


def test_long_headers():
    body = b"x" * 100
    long = A.record("response", 1, "http://a/" + "y" * 3_000_000, body, hashlib.sha256(body).hexdigest(), None)
    for data in (long + page(2, 5), A.member(long) + page(2, 5)):
        assert [g[0] for g in A.salvage(io.BytesIO(data))] == ["record", "record"]


def test_damaged_archives_give_the_other_records(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " + "words " * 200) for i in range(1, 301)], "page_id long, url string, html string").repartition(3)
    manifest = A.write_archives(pages, scratch_path(spark, "warc"))
    rows = A.read_archives(manifest, with_block=False, damage_every=7).collect()
    assert {r["id"]: r["salvaged"] for r in rows} == {i: i % 7 != 0 for i in range(1, 301)}
    assert {r["salvaged"] for r in A.read_archives(manifest).collect()} == {None}
