import base64
import gzip
import hashlib

import pytest

from calathea.llm import warc
from calathea.llm.shared import shared_dir

BIG = "<p>" + "é" * 700 + "</p>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "u", "small"), (4, "u", "small"), (5, None, None), (6, "a\r\nb", ""), (7, "u", BIG + "x" * 100_000), (9, "u", BIG), (None, "u", "null id")]


def test_round_trip(spark):
    rows = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, first int")
    archives = warc.write(rows, shared_dir(spark, "t"))
    found = {r.page_id: r for r in warc.read(archives).collect()}
    assert len(found) == len(PAGES)
    for i, _, html in PAGES:
        raw = (html or "").encode()
        kind = "revisit" if i in (1, 2) else "response"
        assert (found[i].kind, found[i].payload_bytes, found[i].payload_digest, found[i].refers_to) == (kind, len(raw), hashlib.sha1(raw).hexdigest(), 9 if kind == "revisit" else None)
        assert bytes(found[i].payload) == (raw if kind == "response" else b"")


def test_nothing(spark):
    rows = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(rows, shared_dir(spark, "t"))).count() == 0


RECORDS = [warc.record(i, f"http://x/{i}", (f"<p>{i}</p>" * (50 * i + 1)).encode()) for i in range(8)]


def kinds(raw):
    return [(r[3] if r[2] != "gap" else "gap") for r in warc.read_bytes(raw)]


@pytest.mark.parametrize("bad", range(8))
@pytest.mark.parametrize("how", ["flip", "cut", "zero", "head"])
def test_damaged_member_is_skipped(bad, how):
    part = bytearray(RECORDS[bad])
    middle = len(part) // 2
    if how == "flip":
        part[middle] ^= 0xFF
    elif how == "cut":
        part = part[:middle]
    elif how == "zero":
        part[middle : middle + 20] = bytes(20)
    else:
        part[0] = 0
    raw = b"".join(bytes(part) if k == bad else r for k, r in enumerate(RECORDS))
    rows = warc.read_bytes(raw)
    assert [r[3] for r in rows if r[2] != "gap"] == [k for k in range(8) if k != bad]
    gaps = [r for r in rows if r[2] == "gap"]
    start = sum(map(len, RECORDS[:bad]))
    assert len(gaps) == 1 and gaps[0][1] == start and gaps[0][9] == len(part) and gaps[0][10]


def test_plain_records_and_garbage():
    plain = [gzip.decompress(r) for r in RECORDS[:4]]
    assert kinds(b"".join(plain)) == [0, 1, 2, 3]
    assert kinds(plain[0] + b"garbage WARC/1. more" + plain[2] + RECORDS[3] + b"tail") == [0, "gap", 2, 3, "gap"]
    assert kinds(b"") == [] and kinds(b"no archive at all") == ["gap"]
    assert kinds(b"x" * (3 << 20) + RECORDS[1]) == ["gap", 1]


def test_wrong_digest_is_a_gap():
    raw = gzip.decompress(RECORDS[1]).replace(b"<p>1</p>", b"<p>7</p>", 1)
    rows = warc.read_bytes(gzip.compress(raw) + RECORDS[2])
    assert [r[2] for r in rows] == ["gap", "response"] and "digest" in rows[0][10]
    assert base64.b32encode(hashlib.sha1(b"").digest())


@pytest.mark.parametrize("pack", [bytes, gzip.decompress])
def test_long_heads(pack):
    url = "data:text/html;base64," + "A" * 300_000
    raw = pack(RECORDS[0]) + pack(warc.record(9, url, b"<p>")) + pack(RECORDS[1])
    rows = warc.read_bytes(raw)
    assert [(r[2], r[3]) for r in rows] == [("response", 0), ("response", 9), ("response", 1)] and rows[1][8] == url
    assert kinds(b"WARC/1.1\r\nno head" + b"x" * 300_000 + RECORDS[1]) == ["gap", 1]


@pytest.mark.parametrize("wrong", [-100, 100, 5_000_000, 10**9, 10**17])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_wrong_lengths_hold_no_more_than_their_record(wrong, pack):
    """A record whose length is too short, too long or absurd, before many good ones."""
    import io

    block = b"<p>" * 400
    bad = pack(warc.VERSION + b"\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % (len(block) + wrong) + block + b"\r\n\r\n")
    big = gzip.decompress(warc.record(1, "u", b"x" * 3_000_000))
    raw = bad + b"".join(RECORDS) + big + b"".join(RECORDS) * 200
    held = []
    source = warc._Source

    class Watched(source):
        def __init__(self, stream):
            super().__init__(stream)
            held.append(self)

    warc._Source = Watched
    try:
        found = list(warc.salvage(io.BytesIO(raw)))
    finally:
        warc._Source = source
    assert [(k, at, end) for k, at, end, *_ in found if k == "gap"] == [("gap", 0, len(bad))]
    assert len(found) == 2 + len(RECORDS) * 201
    assert held[0].most <= len(big) + (1 << 20)
    small = list(warc.salvage(io.BytesIO(bad + b"".join(RECORDS) * 500)))
    assert len(small) == 1 + len(RECORDS) * 500


def test_a_bomb_is_not_unpacked():
    bomb = gzip.compress(gzip.decompress(RECORDS[1]) + bytes(200_000_000), 9)
    import io

    source = warc._Source(io.BytesIO(bomb + RECORDS[2]))
    with pytest.raises(ValueError, match="bytes after"):
        warc._at(source, 0)
    assert source.most < 2 << 20
    assert kinds(bomb + RECORDS[2]) == ["gap", 2]
