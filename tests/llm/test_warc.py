"""WARC archives: round trip, byte ranges, chance magics, foreign and broken members."""

import base64
import gzip
import hashlib
import os
import random

import pytest

from corpusgauge.llm import warc as W
from corpusgauge.llm.common import fresh_path


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least=0):
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        top = last.get(html or "") if len(data) >= least else None
        revisit = top is not None and (i is None or i < top)
        out.append((i, url or "", len(data), digest(data), "revisit" if revisit else "response", top if revisit else None, None if revisit else data))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in df.collect()), key=repr)


def pages():
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 7}.org/{i}", "".join(rng.choices("<p>aé日 \r\n", k=rng.randrange(300)))) for i in range(150)]
    rows += [(200 + i, f"http://copy/{i}", "the same") for i in range(60)]
    rows += [(300, None, None), (301, "", ""), (302, "http://x/\r\nWARC-Type: bad", "a\r\n\r\nWARC/1.1\r\n"), (303, " =?x?= ", None), (304, "=?UTF-8?B?eA==?=", "tab\tbell\a")]
    rows += [(None, "http://none", "the same"), (None, "http://none", "alone"), (310, "http://twice", "twice"), (310, "http://twice", "twice"), (320, "http://long", "x" * 400_000)]
    return rows


@pytest.fixture
def ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def use(size):
        for key in keys:
            spark.conf.set(key, str(size))

    yield use
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("size", [97, 1_000, 10**8])
def test_round_trip(spark, ranges, size):
    rows, path = pages(), fresh_path(spark, "warc")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    W.write_pages(df.withColumn("payload", df["url"]).withColumn("salt", df["url"]), path)
    ranges(size)
    assert got(W.read_pages(spark, path)) == expected(rows)


def test_small_payloads_are_responses(spark):
    rows, path = pages(), fresh_path(spark, "warc")
    W.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), path, least=9)
    assert got(W.read_pages(spark, path)) == expected(rows, 9)


def test_empty_table(spark):
    path = fresh_path(spark, "warc")
    W.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.read_pages(spark, path).count() == 0


def test_archives_are_plain_gzip_members(spark):
    path = fresh_path(spark, "warc")
    W.write_pages(spark.createDataFrame([(1, "http://a", "one"), (2, "http://b", "two")], "page_id long, url string, html string").coalesce(1), path)
    folder = path.removeprefix("file:")
    data = b"".join(gzip.open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    assert data.count(b"WARC/1.1\r\n") >= 3 and b"\r\n\r\ntwo\r\n\r\n" in data


def test_member_whose_last_byte_is_not_zero():
    packed = b"\x1f\x8b\x08 not zero \x01"
    assert W.line(packed) + b"\0" == packed + W.EMPTY_MEMBER
    assert gzip.decompress(W.line(gzip.compress(b"a") + W.EMPTY_MEMBER) + b"\0") == b"a"


def foreign(rng, n):
    """Records whose compressed bytes hold the magic by design: stored blocks of bytes with many magics."""
    out = []
    for i in range(n):
        payload = b"".join(rng.choice([W.MAGIC, W.MAGIC + b"\0\0\0\0\0\0\3junk", rng.randbytes(9)]) for _ in range(rng.randrange(1, 60)))
        http = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n" + payload
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI:\r\n http://f/{i}\r\nContent-Length: {len(http)}\r\n\r\n".encode()
        out.append((i, payload, gzip.compress(head + http + b"\r\n\r\n", rng.choice([0, 9]))))
    return out


@pytest.mark.parametrize("size", [61, 200, 5_000, 10**8])
def test_chance_magics_across_ranges(spark, ranges, tmp_path, size):
    made = foreign(random.Random(8), 40)
    for k in range(2):
        (tmp_path / f"{k}.warc").write_bytes(b"".join(m for _, _, m in made[k::2]))
    ranges(size)
    rows = W.read_records(spark, f"file:{tmp_path}").collect()
    assert sorted((r.record_id, r.target_uri, bytes(r.payload)) for r in rows) == sorted((f"urn:page:{i}", f"http://f/{i}", p) for i, p, _ in made)


def test_broken_members_are_left_out(spark, ranges, tmp_path):
    made = foreign(random.Random(3), 12)
    parts = [m for _, _, m in made]
    parts[4] = parts[4][: len(parts[4]) // 2]
    parts[7] = bytes(b ^ 255 for b in parts[7])
    (tmp_path / "a.warc").write_bytes(b"before" + b"".join(parts) + b"\x1f\x8b\x08tail")
    (tmp_path / "b.warc").write_bytes(b"")
    (tmp_path / "c.warc").write_bytes(b"no archive " * 50)
    ranges(300)
    found = {r.record_id for r in W.read_records(spark, f"file:{tmp_path}").collect()}
    assert found == {f"urn:page:{i}" for i in range(12)} - {"urn:page:4", "urn:page:7"}


def test_altered_payload_is_marked():
    packed = W.page_member(5, "http://a", b"body", None)
    record = W.parse_record(gzip.decompress(packed))
    assert record["intact"] and record["payload"] == b"body"
    assert not W.parse_record(gzip.decompress(packed).replace(b"body", b"bode"))["intact"]
