"""WARC archives: round trips with records inside payloads, over small splits, against a sequential reader."""

import glob
import hashlib
import random
from collections import Counter

import pytest

from pagewright.llm import warc

PAGES = "page_id long, url string, html string"


def head(kind, body, **fields):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def sequential(data):
    """(type, block) of the records of one archive, from its start on, one after the other."""
    at, out = 0, []
    while data[at : at + 7] == b"WARC/1.":
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:] if x)
        n = int(fields["Content-Length"])
        if end + n > len(data):
            break
        out.append((fields["WARC-Type"], data[end : end + n]))
        at = end + n + 4
    return out


def plain(rows, least=1000):
    newest = {}
    for p, _, html in rows:
        if len((html or "").encode()) >= least and p is not None:
            newest[html] = max(p, newest.get(html, p))
    out = Counter()
    for p, _, html in rows:
        data = (html or "").encode()
        to = newest.get(html, p) if len(data) >= least else p
        revisit = to != p
        out[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None] += 1
    return out


@pytest.fixture(scope="module")
def page_rows(words):
    rng = random.Random(41)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    inner = head("response", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello", WARC_Record_ID="<urn:page:3>").decode()
    same, long = text(400), text(6000)
    rows = [(k, f"http://a.example/{k}", text(rng.randint(0, 500))) for k in range(40)]
    rows += [(100 + k, "http://b.example/", same) for k in range(25)]
    rows += [(200, "u", "\r\n" + inner), (201, "u", text(30) + "\r\n" + inner + text(20) + "\r\nWARC/1.0\r\n" + inner), (202, "u", inner * 40 + long), (203, "u", "\r\nWARC/1." * 300)]
    rows += [(204, "u", "\r\n" + inner * 3), (205, "u", "\r\n" + inner * 3), (206, None, None), (207, "x\r\nWARC/1.1\r\n y\x00", ""), (208, "é", "é日🎉\r\n\r\n"), (209, "u", "\r\n\r\n"), (210, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")]
    rows += [(None, "u", same), (None, None, None), (None, "u", text(300)), (0, "u", same), (124, "again", same), (-5, "u", long + long)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("split", [None, 300, 5000])
def test_round_trip(spark, page_rows, tmp_path, split):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(page_rows, PAGES).withColumns({c: F.lit("clash") for c in ("digest", "n", "h", "file", "off", "at", "payload")}).repartition(3)
    warc.write_warc(pages, str(tmp_path / "w"), per_file=20)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        records = warc.read_warc(spark, str(tmp_path / "w"))
        got = Counter(tuple(r) for r in warc.restored(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
        assert got == plain(page_rows)
        files = [open(f, "rb").read() for f in glob.glob(str(tmp_path / "w" / "*.txt"))]
        want = [x for data in files for x in sequential(data)]
        assert len(want) == len(page_rows) and sum(b"WARC/1." in x[1] for x in want) >= 7
        payloads = Counter((r["type"], bytes(r["payload"])) for r in records.collect())
        assert payloads == Counter((k, b.partition(b"\r\n\r\n")[2]) for k, b in want)
        assert {r["uri"] for r in records.where("record_id = '<urn:page:207>'").collect()} == {"x%0D%0AWARC/1.1%0D%0A%20y"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_archives(spark, tmp_path):
    rec = lambda k, body: head("resource", body, WARC_Record_ID=f"<urn:x:{k}>", Content_Type="text/plain")
    fake = rec(9, b"never")
    files = {
        "a": rec(1, b"one") + rec(2, b"\x00\xff\xfe" + b"\r\n" + fake) + rec(3, b""),
        "b": rec(4, b"cut short")[:-10],
        "c": rec(5, b"five") + b"junk\r\n" + rec(6, b"beyond the gap"),
        "d": b"junk\r\n" + rec(7, b"no start"),
        "e": b"",
        "f": rec(8, b"x")[:-4],
        "g": rec(10, b"y") + b"WARC/1.1\r\nWARC-Type: resource\r\n\r\nno length",
    }
    for name, data in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (before, 100):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = {(r["record_id"][7:-1], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path)).collect()}
        assert got == {("1", b"one"), ("2", b"\x00\xff\xfe\r\n" + fake), ("3", b""), ("5", b"five"), ("8", b"x"), ("10", b"y")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_table(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.restored(warc.read_warc(spark, str(tmp_path / "w"))).count() == 0
