import glob
import gzip
import hashlib
import os
import random
import zlib

import pytest

from oracle import rows
from entailis.llm import warc
from entailis.llm.queries import OP10_SQL, op10_warc
from oracle import connect, same


def test_query(spark, data):
    same(op10_warc(spark, data), connect(data), OP10_SQL)


BIG = "payload é " * 20


def pages(spark, *rows_):
    return spark.createDataFrame(list(rows_), "page_id long, url string, html string").selectExpr("page_id", "url", "html", "'x' as payload", "1 as salt")


def brute(rows_):
    out = []
    for k, _, h in rows_:
        p = (h or "").encode()
        d = hashlib.sha256(p).hexdigest()
        same_ = [i for i, _, x in rows_ if (x or "").encode() == p and i is not None]
        first = min(same_) if same_ and len(p) >= 100 else None
        revisit = first is not None and k != first
        out.append((k, len(p), d, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


ODD = [(1, "http://a", BIG), (2, None, BIG), (3, "http://a b\r\nX: y", BIG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (2, "u", BIG), (1, "http://a", BIG), (None, "u", BIG), (None, "u", "only without a key" * 9), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 12), (9, "u", "x" * 500_000), (10, "u", "x" * 500_000), (11, "u", "\x00\x85 " * 60)]


def test_round_trip(spark):
    df = pages(spark, *ODD)
    path = warc.archive_pages(df)
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert sorted(((r.record_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(ODD)
    texts = sorted((h or "").encode() for _, _, h in ODD)
    held = {r.payload_digest: r.payload for r in got if r.record_type == "response"}
    assert sorted(bytes(held[r.payload_digest]) for r in got) == texts
    assert {r.url for r in got if r.record_key == 3} == {"http://a%20b%20%20X:%20y"}


def standard(path):
    """Records by id, read with nothing but the WARC and gzip formats: one member a record."""
    out = {}
    for f in sorted(glob.glob(path.removeprefix("file:") + "/part-*")):
        rest = open(f, "rb").read()
        while rest:
            z = zlib.decompressobj(31)
            record = z.decompress(rest)
            assert z.eof
            rest = z.unused_data
            if record:
                head, _, block = record.partition(b"\r\n\r\n")
                version, *lines = head.decode().split("\r\n")
                fields = dict(x.split(": ", 1) for x in lines)
                assert version == "WARC/1.1" and len(block) == int(fields["Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")
                assert fields["WARC-Record-ID"] not in out
                out[fields["WARC-Record-ID"]] = fields, block[:-4]
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_files_are_standard(spark, monkeypatch, tmp_path, shuffled):
    if shuffled:
        monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    pages(spark, *ODD).repartition(3).write.parquet(str(tmp_path / "pages"))
    records = standard(warc.archive_pages(spark.read.parquet(str(tmp_path / "pages"))))
    assert len(records) == len(ODD)
    dates = {f["WARC-Date"] for f, _ in records.values()}
    assert len(dates) == 1 and dates.pop() > "2024-01-01T00:00:00Z"
    revisits = 0
    for f, block in records.values():
        if f["WARC-Type"] == "revisit":
            of, response = records[f["WARC-Refers-To"]]
            assert of["WARC-Type"] == "response" and of["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
            assert of.get("WARC-Target-URI") == f.get("WARC-Refers-To-Target-URI") and of["WARC-Date"] == f["WARC-Refers-To-Date"]
            assert hashlib.sha256(response.partition(b"\r\n\r\n")[2]).hexdigest() == f["WARC-Payload-Digest"].removeprefix("sha256:")
            revisits += 1
    assert revisits == sum(r[3] == "revisit" for r in brute(ODD)) > 3


def test_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "PIECE_BYTES", 2_000)
    monkeypatch.setattr(warc, "FILE_PIECES", 2)
    rng = random.Random(1)
    path = warc.archive_pages(pages(spark, *((i, "u", "%0200x" % rng.getrandbits(2400)) for i in range(200))).coalesce(1))
    sizes = [os.path.getsize(f) for f in glob.glob(path.removeprefix("file:") + "/part-*")]
    assert len(sizes) > 10 and max(sizes) < 2 * (2_000 + 1_000) + 100 and len(standard(path)) == 200


def test_many_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_PIECES", 1)
    monkeypatch.setattr(warc, "PIECE_BYTES", 300)
    rows_ = [(i, "u", f"{BIG}{i % 9}") for i in range(60)]
    read = warc.read_archives(spark, warc.archive_pages(pages(spark, *rows_)))
    assert rows(read.select("record_key", "payload_bytes", "payload_digest", "record_type", "refers_to")) == brute(rows_)


def test_empty(spark):
    assert warc.read_archives(spark, warc.archive_pages(pages(spark).limit(0))).count() == 0


def test_broken_archives_are_errors():
    record = b"WARC/1.1\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc._parse(record * 2)] == [b"abc", b"abc"]
    assert [b for _, b in warc._parse(gzip.compress(record) + gzip.compress(record))] == [b"abc", b"abc"]
    for bad in (record[:-2], b"junk" + record, record.replace(b": 3", b": 2")):
        with pytest.raises(ValueError):
            list(warc._parse(bad))
