"""WARC archives with revisit resolution.

Headers (payload digest, length, record key, row) are shuffled by payload
digest; of equal payloads the smallest key stays a response, the others become
revisit records that refer to it.  Payloads are not shuffled while what is known
of repeated ones is small enough to go to every executor.  Records are laid out
by built-in string functions, compressed one gzip member each, gathered into
pieces of bounded size and written by Spark's own writer, whose commit protocol
survives lost tasks.  Archives are read back from their bytes alone, record by
record: lengths come from headers, digests are recomputed.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entailis.llm.common import checkpoint, prepare, shared_dir

CRLF = "\r\n"
#: Payloads of fewer bytes are always stored: a revisit record would save nothing.
LEAST_PAYLOAD = 100
#: Compressed bytes of a piece, and pieces of a file: a file is as large as both together, and a record more for each piece.
PIECE_BYTES, FILE_PIECES = 4 << 20, 16
#: Bytes of what is known of repeated payloads up to which every executor gets it; beyond, payloads are shuffled by digest.
BROADCAST_BYTES = 64 << 20
#: Parts into which the rows of one digest are dealt in that shuffle.
SALTS = 16
#: A gzip member without content, which the writer puts between pieces.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def resolve_revisits(headers: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(payload_digest, refers_to, refers_url, refers_row) of every payload that occurs more than once.

    headers: (record_key, url, row, payload_digest, payload_bytes).  Counts and
    minima combine before the shuffle, so a hot digest is one row a task.  Null
    keys never serve as a response while another key exists.
    """
    first = F.min(F.when(F.col("record_key").isNotNull(), F.struct("record_key", "row", "url")))
    one = headers.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(first.alias("x"), F.count(F.lit(1)).alias("n"))
    return one.where("n > 1 and x is not null").select("payload_digest", F.col("x.record_key").alias("refers_to"), F.col("x.url").alias("refers_url"), F.col("x.row").alias("refers_row"))


def _record_id(archive: str, row: Column) -> Column:
    """An id of its own for each row of an archive."""
    hexed = F.md5(F.concat_ws("/", F.lit(archive), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ((F.lit("-"),) if i else ()) + (F.substring(hexed, a, n),)), F.lit(">"))


def plan_records(pages: DataFrame, key: str, url: str, html: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(record_key, url, row, payload, payload_digest, payload_bytes, record_type, refers_to, refers_url, refers_row), one row for each input row."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    base = pages.select(F.col(key).alias("record_key"), F.col(url).cast("string").alias("url"), F.monotonically_increasing_id().alias("row"), body.alias("payload"))
    base = base.withColumns({"payload_digest": F.sha2(F.col("payload").cast("binary"), 256), "payload_bytes": F.octet_length("payload").cast("long")})
    found = checkpoint(resolve_revisits(base.drop("payload"), least))
    size = found.agg(F.sum(F.octet_length(F.coalesce("refers_url", F.lit(""))).cast("long") + 150)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = base.join(F.broadcast(found), "payload_digest", "left")
    else:
        found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(found, ["payload_digest", "salt"], "left")
    again = F.col("refers_to").isNotNull() & ~F.col("record_key").eqNullSafe(F.col("refers_to"))
    refers = [F.when(again, F.col(c)).alias(c) for c in ("refers_to", "refers_url", "refers_row")]
    return joined.select("record_key", "url", "row", "payload", "payload_digest", "payload_bytes", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), *refers)


def _packer(most: int):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Records, each compressed as a member of its own, joined to pieces of ``most`` bytes or one record more."""
        held, size = [], 0
        for batch in batches:
            for record in batch["record"]:
                held.append(gzip.compress(record + b"\r\n\r\n", 6, mtime=0))
                size += len(held[-1])
                if size >= most:
                    yield pd.DataFrame({"piece": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"piece": [b"".join(held)]})

    return pieces


def write_archives(records: DataFrame, path: str, date: str | None = None) -> None:
    """Write planned records as compressed WARC/1.1 files under path; date: that of the records, now by default."""
    c = F.col
    archive, date = uuid.uuid4().hex, date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    keyed = lambda name, value: F.when(value.isNotNull(), line(name, value.cast("string"))).otherwise(F.lit(""))
    target = lambda u: F.regexp_replace(u, r"[\x00-\x20\x7f]", "%20")
    length = c("payload_bytes").cast("string")
    revisit = c("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, c("payload")))
    refers = F.concat(
        F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
        line("WARC-Refers-To", _record_id(archive, c("refers_row"))),
        keyed("WARC-Refers-To-Target-URI", target(c("refers_url"))),
        line("WARC-Refers-To-Date", F.lit(date)),
        line("X-Refers-To-Key", c("refers_to").cast("string")),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", c("record_type")),
        line("WARC-Record-ID", _record_id(archive, c("row"))),
        line("WARC-Date", F.lit(date)),
        keyed("WARC-Target-URI", target(c("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), c("payload_digest"))),
        keyed("X-Record-Key", c("record_key")),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF),
    )
    prepare(records.sparkSession)
    members = records.withColumn("block", block).select(F.concat(head, c("block")).cast("binary").alias("record")).mapInPandas(_packer(PIECE_BYTES), "piece binary")
    # The writer puts out the bytes of a string as they are, and between two the separator.
    out = members.select(c("piece").cast("string").alias("value")).write
    out.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", FILE_PIECES).text(path)


def _parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, compressed or not; raises ValueError where the bytes are no WARC records."""
    raw = io.BytesIO(content)
    with io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw as file:
        while line := file.readline():
            if not line.startswith(b"WARC/1."):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            head = {}
            while (line := file.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip(CRLF).partition(": ")
                head[name] = value
            block = file.read(int(head["Content-Length"]))
            if file.read(4) != b"\r\n\r\n":
                raise ValueError(f"{head['WARC-Record-ID']} does not end where its length says")
            yield head, block


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(record_key long, url, record_type, refers_to long, payload_digest, payload_bytes[, payload]) of every record.

    Digest and length of a response are computed from its payload and checked
    against its headers; those of a revisit are its headers', and its payload is
    null: the response that it refers to holds it.
    """
    schema = "record_key long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * payloads

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            for k in ("record_key", "refers_to", "payload_bytes"):
                out[k] = out[k].astype("Int64")
            return out

        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for head, block in _parse(content):
                    held += len(block) if payloads else 500
                    if held > PIECE_BYTES and rows:
                        yield frame(rows)
                        rows, held = [], 0
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if head["WARC-Type"] == "response":
                        if len(body) != size or hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"payload and headers of {head['WARC-Record-ID']} differ")
                    key, of = head.get("X-Record-Key"), head.get("X-Refers-To-Key")
                    rows.append((None if key is None else int(key), head.get("WARC-Target-URI"), head["WARC-Type"], None if of is None else int(of), digest, size) + ((body if head["WARC-Type"] == "response" else None,) if payloads else ()))
                yield frame(rows)

    prepare(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def archive_pages(pages: DataFrame, path: str | None = None, *, key: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> str:
    """Write a deduplicated archive of pages and return its folder.

    A row becomes a response record, or a revisit record if an equal payload of
    at least LEAST_PAYLOAD bytes has a smaller key.  Null html is an empty
    payload; a null url has no target header; a null key is written without one
    and revisits an equal payload that has a key.  Rows with equal keys and
    payloads are all responses.  Other columns are not read; an empty table
    gives an archive without records.  Keys are integers.  pages is read twice
    and must give its rows in the same order again, as a table does: record ids
    are made from their places.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(plan_records(pages, key, url, html), path, date)
    return path
