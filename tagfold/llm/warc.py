"""WARC archives of captures, and transactions assembled from them.

write() gives each page a request, a response (or revisit) and a metadata record; request and metadata name the response
in WARC-Concurrent-To, a revisit names the record of its response in WARC-Refers-To. Which page is a revisit is decided on
page_ids and digests alone; pages then find their verdict, and a generator makes their records one at a time. Each record
is a gzip member of its own, so it can be read alone. The archive is written by Spark's text sink: a row is a record's
member and the line separator an empty member, so files are committed as usual and a lost executor costs a retried task.
read() frames the records of files by Content-Length, transactions() joins the records of a capture through the
concurrent-to identifiers into one nested row, and captures() resolves what revisits refer to by a join of record ids.

Record ids are made of page_id, payload digest and a count of rows that share both, so reruns write the same ids.

Defined cases: a null html is an empty payload, and so is an empty one; a null url becomes an empty target URI; of records
with equal payloads the one with the smallest page_id is the response (null page_ids come last), and rows that repeat this
page_id with the same payload are responses too; payloads of any length are written whole; an empty table gives no rows;
other columns play no part; records that are cut short or whose digest is wrong raise an error, as an archive must be read
back whole.
"""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagfold.llm.common import joined_to_groups, saved, scratch
from tagfold.ship import ship

CRLF = "\r\n"
#: Most records in a file, three for each page: a file's compressed bytes are read as one value.
RECORDS_PER_FILE = 1_500
#: Payloads of at least so many bytes may be revisited.
LEAST_REVISIT_BYTES = 0
#: Level of gzip, and rows of pages that leave a task together.
LEVEL, ROWS = 5, 64
#: Bytes that are decompressed at a time.
PIECE = 1 << 18
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = T.StructType([
    T.StructField("warc_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("concurrent_to", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("block", T.BinaryType()),
])


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column."""
    digest = F.sha1(payload)
    # 20 bits at a time: five hex digits are four base32 digits, which conv() writes as 0-9A-V
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(kind: str, record_id: str, block: list[bytes], *headers: tuple[str, str | None]) -> bytes:
    """A whole record as a gzip member; headers without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Record-ID: {record_id}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {sum(map(len, block))}", CRLF]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    parts = [pack.compress(CRLF.join(lines).encode("utf-8", "surrogatepass")), *map(pack.compress, block), pack.compress(b"\r\n\r\n"), pack.flush()]
    return b"".join(parts)


def urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode()).digest())}>"


def members(page: int | None, url: str, html: bytes, digest: str, first: int | None, again: bool, k: int) -> Iterator[bytes]:
    """The records of a page; k tells rows that repeat page and digest apart."""
    of, about = urn("response", page, digest, k), ("WARC-Target-URI", url)
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(html)}{CRLF}{CRLF}".encode()
    answer = (("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"))
    yield record("request", urn("request", of), [f"GET {url} HTTP/1.1{CRLF}User-Agent: tagfold{CRLF}{CRLF}".encode("utf-8", "surrogatepass")], about, ("WARC-Concurrent-To", of), ("Content-Type", "application/http;msgtype=request"))
    if again:
        yield record("revisit", of, [http], about, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", urn("response", first, digest, 0)), *answer)
    else:
        yield record("response", of, [http, html], about, *answer)
    yield record("metadata", urn("metadata", of), [f"page-id: {'' if page is None else page}{CRLF}".encode()], about, ("WARC-Concurrent-To", of), ("Content-Type", "application/warc-fields"))


def records(pages: DataFrame) -> DataFrame:
    """One binary row (a gzip member) for each record of pages (page_id, url, html); a page's records stand together."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"), html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    light = saved(rows.groupBy("page_id", "digest", "n").agg(F.count("*").alias("_rows")), "warc-digests")
    first = light.groupBy("digest", "n").agg(F.min("page_id").alias("_first"), F.count("*").alias("_size"))
    again = (F.col("page_id") > F.col("_first")) & (F.col("n") >= LEAST_REVISIT_BYTES) | F.col("page_id").isNull() & F.col("_first").isNotNull()
    verdict = joined_to_groups(light, first, ["digest", "n"], "_size", F.col("page_id"))
    verdict = verdict.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "_first", F.coalesce(again, F.lit(False)).alias("_again"), "_rows")
    # pages meet their own verdict only, so copies of a payload spread; the light side is the one that is hashed
    both = rows.join(verdict.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: collections.Counter = collections.Counter()  # of rows that repeat page and digest only
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                out = []
                for r in zip(*(c.to_pylist() for c in b.slice(at, ROWS).columns)):
                    page, digest, many = r[0], r[3], r[6] > 1
                    out += members(*r[:6], seen[page, digest] if many else 0)
                    if many:
                        seen[page, digest] += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return both.select("page_id", "url", F.col("html").cast("binary"), "digest", "_first", "_again", "_rows").mapInArrow(run, "value binary")


def write(pages: DataFrame, path: str | None = None) -> str:
    """Writes the archive of pages and returns its path (default: a new one in the shared folder)."""
    path = path or scratch(pages.sparkSession, "warc")
    # text is bytes to the sink; in Latin-1 the separator is these bytes
    rows = records(pages).select(F.col("value").cast("string"))
    rows.write.option("lineSep", gzip.compress(b"", mtime=0).decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def plain(data: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold, piece by piece."""
    pack, left = zlib.decompressobj(31), data
    while left:
        if piece := pack.decompress(left, PIECE):
            yield piece
        left = pack.unconsumed_tail
        if pack.eof:
            left = pack.unused_data
            pack = zlib.decompressobj(31)
        elif not left:
            raise ValueError("the file is cut short")


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record of an archive file; no more than a record and a piece is held."""
    held, ended = bytearray(), False

    def upto(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            piece = next(pieces, None)
            ended = piece is None
            held.extend(piece or b"")
        return len(held) >= n

    while upto(1):
        n = 1 << 10
        while (head := held.find(b"\r\n\r\n")) < 0 and upto(n):
            n *= 2
        lines = held[: max(head, 0)].decode("utf-8", "surrogatepass").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record starts where one should")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = head + 4
        end = start + int(headers["content-length"])
        if not upto(end + 4) or held[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, bytes(held[start:end])
        del held[: end + 4]


def _row(headers: dict[str, str], block: bytes, with_block: bool) -> tuple:
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = page = None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{headers['warc-record-id']}: the payload isn't the one that its digest names")
    elif kind == "metadata":
        value = next((x.partition(b":")[2].strip() for x in block.split(b"\r\n") if x.startswith(b"page-id:")), b"")
        page = int(value) if value else None
    return kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), digest, size, page, block if with_block else None


def read(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """All records of an archive as RECORD rows; with_block=False leaves the blocks out."""
    ship(spark)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for headers, block in parse(plain(content.as_py())):
                    rows.append(_row(headers, block, with_block))
                    size += len(block) if with_block else 0
                    if len(rows) >= RECORDS_PER_FILE or size >= 1 << 24:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(run, RECORD)


ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in RECORD])


def transactions(found: DataFrame) -> DataFrame:
    """One row per capture: capture_id, request, response and metadata, each a struct of RECORD (null if missing).

    Records join the response or revisit that their concurrent-to identifier names; the group of an identifier is the few
    records of one capture.
    """
    capture = F.coalesce("concurrent_to", "record_id")
    one = lambda *kinds: F.max(F.when(F.col("warc_type").isin(*kinds), F.struct(*RECORD.names)))
    return found.groupBy(capture.alias("capture_id")).agg(one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (the page of the record that a revisit names) of each capture."""
    t = transactions(read(spark, path, with_block=False)).where("response is not null")
    light = t.select("metadata.page_id", "response.payload_bytes", "response.payload_digest", F.col("response.warc_type").alias("record_type"), F.col("response.record_id").alias("_id"), F.col("response.refers_to").alias("_of"))
    light = saved(light, "warc-captures")
    named = light.where("_of is not null").groupBy("_of").agg(F.count("*").alias("_size"))
    target = named.join(light.where("_of is null").select(F.col("_id").alias("_of"), F.col("page_id").alias("refers_to"), F.lit(True).alias("_there")), "_of", "left")
    again = joined_to_groups(light.where("_of is not null"), target, ["_of"], "_size", F.col("_id"))
    again = again.withColumn("refers_to", F.when(F.col("_there"), F.col("refers_to")).otherwise(F.raise_error(F.concat(F.lit("a revisit refers to a record that isn't there: "), "_of")).cast("long")))
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return light.where("_of is null").select(*shown, F.lit(None).cast("long").alias("refers_to")).unionByName(again.select(*shown, "refers_to"))


#: The result of captures(write(pages)) in DuckDB's SQL.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
         list_reduce(list_transform(range(0, 8), lambda i: list_reduce(list_transform([15, 10, 5, 0], lambda b:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT >> b) & 31)::INT + 1, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""
