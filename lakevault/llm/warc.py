"""WARC archives with revisit records for payloads seen before.

Headers (page_id, payload digest, length) alone are dealt out by digest; of records with equal payloads the one with the
smallest page_id stays a response, the others become revisits of it. That verdict is joined back to the pages by page_id
and digest, so that a payload which a third of all pages share lands nowhere as a group: its header rows are summed up
before they are dealt out. The archives are written anew with fresh headers through Spark's text writer, a record a row,
gzip-compressed, to any store that Spark writes to. Readers take each archive as a stream, record by record, by
Content-Length, and check each response's payload against its digest.

Defined results: null html is an empty payload; a null url is written without WARC-Target-URI; control characters and
blanks in a url are percent-encoded; payloads shorter than LEAST bytes are always responses; rows that repeat the smallest
page_id with the same payload are all responses; a null page_id never becomes the original unless all are null; no pages
give no archive records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.llm.common import new_path, table

#: Payloads of fewer bytes are not worth a revisit record.
LEAST = 100
#: Records in an archive file at most.
FILE_RECORDS = 20_000
END = "\r\n"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def resolved(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest, original: for each record that revisits another one."""
    heads = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= least)
    heads = heads.select("page_id", "digest")
    originals = heads.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original")
    return heads.join(originals, "digest").where(~F.col("page_id").eqNullSafe(F.col("original"))).select("page_id", "digest", "original").distinct()


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One row a page: value, the record's text without its closing blank lines."""
    again = resolved(pages, least).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "original")
    html = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    joined = pages.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    revisit = F.col("original").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), r"[\r\n]", "")
    uri = F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit(f"WARC-Target-URI: "), url, F.lit(END)))
    full = F.octet_length("html").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), full, F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    value = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(f">{END}WARC-Date: 2024-01-01T00:00:00Z{END}"), uri,
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{END}WARC-Refers-To: <urn:page:"), F.col("original").cast("string"), F.lit(f">{END}"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block,
    )
    return joined.select(value.alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST) -> None:
    records(pages, least).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class Bytes:
    """Reads a gzip file's content piece by piece."""

    def __init__(self, content: bytes):
        self.rest, self.unzip, self.have = memoryview(content), zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        while len(self.rest) or self.unzip.unconsumed_tail:
            if self.unzip.eof:
                self.unzip, self.rest = zlib.decompressobj(31), memoryview(self.unzip.unused_data)
                continue
            take, self.rest = self.rest[: 1 << 18], self.rest[1 << 18 :]
            got = self.unzip.decompress(take)
            if self.unzip.eof and self.unzip.unused_data:
                self.rest = memoryview(bytes(self.unzip.unused_data) + bytes(self.rest))
                self.unzip = zlib.decompressobj(31)
            if got:
                self.have += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (at := self.have.find(mark, start)) < 0:
            start = max(0, len(self.have) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.have[:at])
        del self.have[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.more():
                raise ValueError("a WARC record ends too soon")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of a gzip-compressed archive."""
    data = Bytes(content)
    number = lambda x: None if x in (None, "<urn:page:null>") else int(x[len("<urn:page:") : -1])
    while (head := data.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode("utf-8").split(END)
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        h = dict(x.split(": ", 1) for x in lines)
        block = data.exactly(int(h["Content-Length"]))
        if data.exactly(4) != b"\r\n\r\n":
            raise ValueError("a WARC record lacks its closing blank lines")
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(dict(x.split(": ", 1) for x in http.decode().split(END)[1:])["Content-Length"])
        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
        if h["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
        yield {
            "page_id": number(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": digest, "record_type": h["WARC-Type"],
            "refers_to": number(h.get("WARC-Refers-To")), "html": payload.decode("utf-8") if h["WARC-Type"] == "response" else None,
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives under path; html is null for revisits, or without payloads."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["html"] * payloads
    schema = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_archive(content.as_buffer().to_pybytes()):
                    rows.append({n: r[n] for n in names})
                    size += len(r["html"] or "") if payloads else 0
                    if len(rows) >= 4096 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = ", ".join(x for x in RECORDS.split(", ") if x.split()[0] in names)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, ddl)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).drop("url")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, min(page_id) AS original FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> original THEN original END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d AND p.n >= 100
"""
