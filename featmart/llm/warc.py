"""Web archives: records written and read by Spark, and their index merged into histories.

Archives are WARC files, compressed, that the text writer puts down record by record: a
record is its headers and block, and the writer's line separator is the two line breaks
that end it. Each archive's index is a sorted run; runs meet in ranges of (URL key, time)
and are merged there by a tree of losers.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featmart.session import cut_lineage, scratch_path

#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 100
#: Bytes of records in an archive, by expectation.
ARCHIVE_BYTES = 16 << 20
#: Captures that one merging task gets, by expectation.
MERGE_ROWS = 100_000
EOL = "\r\n"

CAPTURE_DDL = (
    "archive string, offset bigint, length bigint, url string, url_key string, captured string, page_id bigint, "
    "record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
)
ORDER = ("url_key", "captured", "page_id", "archive", "offset")


class BadArchive(ValueError):
    """An archive's records do not parse, or a payload differs from its digest."""


def url_key(url: str) -> str:
    """Sort key of a URL: reversed host, path and query, without scheme, port, www and fragment."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + tail


def records(pages: DataFrame, captured: Column, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(value): one WARC record per page, as text without its closing line breaks.

    Of records with equal payloads of at least REVISIT_BYTES, those with the smallest id
    carry the payload and the others revisit them; rows that tie for the smallest id all
    carry it, and so do equal payloads without any id. The payload is the page's text in
    UTF-8, empty for null.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    base = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"),
        F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    ).withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    first = (
        base.filter(F.col("bytes") >= REVISIT_BYTES)
        .groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    )
    marked = base.join(first, "digest", "left").withColumn("again", ~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())

    def urn(id_name: str) -> Column:
        name = F.md5(F.concat_ws("-", F.coalesce(F.col(id_name).cast("string"), F.lit("none")), "digest"))
        part = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"), line("Content-Length", F.col("bytes").cast("string")), F.lit(EOL))
    block = F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("payload")))
    # Bytes that would end a header are escaped in the URI.
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("id")), line("WARC-Date", F.coalesce("captured", F.lit("1970-01-01T00:00:00Z"))),
        line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Refers-To", F.when(F.col("again"), urn("first"))),
        line("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("X-Page-Id", F.col("id").cast("string")), line("X-Refers-To-Page", F.when(F.col("again"), F.col("first").cast("string"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(EOL),
    )
    return marked.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, folder: str, captured: Column, id_col: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write archives under `folder`; tasks commit through Spark, on any file system."""
    size = pages.agg(F.sum(F.octet_length(F.col(html))).alias("b"), F.count("*").alias("n")).first()
    each = max(1, (size["b"] or 0) // max(1, size["n"]) + 700)
    (
        records(pages, captured, id_col, url, html).write
        .option("lineSep", EOL * 2).option("compression", "gzip")
        .option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // each)).text(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of all archives, each archive's sorted by ORDER (see CAPTURE_DDL).

    Every stored payload is hashed again and held against its header.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = list(captures(path.as_py().rsplit("/", 1)[-1], zlib.decompress(content.as_py(), 31)))
                if rows:
                    rows.sort(key=capture_key)
                    yield pa.RecordBatch.from_pylist(rows, schema=CAPTURE)

    return files.mapInArrow(parse, CAPTURE_DDL)


CAPTURE = pa.schema([
    (n, pa.string() if kind == "string" else pa.int64()) for n, kind in (c.split() for c in CAPTURE_DDL.split(", "))
])
_LENGTH = re.compile(rb"(?im)^Content-Length: *(\d+)\r$")


def captures(archive: str, body: bytes) -> Iterator[dict]:
    """The captures of one archive's bytes, in file order."""
    at = 0
    while at < len(body):
        end = body.find(b"\r\n\r\n", at)
        if not body.startswith(b"WARC/1.", at) or end < 0:
            raise BadArchive(f"{archive}: no record at {at}")
        fields = dict(
            line.split(": ", 1) for line in body[at:end].decode("utf-8", "replace").split(EOL)[1:] if ": " in line
        )
        start, size = end + 4, int(fields["Content-Length"])
        stop = start + size
        if body[stop : stop + 4] != b"\r\n\r\n":
            raise BadArchive(f"{archive}: record at {at} has no end")
        http = body.find(b"\r\n\r\n", start, stop) + 4
        declared = int(_LENGTH.search(body, start, http)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
        kind = fields["WARC-Type"]
        if kind == "response":
            payload = memoryview(body)[http:stop]
            if len(payload) != declared or hashlib.sha256(payload).hexdigest() != digest:
                raise BadArchive(f"{archive}: payload at {at} differs from its digest")
        url = fields.get("WARC-Target-URI")
        page, first = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
        yield {
            "archive": archive, "offset": at, "length": stop + 4 - at, "url": url, "url_key": url_key(url or ""),
            "captured": fields["WARC-Date"], "page_id": int(page) if page is not None else None, "record_type": kind,
            "payload_bytes": declared, "payload_digest": digest, "refers_to": int(first) if first is not None else None,
        }
        at = stop + 4


def capture_key(row: dict) -> tuple:
    """ORDER as a tuple; captures without an id come first."""
    page = row["page_id"]
    return row["url_key"].encode(), row["captured"], page is not None, page or 0, row["archive"], row["offset"]


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the root the winner.

    A pop replays one leaf's path, so an item costs log2(runs) comparisons. The least item
    comes first; runs are iterables of (key, value).
    """

    def __init__(self, runs: Sequence):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        count = len(self.runs)
        self.losers = [0] * count
        winners = [0] * count + list(range(count))
        for node in range(count - 1, 0, -1):
            left, right = winners[2 * node], winners[2 * node + 1]
            win, lose = (left, right) if self._before(left, right) else (right, left)
            winners[node], self.losers[node] = win, lose
        self.winner = winners[1] if count > 1 else 0

    def _before(self, left: int, right: int) -> bool:
        a, b = self.heads[left], self.heads[right]
        if a is None or b is None:
            return b is None
        return (a[0], left) <= (b[0], right)

    def __iter__(self) -> Iterator:
        while self.runs and (item := self.heads[self.winner]) is not None:
            yield item[1]
            leaf = self.winner
            self.heads[leaf] = next(self.runs[leaf], None)
            node = (leaf + len(self.runs)) // 2
            while node:
                if self._before(self.losers[node], leaf):
                    leaf, self.losers[node] = self.losers[node], leaf
                node //= 2
            self.winner = leaf


def merge(runs: DataFrame) -> DataFrame:
    """All captures with `part` and `at`: globally ordered by (part, at), as by ORDER.

    Ranges of ORDER hold about MERGE_ROWS captures each; one URL's history may span
    several. In a range, the runs' pieces come one after another and are merged.
    """
    parts = max(1, -(-runs.count() // MERGE_ROWS))
    order = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_first(), F.col("archive"), F.col("offset")]
    dealt = runs.repartitionByRange(parts, *order).sortWithinPartitions("archive", *order)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[str, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["archive"], []).append((capture_key(row), row))
        out: list[dict] = []
        done = 0
        for row in LoserTree(list(held.values())):
            out.append(row | {"part": part, "at": done})
            done += 1
            if len(out) == 5000:
                yield pa.RecordBatch.from_pylist(out, schema=MERGED)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=MERGED)

    return dealt.mapInArrow(pieces, CAPTURE_DDL + ", part int, at bigint")


MERGED = CAPTURE.append(pa.field("part", pa.int32())).append(pa.field("at", pa.int64()))


def histories(pages: DataFrame, captured: Column, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages to archives, read these back, and merge their index."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write(pages, folder, captured, id_col, url, html)
    return merge(cut_lineage(read(spark, folder)))
