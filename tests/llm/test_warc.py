"""Archives against their pages, and the merge against a sort."""

import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from featmart.llm import queries, warc

LONG = "<p>" + "same text " * 20 + "</p>"
PAGES = [
    (1, "http://www.A.example/x?q=1#top", LONG), (2, "http://b.example:8080/y", LONG), (3, None, LONG), (4, "http://a.example/x?q=1", "short"),
    (5, "http://a.example", "short"), (6, "", None), (7, "not a url", ""), (8, "http://e.example/\r\nX-Page-Id: 99", "WARC/1.1\r\n\r\nbody\r\n\r\n" * 9),
    (None, "http://n.example", LONG), (2, "http://b.example:8080/y", LONG), (9, "http://[bad", "é語" * 40), (10, "http://z.example", "x" * 300_000),
    (None, "http://n.example", "only without an id " * 9), (None, "http://n.example", "only without an id " * 9),
]


def plain(pages):
    first = {}
    for key, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 100 and key is not None:
            first[body] = min(key, first.get(body, key))
    out = []
    for key, _, html in pages:
        body = (html or "").encode()
        again = body in first and key != first[body]
        out.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(k, u, h, 1) for k, u, h in pages], "page_id bigint, url string, html string, offset int").repartition(3)


def captured():
    return F.timestamp_seconds(F.coalesce("page_id", F.lit(0)))


DIGEST = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archives_give_the_pages_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    monkeypatch.setattr(warc, "MERGE_ROWS", 4)
    got = warc.histories(frame(spark, PAGES), captured())
    assert sorted(map(tuple, got.select(*DIGEST).collect()), key=str) == plain(PAGES)
    rows = [r.asDict() for r in got.orderBy("part", "at").collect()]
    assert rows == sorted(rows, key=warc.capture_key) and len({r["archive"] for r in rows}) > 1


def test_offsets_point_at_records(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write(frame(spark, PAGES), folder, captured())
    bodies = {p.name: gzip.decompress(p.read_bytes()) for p in Path(folder).glob("*.gz")}
    for row in warc.read(spark, folder).collect():
        record = bodies[row.archive][row.offset : row.offset + row.length]
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + row.record_type.encode()) and record.endswith(b"\r\n\r\n")
    (name, body), *_ = [x for x in bodies.items() if b"same text" in x[1]]
    with pytest.raises(warc.BadArchive):
        list(warc.captures(name, body.replace(b"same text", b"some text", 1)))


def test_query_over_pages(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.PLANS["op2_warc_histories"](spark, sf)
    assert sorted(map(tuple, got.select(*DIGEST).collect()), key=str) == plain(pages)


def test_empty_table(spark):
    assert warc.histories(frame(spark, []), captured()).count() == 0


@pytest.mark.parametrize("count", [0, 1, 2, 3, 7, 64])
def test_loser_tree_is_a_stable_merge(count):
    rng = random.Random(count)
    runs = [sorted((rng.randrange(30), (i, j)) for j in range(rng.randrange(9))) for i in range(count)]
    got = list(warc.LoserTree(runs))
    assert got == [v for _, _, v in sorted((k, i, v) for i, run in enumerate(runs) for k, v in run)]
