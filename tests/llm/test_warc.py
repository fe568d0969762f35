import base64
import gzip
import hashlib
import os

import duckdb
from pyspark.sql import functions as F

from tessera.llm import warc

ROWS = [
    (5, "http://a/", "<p>same é</p>"), (3, "http://b/", "<p>same é</p>"), (9, None, "<p>same é</p>"), (9, None, "<p>same é</p>"),
    (7, "http://c/\r\nX: 1", None), (8, "http://d/", ""), (1, "http://e/", "WARC/1.1\r\n\r\n" * 5000), (None, "u", "lonely"), (None, "u", "<p>same é</p>"),
    (2, "http://f/", "x" * 300000), (2, "http://f/", "other"),
]


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        f = first.get(h or "")
        revisit = f is not None and i != f
        out.append((i, len((h or "").encode()), b32(h), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 3) for i, u, h in rows], "page_id bigint, url string, html string, offset int")


def test_rows(spark):
    got = warc.round_trip(spark, frame(spark, ROWS)).drop("url")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)
    assert warc.round_trip(spark, frame(spark, [])).count() == 0


def test_smaller_payloads_are_responses(spark):
    roles = warc.roles(frame(spark, ROWS), min_revisit=100)
    assert roles.where("revisits").count() == 0


def test_archives_ranges_and_bodies(spark, tmp_path):
    folder = str(tmp_path)
    index = warc.write_archives(frame(spark, ROWS).coalesce(1), folder, archive_bytes=500)
    assert index.select("archive").distinct().count() > 1
    for r in index.collect():
        with open(os.path.join(folder, r.archive), "rb") as f:
            f.seek(r.offset)
            fields, _, body = warc.parse(gzip.decompress(f.read(r.length)))
        assert fields["WARC-Payload-Digest"] == "sha1:" + r.digest
        assert (fields["WARC-Type"] == "response") == (r.record_type == "response")
    wanted = index.where(F.col("page_id").isin(1, 3, 8))
    bodies = dict(tuple(r) for r in warc.read_bodies(wanted, folder).collect())
    assert bodies[1] == ROWS[6][2] and bodies[3] == "<p>same é</p>"
    whole = warc.byte_ranges(index, gap=10**9)
    parts = warc.byte_ranges(index, gap=-1)
    assert whole.count() <= parts.count() and parts.count() == index.count()
    assert sum(len(r.records) for r in whole.collect()) == index.count()


def test_sql(spark):
    rows = [r for r in ROWS if r[0] is not None and r != ROWS[3] and r[2] != "other" and r[0] != 7] + [(7, "http://c/", None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = [r[:5] for r in con.execute("SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM (" + warc.ORACLE + ")").fetchall()]
    assert sorted(want, key=str) == brute(rows)
