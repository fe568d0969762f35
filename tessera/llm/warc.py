"""WARC archives with an index first (operator 5).

Writing: every task writes its pages as gzip members into archives of bounded
size under the given folder and returns one index row per record: archive,
offset, length, URL, payload digest. Archives have names no other attempt uses;
only index rows of committed tasks reach the index table, so a repeated task
leaves an archive nobody refers to, never a wrong record.

Reading: the index is selected first. The chosen records are sorted by archive
and offset, neighbours whose gap is small are coalesced into byte ranges of
bounded size, and each range is read once and cut into its records.

Equal payloads are stored once: the record with the smallest page id is a
response, the others are revisits that keep the HTTP header and name the
response. Roles come from an aggregate over digests, so a payload that a third
of all pages share is one row there.

Archives are written through pyarrow's file systems, so the folder may be any
URI they open (file, hdfs, s3, gs); it must be shared by all executors.

Defined results: a null html is the empty payload; a null url is an empty URI;
null ids are responses only if no page with that payload has an id; rows that
repeat an id and payload are all responses or all revisits; equal ids with
different payloads are kept apart; an empty table writes no archive; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import python_rows, written
from tessera.session import scratch_path

#: Compressed bytes after which an archive is closed, largest gap read through, and cell of offsets a byte range stays in.
ARCHIVE_BYTES = 256 << 20
GAP = 64 << 10
RANGE = 4 << 20
#: Bytes of archives a task reads back.
TASK_BYTES = 64 << 20
#: Smallest payload that can become a revisit.
MIN_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"

INDEX = "archive string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string, refers_to bigint"


def open_folder(uri: str):
    """(file system, path) of a shared folder; plain paths are local to a test."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def bare_digest(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode("ascii")


def one_line(value: str) -> str:
    """A header value: line ends would end the header."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str, payload: bytes, digest: str, revisits: bool, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http if revisits else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisits else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisits:
        fields.insert(5, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.insert(6, ("X-Refers-To-Page", "" if refers_to is None else str(refers_to)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, body) of one record as ``record`` lays it out."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode("ascii").split("\r\n")[1:]), body


def roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest hex, first_id): every page beside the smallest id with its payload."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    narrow = rows.where(F.octet_length("payload") >= min_revisit).select("page_id", "sha1")
    first = narrow.groupBy("sha1").agg(F.min("page_id").alias("first_id"))
    # The narrow (id, digest) rows meet their digest's first id; pages move once, by id, which no copies share.
    known = narrow.distinct().join(first, "sha1").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    known = written(known.select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "first_id"), "revisits")
    return rows.join(known, rows["page_id"].eqNullSafe(known["p"]) & (rows["sha1"] == known["s"]), "left").select(
        "page_id", "url", "payload", "sha1", F.col("s").isNotNull().alias("revisits"), "first_id"
    )


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all ``pages`` (page_id, url, html) below ``folder``; returns the index, already committed."""

    def run(batches):
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        for rows in python_rows(batches, 64):
            index = []
            for page_id, url, payload, sha1, revisits, first_id in rows:
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                digest = bare_digest(sha1)
                member = gzip.compress(record(page_id, url, payload, digest, revisits, first_id), 6, mtime=0)
                out.write(member)
                index.append((name, at, len(member), url, digest, page_id, "revisit" if revisits else "response", first_id if revisits else None))
                at += len(member)
                if at >= archive_bytes:
                    out.close()
                    out = None
            # Rows are given out only after their archive is closed or before it goes on growing: the index is
            # committed when the task ends, and by then every archive is closed.
            yield pa.record_batch(list(map(list, zip(*index, strict=True))), schema=schema)
        if out is not None:
            out.close()

    strings, numbers = pa.string(), pa.int64()
    schema = pa.schema([("archive", strings), ("offset", numbers), ("length", numbers), ("url", strings), ("digest", strings), ("page_id", numbers), ("record_type", strings), ("refers_to", numbers)])
    return written(roles(pages, min_revisit).mapInArrow(run, INDEX), "warc-index")


def byte_ranges(selected: DataFrame, gap: int = GAP, size: int = RANGE) -> DataFrame:
    """(archive, start, stop, records): sorted neighbours of the selected index rows, coalesced.

    A range starts at a fixed grid cell of ``size`` bytes or after a gap, so it has a bounded length and the
    window that finds gaps runs over one cell of one archive.
    """
    cell = F.expr(f"offset div {size}")
    order = Window.partitionBy("archive", "cell").orderBy("offset")
    rows = selected.select("archive", "offset", "length").distinct().withColumn("cell", cell)
    after = F.lag(F.col("offset") + F.col("length")).over(order)
    opened = rows.withColumn("opens", F.coalesce((F.col("offset") - after > gap).cast("int"), F.lit(1)))
    numbered = opened.withColumn("n", F.sum("opens").over(order))
    records = F.sort_array(F.collect_list(F.struct("offset", "length")))
    return numbered.groupBy("archive", "cell", "n").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), records.alias("records")
    ).select("archive", "start", "stop", "records")


def _spread(ranges: DataFrame, per_task: int = TASK_BYTES) -> DataFrame:
    """Ranges dealt over tasks by the bytes they will read. The rows are tiny, so row-based planning would put them into one task."""
    ranges = written(ranges, "warc-ranges")
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    tasks = max(-(-size // per_task), min(n, ranges.sparkSession.sparkContext.defaultParallelism), 1)
    return ranges.repartition(int(tasks), "archive", "start")


READ = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, stored_sha1 string"


def read_records(selected: DataFrame, folder: str, gap: int = GAP, size: int = RANGE) -> DataFrame:
    """Reads the selected index rows' records back: one row per record, with the SHA-1 of the stored body."""

    def run(batches):
        store, base = open_folder(folder)
        for rows in python_rows(batches, 1):
            for archive, start, stop, records in rows:
                with store.open_input_file(f"{base}/{archive}") as f:
                    f.seek(start)
                    raw = f.read(stop - start)
                found = []
                for r in records:
                    at = r["offset"] - start
                    fields, http, body = parse(gzip.decompress(raw[at : at + r["length"]]))
                    revisits = fields["WARC-Type"] == "revisit"
                    number = lambda v: int(v) if v else None
                    found.append((
                        number(fields["X-Page-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], number(fields.get("X-Refers-To-Page", "")),
                        int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                        None if revisits else base64.b32encode(hashlib.sha1(body).digest()).decode("ascii"),
                    ))
                yield pa.record_batch(list(map(list, zip(*found, strict=True))), schema=schema)

    strings, numbers = pa.string(), pa.int64()
    schema = pa.schema([("page_id", numbers), ("url", strings), ("record_type", strings), ("refers_to", numbers), ("payload_bytes", numbers), ("payload_digest", strings), ("stored_sha1", strings)])
    return _spread(byte_ranges(selected, gap, size)).mapInArrow(run, READ)


def read_bodies(selected: DataFrame, folder: str, gap: int = GAP, size: int = RANGE) -> DataFrame:
    """(page_id, html) of the selected responses; revisits have no body of their own and are left out."""

    def run(batches):
        store, base = open_folder(folder)
        for rows in python_rows(batches, 1):
            for archive, start, stop, records in rows:
                with store.open_input_file(f"{base}/{archive}") as f:
                    f.seek(start)
                    raw = f.read(stop - start)
                parsed = [parse(gzip.decompress(raw[r["offset"] - start : r["offset"] - start + r["length"]])) for r in records]
                kept = [(int(x["X-Page-ID"]) if x["X-Page-ID"] else None, body.decode("utf-8")) for x, _, body in parsed if x["WARC-Type"] == "response"]
                yield pa.record_batch([pa.array([k for k, _ in kept], pa.int64()), pa.array([b for _, b in kept], pa.string())], names=["page_id", "html"])

    return _spread(byte_ranges(selected, gap, size)).mapInArrow(run, "page_id bigint, html string")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages under the shared checkpoint folder and reads every record back through its index."""
    folder = scratch_path(spark, "llm", "warc")
    index = write_archives(pages, folder)
    back = read_records(index, folder)
    # A response whose stored body does not have the digest it was indexed under is an error, not a row.
    sound = F.when(F.coalesce(F.col("stored_sha1"), F.col("payload_digest")) == F.col("payload_digest"), F.col("payload_digest"))
    checked = F.coalesce(sound, F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))).cast("string"))
    return back.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", "url")


#: DuckDB statement of the registered query: digests as hex there, so they are spelled in base32 by five-bit groups.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
bits AS (SELECT h, string_agg(bits, '' ORDER BY k) AS b FROM (
  SELECT h, k, ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
    [instr('0123456789abcdef', substr(h, k, 1))] AS bits
  FROM (SELECT h, unnest(generate_series(1, 40)) AS k FROM f)) GROUP BY h),
spelled AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, k, 1)::INT + 8 * substr(b, k + 1, 1)::INT
    + 4 * substr(b, k + 2, 1)::INT + 2 * substr(b, k + 3, 1)::INT + substr(b, k + 4, 1)::INT, 1), '' ORDER BY k) AS digest
  FROM (SELECT h, b, unnest(generate_series(1, 160, 5)) AS k FROM bits) GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url
FROM p JOIN f USING (h) JOIN spelled USING (h)
"""
