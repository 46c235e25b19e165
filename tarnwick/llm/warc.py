"""WARC archives: writing, reading back, and a merged capture index.

Tasks write .warc.gz files (one gzip member a record) to a shared folder and
report them in a manifest; only files in it count, so those of failed attempts
are never read.  Scanning an archive gives a run of index entries sorted by URL
key and time.  The runs are written out, dealt to key ranges, and each range
merges its runs with a loser tree, so that the ranges together are one globally
ordered capture history.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, table, written

#: Bytes after which a task starts another archive, and index entries in a range of the merge.
ARCHIVE_BYTES, RANGE_ROWS = 64 << 20, 200_000
#: Fixed value: captures are dated one second apart from here by page_id, as pages carry no time of their own.
FIRST_SECOND = 1_704_067_200
LEVEL = 3
RUN_SCHEMA = "url_key string, timestamp long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def url_key(url: str) -> str:
    """The URL with its host's labels reversed, so that captures of a domain sort together: com,example,www)/path."""
    m = re.match(r"[^:/?#]*://([^/?#]*)(.*)", url or "", re.S)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + m[2] if m else (url or "")


def _quoted(url: str | None) -> str:
    """A URL for a header: what is not printable ASCII is percent-encoded."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, seconds: int, refers_to: int | None = None, revisit: bool = False, mark: str = "") -> bytes:
    """One WARC/1.1 response or revisit record, uncompressed; mark makes the id of a record whose page_id is not its own unique."""
    import time

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    date = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(seconds))
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}{mark}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_quoted(url) or 'urn:none'}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, archive_bytes: int):
    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        out, name, size, rows, done = None, "", 0, 0, []

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, rows, size))
                out = None

        for b in batches:
            for page_id, url, html, sha, keeper, revisit, shared in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size, rows = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                plain = record(page_id, url, html or b"", digest, FIRST_SECOND + (page_id or 0) % 10**9, keeper, revisit, f":{name.partition('.')[0]}-{rows}" if shared else "")
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = z.compress(plain) + z.flush()
                out.write(data)
                size, rows = size + len(data), rows + 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["archive", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of pages(page_id, url, html, ...) to .warc.gz files in folder; returns their manifest.

    The payload is the html in UTF-8 (null: empty).  Of the records with equal
    payloads those of the largest page_id are responses (rows repeated with it,
    all of them; a page_id beats none), the others revisits of it.  A record's
    id is unique, whatever the page_ids.  Columns of other names are not read;
    an empty table gives archives without records, and very long payloads are
    records like any other.  folder is a URI that the driver and executors share
    (file, hdfs, s3 or gs).
    """
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    data = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", data.alias("html"), F.sha1(data).alias("sha"))
    same = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper")).filter("n > 1")
    # Only payloads that repeat: written first, so that the join is planned on its true size.
    same = written(same.select(F.col("sha").alias("k_sha"), "keeper"), "warc-repeats")
    rows = rows.join(same, F.col("sha") == F.col("k_sha"), "left")
    revisit = F.col("k_sha").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    ids = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND page_id IS NOT NULL")
    ids = written(ids.select(F.col("page_id").alias("k_id")), "warc-repeated-ids")
    rows = rows.join(ids, F.col("page_id") == F.col("k_id"), "left")
    shared = F.col("page_id").isNull() | F.col("k_id").isNotNull()
    rows = rows.select("page_id", "url", "html", "sha", "keeper", revisit.alias("revisit"), shared.alias("shared"))
    return written(rows.mapInArrow(_writer(folder, archive_bytes), "archive string, records long, bytes long"), "warc-manifest")


def members(stream, chunk: int = 1 << 20):
    """(offset, length, data) of each gzip member of a stream, read a chunk at a time."""
    start, at, z, out, rest = 0, 0, zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            if out or at != start:
                raise ValueError("the archive ends within a record")
            return
        out.append(z.decompress(data))
        rest = z.unused_data
        at += len(data) - len(rest)
        if z.eof:
            yield start, at - start, b"".join(out)
            start, z, out = at, zlib.decompressobj(31), []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record; a response's payload is what follows its HTTP headers."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = block[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers["payload-bytes"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    return headers, payload


def _scanner(folder: str):
    def run(batches):
        import calendar
        import time

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)

        def number(s):
            s = s and s[len("<urn:page:") : -1].partition(":")[0]
            return int(s) if s and s != "none" else None

        names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    for offset, length, data in members(stream):
                        h, payload = parse(data)
                        digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{archive}, {offset}: the payload's digest differs")
                        size = len(payload) if kind == "response" else int(h["payload-bytes"])
                        seconds = calendar.timegm(time.strptime(h["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ"))
                        rows.append((url_key(h["WARC-Target-URI"]), seconds, number(h["WARC-Record-ID"]), size, digest, kind, number(h.get("WARC-Refers-To")), archive, offset, length))
                rows.sort(key=_order)
                columns = zip(*rows, strict=True) if rows else [()] * 10
                kinds = [pa.string() if " string" in c else pa.int64() for c in RUN_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _order(row: tuple) -> tuple:
    """Of an index entry: URL key, time, page (none first), archive and offset."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class LoserTree:
    """Merges sorted iterables: each inner node keeps the loser of its match, so the next winner costs one path from leaf to root."""

    def __init__(self, runs: list, key=lambda x: x):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k - 1, -1, -1):
            self._play(i, True)

    def _next(self, i):
        for row in self.runs[i]:
            return self.key(row), row
        return None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def _play(self, winner: int, filling: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.losers[node] < 0 and filling:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner][1]
            self.heads[winner] = self._next(winner)
            self._play(winner)


def _merge(batches):
    """Rows of a key range in order.  What arrives is sorted runs end to end: a run ends where the order falls."""
    runs, last, schema = [], None, None
    for b in batches:
        schema = b.schema
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key = _order(row)
            if last is None or key < last:
                runs.append([])
            runs[-1].append(row)
            last = key
    if schema is None:
        return
    out = []
    for row in LoserTree(runs, _order):
        out.append(row)
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema.names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema.names)


def capture_index(manifest: DataFrame, folder: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of the manifest's archives in global order of URL key, time and page: RUN_SCHEMA's columns.

    Every record is read, and a response's payload checked against its digest.
    Ranges hold about range_rows entries; captures of one URL may span ranges,
    as time, page and place in the archives are part of the order.  A range's
    entries are what one task holds; payloads are not among them.  Captures
    without a page_id come first among those of one URL and time; other columns
    of the manifest are not read.  An empty manifest gives no rows.
    """
    names = manifest.select("archive")
    n, total = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("records"), F.lit(0))).first()
    parallel = min(max(n, 1), 2 * manifest.sparkSession.sparkContext.defaultParallelism) if n < 10_000 else n // 4
    runs = written(names.repartition(parallel, "archive").mapInArrow(_scanner(folder), RUN_SCHEMA), "warc-runs")
    keys = [F.col("url_key"), F.col("timestamp"), F.col("page_id").isNotNull(), F.col("page_id"), F.col("archive"), F.col("offset")]
    return runs.repartitionByRange(max(1, -(-total // range_rows)), *keys).mapInArrow(_merge, RUN_SCHEMA)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    captures = capture_index(write_archives(table(spark, sf_dir, "pages"), folder), folder)
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


