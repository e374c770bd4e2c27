"""WARC archives of pages, and the merge of their capture indexes.

Pages become WARC/1.1 records. Of pages with equal payloads the one with the
largest id is a response, the others are revisits that refer to it and carry no
payload. Archives are gzip files of a bounded number of records, each sorted by
URL key and time, so each is a locally sorted run of captures. They are read
again by their lengths, checked by their digests, and their runs are merged:
ranges of (URL key, time, id) are dealt out by samples, so many that each holds
about `RANGE` captures, and in each range a loser tree merges the runs' parts,
reading each run piece by piece. The result is in one global order.

Pages of more than `LONG` bytes go to archives of their own, of so many records
that `AT_MOST` bytes aren't exceeded by more than one page. Which pages repeat
is found by ids and digests; payloads are moved once, by their ids.

Null payloads are empty. Control characters and spaces in URLs are percent-encoded; null
URLs have no URI header and the empty key. Rows that repeat an id and a payload
are alike: all responses or all revisits.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import batched
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.llm.common import arrow_map, parts, shared_dir, stored, table

RECORDS = 2_000
#: Bytes of a page that goes to archives of long pages, and of all records of one of these; captures of a range.
LONG, AT_MOST, RANGE = 1 << 16, 1 << 27, 1 << 16
#: Pages have no capture time: a page's is so many seconds after this as its id says.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
SECONDS = 10**9
CRLF = "\r\n"


def url_key(url: str | None) -> str:
    """The URL for sorting: host labels from the last, then path and query, lower-case, without scheme, port 80 and 443, and www."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else "")


def _header(x: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in x)


def _id(page_id: int | None) -> str:
    h = hashlib.md5(f"page {page_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def digest32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record(page_id: int | None, url: str | None, payload: str, sha1: str, size: int, refers_to: int | None) -> str:
    """A WARC record without its last line end. A revisit keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}{CRLF}{CRLF}"
    when = EPOCH + timedelta(seconds=(page_id or 0) % SECONDS)
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{digest32(sha1)}"]
    lines += [f"WARC-Target-URI: {_header(url)}"] if url else []
    lines += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"] if revisit else []
    body = 0 if revisit else size
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + body}"]
    return CRLF.join(lines) + CRLF + CRLF + http + ("" if revisit else payload) + CRLF


def parse(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes, int]]:
    """(WARC headers, HTTP headers, payload, offset) of each record of an archive."""
    at = 0
    split = lambda block: dict(x.split(": ", 1) for x in block.decode().split(CRLF)[1:])
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = split(data[at:end])
        size = int(head["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        stop = body.index(b"\r\n\r\n")
        if len(body) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"broken record at {at}")
        yield head, split(body[:stop]), body[stop + 4 :], at
        at = end + 8 + size


def write(pages: DataFrame, path: str) -> None:
    """Archives of pages (page_id, url, html) in the folder, each sorted by URL key, time and id."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    ids = rows.groupBy("page_id", "sha1", "size").agg(F.count("*").alias("n"))
    first = ids.groupBy("sha1", "size").agg(F.max("page_id").alias("first"))
    again = ids.join(first, ["sha1", "size"]).where(F.col("page_id") < F.col("first")).select("page_id", "sha1", "size", F.col("first").alias("refers_to"))
    rows = rows.join(again, ["page_id", "sha1", "size"], "left")

    def key(batch):
        yield *(batch.column(x) for x in columns), pa.array([url_key(x) for x in batch.column("url").to_pylist()])

    def build(batch):
        cols = [batch.column(x).to_pylist() for x in ("page_id", "url", "html", "sha1", "size", "refers_to")]
        for i in range(0, batch.num_rows, 500):
            yield (pa.array([record(*x) for x in zip(*(c[i : i + 500] for c in cols), strict=True)]),)

    columns = ["page_id", "url", "html", "sha1", "size", "refers_to"]
    def archives(rows: DataFrame, records: int, mode: str) -> None:
        keyed = arrow_map(rows.select(columns), key, "page_id long, url string, html string, sha1 string, size long, refers_to long, key string")
        ordered = keyed.sortWithinPartitions("key", F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS)), "page_id")
        arrow_map(ordered, build, "value string").write.mode(mode).option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)

    archives(rows.where(F.col("size") <= LONG), RECORDS, "error")
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    if longest > LONG:
        archives(rows.where(F.col("size") > LONG), max(1, AT_MOST // longest), "append")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the folder's archives: url_key, captured, page_id, record_type, payload_bytes, payload_digest, refers_to, archive, nr, start."""
    names = ["url_key", "captured", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "archive", "nr", "start"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batch):
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data, rows = zlib.decompress(content.as_buffer(), 31), []
            for nr, (w, h, payload, start) in enumerate(parse(data)):
                digest = w["WARC-Payload-Digest"].removeprefix("sha1:")
                if w["WARC-Type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(h["Content-Length"])):
                    raise ValueError(f"{file}: the record at {start} doesn't match its digest")
                of = lambda k: int(w[k]) if k in w else None  # noqa: B023, E731
                rows.append((url_key(w.get("WARC-Target-URI")), w["WARC-Date"], of("WARC-Page-ID"), w["WARC-Type"], int(h["Content-Length"]), digest, of("WARC-Refers-To-Page-ID"), file.rsplit("/", 1)[-1], nr, start))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return arrow_map(files, run, "url_key string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, nr long, start long")


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next least item costs one path."""

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(x) for x in runs]
        self.k = max(len(self.runs), 1)
        self.heads = [next(x, None) for x in self.runs] or [None]
        self.tree = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._before(self.tree[node], w):
                    w, self.tree[node] = self.tree[node], w
                node //= 2
            self.winner = w


def _captures(t: pa.Table, at: np.ndarray, at_once: int = 1024) -> Iterator[tuple]:
    """(key, time, has an id, id, row) of rows of the table, a piece at a time."""
    for i in range(0, len(at), at_once):
        some = t.take(pa.array(at[i : i + at_once]))
        for key, when, page, row in zip(*(some.column(x).to_pylist() for x in ("url_key", "captured", "page_id")), at[i : i + at_once].tolist(), strict=True):
            yield key, when, page is not None, page or 0, row


def merged(index: DataFrame) -> DataFrame:
    """The captures in one order by url_key, captured and page_id, with their place as `position`: range by range."""
    spark, names = index.sparkSession, index.columns
    schema = index.schema.add("position", "long")
    ranges = max(parts(spark), index.count() // RANGE)
    rows = index.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("archive", "nr")

    def run(batches):
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        file = t.column("archive").to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.append(True, file[1:] != file[:-1]))
        runs = [_captures(t, at) for at in np.split(np.arange(len(file)), begins[1:])]
        base, at = TaskContext.get().partitionId() << 32, 0
        order = LoserTree(runs)
        for some in batched((x[-1] for x in order), 8192):
            out = t.take(pa.array(some)).append_column("position", pa.array(range(base + at, base + at + len(some)), pa.int64()))
            at += len(some)
            yield from out.combine_chunks().to_batches()

    return rows.select(names).mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write(table(spark, sf_dir, "pages"), path)
    return merged(stored(read(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")
