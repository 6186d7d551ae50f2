"""WARC archives with a two-level capture index.

Pages are written as gzip members, one per record, to archives of bounded size in the shared
folder; pages whose payload equals that of another page become revisit records. Captures are
sorted by reversed-host URL key into compressed blocks; a sparse directory keeps the first and
last key of each block. A lookup bisects the directory, opens the blocks that may hold a key,
and reads the byte ranges of its records.

Recovery. A task writes files under names no other attempt uses, and its rows name them, so a
lost or repeated task leaves at most files that no index entry mentions. Captures and index are
tables written by Spark. Archives are read and written through ``pyarrow.fs`` by the URI of the
shared folder, so any store it knows will do.

Cases. A null html is an empty payload. A null url gets the empty key and a URN as target. A
null page id is always a response. Pages below ``least`` bytes are always responses. Of equal
payloads the largest id is the response; rows that repeat that id are responses too. Characters
that would break a header line are percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sevfold.llm.tables import set_down, sized, small_batches
from sevfold.sources.paths import scratch

ARCHIVE_BYTES = 32 << 20
BLOCK_LINES = 3000
READ_BYTES = 4 << 20
#: Bytes of archives that a task reads back, about.
TASK_BYTES = 8 << 20
DATE = "2020-01-01T00:00:00Z"

# Names of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query. Control characters are percent-encoded, so a key is one cell of a line."""
    if not url:
        return ""
    return _header(_host_first(url))


def _host_first(url: str) -> str:
    try:
        parts = urlsplit(url.strip() if "//" in url else f"//{url.strip()}")
        host = (parts.hostname or "").rstrip(".").lower()
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + port + ")" + tail


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), value)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP headers of the page but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url) if url else f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is None:
        lines.append("X-No-Url: 1")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(raw: bytes) -> dict:
    """Fields of a record; digest and size are those of the full payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != told):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": None if "X-No-Url" in fields else fields["WARC-Target-URI"], "record_type": kind,
        "payload_bytes": size, "payload_digest": told, "refers_to": number("X-Refers-To-Page"), "payload": payload if kind == "response" else None,
    }


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        name, out, offset = "", None, 0
        try:
            for batch in batches:
                captures = []
                for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]):
                    page_id, url, html, digest, refers_to = row
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    kind = "response" if refers_to is None else "revisit"
                    data = member(record(kind, page_id, url, (html or "").encode(), digest, refers_to))
                    out.write(data)
                    captures.append((url_key(url), page_id, name, offset, len(data)))
                    offset += len(data)
                columns = list(zip(*captures)) if captures else [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "page_id", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Write a record per page below ``folder``; the captures, set down."""
    small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("n"))
    equal = read.filter(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("c")).filter("c > 1 and holder is not null")
    equal = set_down(equal.select(F.col("digest").alias("d"), "holder"), "equal")
    refers = F.when(F.col("page_id") < F.col("holder"), F.col("holder")).alias("refers_to")
    records = read.join(sized(equal, 80), (F.col("digest") == F.col("d")) & (F.col("n") >= least), "left").select("page_id", "url", "html", "digest", refers)
    return set_down(records.mapInArrow(_writer(folder), CAPTURE), "captures")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    lines: list[tuple] = []
    seq = 0

    def block() -> pa.RecordBatch:
        text = "\n".join("\t".join("" if v is None else str(v) for v in line) for line in lines)
        cells = [[part], [seq], [lines[0][0]], [lines[-1][0]], [len(lines)], [zlib.compress(text.encode())]]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["part", "seq", "first_key", "last_key", "n", "block"])

    for batch in batches:
        for line in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "archive", "offset", "length")]):
            lines.append(line)
            if len(lines) == BLOCK_LINES:
                yield block()
                lines, seq = [], seq + 1
    if lines:
        yield block()


def build_index(captures: DataFrame) -> DataFrame:
    """Blocks of captures in key order, with the directory columns ``first_key`` and ``last_key``; set down."""
    order = ["key", "page_id", "archive", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return set_down(ranged.mapInArrow(_blocks, "part int, seq int, first_key string, last_key string, n int, block binary"), "index")


def _lines(block: bytes) -> list[tuple]:
    rows = (line.split("\t") for line in zlib.decompress(block).decode().split("\n"))
    return [(key, int(page) if page else None, archive, int(offset), int(length)) for key, page, archive, offset, length in rows]


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "page_id", "archive", "offset", "length"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block").to_pylist():
            yield _captures(_lines(block))


def all_captures(index: DataFrame) -> DataFrame:
    return index.select("block").mapInArrow(_expand, CAPTURE)


def lookup(index: DataFrame, urls: DataFrame) -> DataFrame:
    """Captures of the URLs in column ``url``: bisect parts, then blocks, then lines.

    Parts are the key ranges the index was sorted by, as many as its partitions; their bounds
    are the first level and travel with the plan.
    """
    parts = index.groupBy("part").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).orderBy("a", "part").collect()
    spans = [(r["part"], r["a"], r["b"]) for r in parts]
    lasts = [s[2] for s in spans]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = [], []
            for url in batch.column("url").to_pylist():
                key = url_key(url)
                i = bisect.bisect_left(lasts, key)
                while i < len(spans) and spans[i][1] <= key:
                    keys.append(key)
                    at.append(spans[i][0])
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.string())], names=["part", "key"])

    def find(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("seq")
        first, last, data = (blocks.column(c).to_pylist() for c in ("first_key", "last_key", "block"))
        found: list[tuple] = []
        opened: dict[int, list[tuple]] = {}
        for key in sorted(set(wanted.column("key").to_pylist())):
            i = bisect.bisect_left(last, key)
            while i < len(first) and first[i] <= key:
                opened = {i: opened.get(i) or _lines(data[i])}
                lines = opened[i]
                j = bisect.bisect_left(lines, key, key=lambda line: line[0])
                while j < len(lines) and lines[j][0] == key:
                    found.append(lines[j])
                    j += 1
                i += 1
        return pa.Table.from_batches([_captures(found)])

    wanted = urls.select("url").mapInArrow(place, "part int, key string").distinct()
    return wanted.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(find, CAPTURE)


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        name, source, kept, at = "", None, b"", 0
        names = [c.split()[0] for c in RECORD.split(", ")]
        schema = pa.schema([(n, pa.string() if "string" in c else pa.binary() if "binary" in c else pa.int64()) for n, c in zip(names, RECORD.split(", "))])
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")]):
                if archive != name:
                    name, source, kept, at = archive, store.open_input_file(f"{base}/{archive}"), b"", 0
                if not at <= offset <= offset + length <= at + len(kept):
                    kept, at = source.read_at(max(length, READ_BYTES), offset), offset
                row = parse(zlib.decompress(kept[offset - at : offset - at + length], 31))
                if not with_payload:
                    row["payload"] = None
                rows.append(row)
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_records(captures: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records at the byte ranges of ``captures``; each archive is read in the order of its offsets."""
    ranges = set_down(captures.select("archive", "offset", "length"), "ranges")
    tasks = -(-(ranges.agg(F.sum("length")).first()[0] or 1) // TASK_BYTES)
    by_archive = ranges.repartition(tasks, "archive").sortWithinPartitions("archive", "offset")
    return by_archive.mapInArrow(_reader(folder, with_payload), RECORD)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write all pages, index them, and read every record back through the index."""
    folder = scratch(pages.sparkSession, "warc")
    index = build_index(write_archives(pages, folder, least))
    return read_records(lookup(index, pages.select("url")), folder, with_payload=False)
