"""WARC files: a writer, and a reader that splits files and verifies record boundaries by their chain.

A file is read in splits. A task looks for the version magic in its split and emits, for each place
where a header can be parsed, that offset and the offset of the record that would follow (header,
blank line, Content-Length bytes, two line ends). The magic also occurs inside payloads, which may
even be whole WARC files. So candidates of a file are put together and pointers jumped from the
start of the file (each round doubles the distance): what can be reached are the records, the rest
is payload. In a compressed file each record is a gzip member; candidates are members that begin with
the version magic, and their successor is where the member ends.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import batches as B
from kinfold.llm import words as W
from kinfold.plans.shared import scratch, written

MAGIC = b"WARC/1."
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
SPLIT = 8 << 20
DATE = "2026-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(kind: str, payload: bytes, number: str | None = None, uri: str | None = None, date: str = DATE) -> bytes:
    """One record, named ``urn:page:number`` or by a hash of what it has.

    Line ends in the URI are percent-encoded; a URI that a header can't have as it is (line ends, or white
    space at an end) is in the field Page-URL as well, all percent-encoded.
    """
    name = f"urn:page:{number}" if number is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha256(payload + repr((kind, uri)).encode('utf-8', 'surrogatepass')).hexdigest())}"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
        if uri != uri.strip() or "\r" in uri or "\n" in uri:
            lines.append("Page-URL: " + quote(uri, safe=""))
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + payload + END


def member(data: bytes) -> bytes:
    """A record as a gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def header(data: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """Fields (names in lower case) of the header at ``at`` and the payload's start; None if it is none."""
    end = data.find(END, at)
    if end < 0:
        return None
    lines = data[at:end].split(b"\r\n")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        return None
    fields: dict[bytes, bytes] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(name.strip().lower(), value.strip())
    if not fields.get(b"content-length", b"").isdigit():
        return None
    return fields, end + len(END)


def _written(folder: str, compress: bool, date: str):
    wrap = member if compress else bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(folder)
        sink, path = None, None
        for batch in batches:
            for number, uri, html in zip(*(W.column(batch, c).to_pylist() for c in ("page_id", "url", "html"))):
                if html is None:
                    continue
                if sink is None:
                    # a file that a lost or repeated task leaves is in no result: only what tasks return counts
                    path = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc{'.gz' if compress else ''}"
                    sink = filesystem.open_output_stream(path, compression=None)
                    inner = record("resource", b"a payload that is a record", "0", "urn:inner", date)
                    sink.write(wrap(record("warcinfo", b"software: kinfold\r\n" + inner + inner[:30], date=date)))
                sink.write(wrap(record("response", HTTP + html.encode("utf-8", "surrogatepass"), None if number is None else str(number), uri, date)))
        if sink is not None:
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "size"])

    return run


def write_pages(pages: DataFrame, folder: str, compress: bool = False, date: str = DATE) -> DataFrame:
    """Writes one WARC file per partition of ``(page_id, url, html)``; returns a written table of ``(path, size)``.

    Rows with a null html have no record; a null page_id gives a record without a page's name, a null url
    one without a URI. Repeated rows have a record each; an empty table gives no file. With ``compress``
    each record is a gzip member. ``date`` is when the pages were fetched.
    """
    return written(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_written(folder, compress, date), "path string, size long"), f"{folder}/files")


def _open(folder: str):
    filesystem, _ = fs.FileSystem.from_uri(folder)
    return filesystem


def _may_go_on(data: bytes, at: int) -> bool:
    """Whether what is there of a header, whose end is missing, can still become one."""
    lines = data[at:].split(b"\r\n")
    return (lines[0] in (b"WARC/1.0", b"WARC/1.1") or len(lines) == 1 and len(lines[0]) < 9) and all(b":" in line for line in lines[1:-1])


def candidates(read, size: int, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(offset, successor, payload's start) of each header that begins in [start, stop). ``read(a, b)`` gives bytes."""
    data = read(start, min(size, stop + len(MAGIC) - 1))
    at = data.find(MAGIC)
    while at >= 0:
        found, reach = header(data, at), 1 << 14
        while found is None and data.find(END, at) < 0 and start + len(data) < size and _may_go_on(data, at):  # it goes on behind the split
            data += read(start + len(data), min(size, start + len(data) + reach))
            reach *= 2
            found = header(data, at)
        if found:
            fields, body = found
            yield start + at, start + body + int(fields[b"content-length"]) + len(END), start + body
        at = data.find(MAGIC, at + 1)
        if at >= stop - start:
            return


def unpacked(read, size: int, at: int, piece: int = 1 << 16) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` has and where it ends (beyond ``size`` if it is cut off); None if it isn't a record's."""
    open_, out = zlib.decompressobj(31), []
    n = end = at
    while n < size:
        data = read(n, min(size, n + piece))
        try:
            out.append(open_.decompress(data))
        except zlib.error:
            return None
        n += len(data)
        if len(out) > 1 and len(out[0]) < len(MAGIC):
            out = [b"".join(out)]
        if out[0][: len(MAGIC)] != MAGIC[: len(out[0])]:
            return None
        if open_.eof:
            end = n - len(open_.unused_data)
            return b"".join(out), end
        piece *= 2
    return (b"".join(out), size + 1) if out and out[0] else None


def members(read, size: int, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """The same for a compressed file: gzip members that begin in [start, stop)."""
    data = read(start, min(size, stop + len(GZIP) - 1))
    at = data.find(GZIP)
    while 0 <= at < stop - start:
        if found := unpacked(read, size, start + at):
            yield start + at, found[1], -1
        at = data.find(GZIP, at + 1)


def _found(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem = _open(folder)
        for batch in batches:
            for path, size, start, stop in zip(*(W.column(batch, c).to_pylist() for c in ("path", "size", "start", "stop"))):
                with filesystem.open_input_file(path) as source:

                    def read(a: int, b: int, source=source) -> bytes:
                        source.seek(a)
                        return source.read(b - a)

                    rows = list((members if read(0, len(GZIP)) == GZIP else candidates)(read, size, start, stop))
                offsets, after, bodies = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(x, pa.int64()) for x in ([size] * len(rows), offsets, after, bodies))], ["path", "size", "offset", "after", "body"])

    return run


def reachable(offsets: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches. Offsets ascend; pointers go up, or nowhere."""
    n = len(offsets)
    at = np.minimum(np.searchsorted(offsets, after), n - 1) if n else np.zeros(0, np.int64)
    jump = np.append(np.where(offsets[at] == after, at, n) if n else at, n)  # n: nowhere
    marked = np.zeros(n + 1, bool)
    if n and offsets[0] == 0:
        marked[0] = True
    marked_n = -1
    while marked_n != (marked_n := int(marked[:n].sum())):
        marked[jump[np.flatnonzero(marked)]] = True
        jump = jump[jump]
    return marked[:n]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in B.grouped(batches, "path"):
        offsets, after = table.column("offset").to_numpy(), table.column("after").to_numpy()
        table = table.take(pa.array(np.argsort(offsets, kind="stable")))
        offsets, after = table.column("offset").to_numpy(), table.column("after").to_numpy()
        yield from table.filter(pa.array(reachable(offsets, after))).combine_chunks().to_batches(max_chunksize=20_000)


def http_body(fields: dict[str, str], payload: bytes) -> int:
    """Where the body begins: behind the HTTP header in a response, else at the payload's start."""
    end = payload.find(END) if fields.get("warc-type") == "response" else -1
    return end + len(END) if end >= 0 else 0


def _read(folder: str):
    kinds = {"path": pa.string(), "offset": pa.int64(), "kind": pa.string(), "record_id": pa.string(), "uri": pa.string(), "payload": pa.binary(), "body_at": pa.int64(), "truncated": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem = _open(folder)
        source, opened, rows, waiting = None, None, [], 0
        for batch in batches:
            for path, size, at, after, body in zip(*(W.column(batch, c).to_pylist() for c in ("path", "size", "offset", "after", "body"))):
                if path != opened:
                    source, opened = filesystem.open_input_file(path), path

                def read(a: int, b: int, source=source) -> bytes:
                    source.seek(a)
                    return source.read(b - a)

                if body < 0:
                    data, _ = unpacked(read, size, at)
                    if (found := header(data, 0)) is None:
                        continue
                    fields, start = found
                    stop = start + int(fields[b"content-length"])
                    cut = after > size or len(data) < stop
                    data = data[:stop]
                else:
                    data = read(at, min(size, after - len(END)))
                    fields, start = header(data[: body - at], 0)
                    cut = after > size
                text = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in fields.items()}
                rows.append((path, at, text.get("warc-type"), text.get("warc-record-id"), unquote(text["page-url"]) if "page-url" in text else text.get("warc-target-uri"), data[start:], http_body(text, data[start:]), cut))
                waiting += len(data)
                if waiting > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))
                    rows, waiting = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    return run


def records(files: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """``(path, offset, kind, record_id, uri, payload, body_at, truncated)`` of every record of ``files`` (``path, size``).

    ``folder`` is any URI on the files' file system. Only records that the chain of lengths reaches from
    the start of their file are returned; a file that doesn't begin with a record has none, and a broken
    length ends the chain of its file. A record that goes beyond the end of its file is ``truncated``; ``body_at`` is where the body of an HTTP message begins.
    Empty files and an empty table have no record; null paths are left out.
    """
    starts = F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {split}L)"))
    splits = files.where("path is not null and size > 0").select("path", F.col("size").cast("long").alias("size"), starts.alias("start")).withColumn("stop", F.col("start") + split)
    found = splits.repartition("path", "start").mapInArrow(_found(folder), "path string, size long, offset long, after long, body long")
    chain = found.repartition("path").sortWithinPartitions("path").mapInArrow(_chained, "path string, size long, offset long, after long, body long")
    piece = chain.withColumn("split", F.expr(f"offset div {split}"))
    return piece.repartition("path", "split").sortWithinPartitions("path", "offset").mapInArrow(_read(folder), "path string, offset long, kind string, record_id string, uri string, payload binary, body_at long, truncated boolean")


def pages(found: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` of the responses among records: the body behind the HTTP header, as UTF-8 text."""
    return found.where("kind = 'response'").select(
        F.expr("try_cast(regexp_extract(record_id, '<urn:page:(-?[0-9]+)>', 1) as bigint)").alias("page_id"),
        F.col("uri").alias("url"),
        F.expr("cast(substring(payload, cast(body_at + 1 as int)) as string)").alias("html"),
    )


def round_trip(source: DataFrame, split: int = SPLIT, compress: bool = False) -> DataFrame:
    """``(page_id, url, html)``: pages written as WARC files to the shared folder and read back from them.

    All rows come back as they are, null ids and URLs, empty and repeated ones too, but for those with a
    null html; an empty table gives an empty one, and other columns aren't read.
    """
    folder = scratch(source.sparkSession, "warc")
    return pages(records(write_pages(source, folder, compress), folder, split))
