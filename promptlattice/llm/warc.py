"""Splittable reader, and writer, of gzipped web archives.

An archive file is a row of gzip members, a record each. Gzip has no index, so a file is cut into byte ranges and each range is a task: it scans its range for
gzip's magic bytes, takes a place as a member only if the member's header and the archive record header inside decode, and owns the
records that start within its range, whose bytes it reads beyond the range's end as far as they go. From one record on, the next starts where the
member ended, so scanning happens only at a range's start and after damage. Every record is thus read once, whatever the size of the ranges.

A member counts only if the whole of it passes its checksum. One that begins where the member before ended is taken as it is. One that was found by scanning must also be followed by the
file's end, by padding or by another gzip header, as bytes of a stored payload may look like a whole member; if it is not, members further back are read up to its place, which tells
a record before damage from a part of a payload. Damaged members are skipped, and reading goes on at the next one.

Files are read through Arrow's file systems, so a path may be local or any URI these know.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_folder

SPLIT = 8 << 20
#: Beyond so many ranges a task reads several.
MOST_TASKS = 50_000
#: Bytes read at a time, and of a batch of records.
READ, BATCH = 1 << 20, 8 << 20
MAGIC = b"\x1f\x8b\x08"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class _Window:
    """Bytes of a file from a moving start, read as they are needed."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.data, self.base = file, at, size, b"", 0
        file.seek(at)

    def peek(self, a: int, b: int) -> memoryview:
        """Bytes a to b from the start on, or those up to the file's end."""
        while (have := len(self.data) - self.base) < b and self.at + have < self.size:
            got = self.file.read(max(READ, b - have, have))  # as much as there is again, so that long members are copied few times
            if not got:
                break
            self.data, self.base = self.data[self.base :] + got, 0
        return memoryview(self.data)[self.base + a : self.base + b]

    def seek(self) -> bool:
        """Moves on to the next place that has the magic bytes, the present one included; False if there is none."""
        while data := self.peek(0, READ):
            at = self.data.find(MAGIC, self.base)
            if at >= 0:
                self.drop(at - self.base)
                return True
            self.drop(max(1, len(data) - 2))
        return False

    def drop(self, n: int) -> None:
        self.base += n
        self.at += n


def _looks_right(head: bytes | memoryview) -> bool:
    """A gzip header: magic, deflate, no reserved flags."""
    return len(head) >= 10 and head[:3] == MAGIC and not head[3] & 0xE0


def _starts_record(window: _Window) -> bool:
    """Whether a member begins here whose content begins as an archive record."""
    if not _looks_right(window.peek(0, 10)):
        return False
    z = zlib.decompressobj(31)
    head, used, step = b"", 0, 4096
    try:
        # a gzip header's extra field and name may be longer than the first step
        while len(head) < 5 and not z.eof:
            piece = window.peek(used, used + step)
            if not piece:
                break
            head += z.decompress(piece, 16)
            used, step = used + len(piece), 2 * step
    except zlib.error:
        return False
    return head.startswith(b"WARC/")


def _member(window: _Window) -> tuple[bytes, int] | None:
    """(content, compressed bytes) of the member that begins here, checksum and all; None if it is damaged."""
    z = zlib.decompressobj(31)
    out, used, step = [], 0, 16384
    try:
        while not z.eof:
            piece = window.peek(used, used + step)
            if not piece:
                return None
            out.append(z.decompress(piece))
            used, step = used + len(piece), min(READ, 4 * step)
    except zlib.error:
        return None
    return b"".join(out), used - len(z.unused_data)


def _followed(window: _Window, used: int) -> bool:
    """Whether the file's end, padding or a gzip header comes after so many bytes."""
    rest = window.peek(used, used + 10)
    return not rest or _looks_right(rest) or not bytes(rest).strip(b"\0")


def _in_row(fs: pafs.FileSystem, where: str, size: int, at: int) -> bool:
    """Whether a whole member at this place, which nothing follows as it should, is a record: members from further back on, one after another, tell, as they meet its place or
    pass over it. If damage stands between, or nothing else does before it, it is one."""
    back = READ
    while True:
        start = max(0, at - back)
        with fs.open_input_file(where) as file:
            window = _Window(file, start, size)
            row, seen = start == 0, False
            for place, got in _members(window, at, row):
                row = window.at == place and got is not None
                seen = seen or row
            if row and window.at >= at:
                return window.at == at
        if seen or start == 0:
            return True
        back *= 4


def _members(window: _Window, end: int, row: bool, sure=lambda: False) -> Iterator[tuple[int, tuple[bytes, int] | None]]:
    """(place after it, the member) of each record's member that begins before end, and (_, None) for each place that has none. row says that a member begins where the window does; sure()
    is asked about members that were found by scanning and that nothing follows as it should."""
    while window.at < end:
        place = window.at
        if not window.seek():
            return
        row = row and window.at == place
        if window.at >= end:
            return
        got = _member(window) if _starts_record(window) else None
        row = got is not None and (row or _followed(window, got[1]) or sure())
        at = window.at
        window.drop(got[1] if row else 1)
        yield (window.at, got) if row else (at, None)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of the records of a member. A record whose length is wrong or missing ends at the member's end."""
    at = 0
    while content.startswith(b"WARC/", at):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {}
        for line in content[at:end].split(b"\r\n")[1:]:
            name, colon, value = line.partition(b":")
            if colon:
                headers.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
        length = headers.get("content-length", "")
        stop = end + 4 + int(length) if length.isdigit() else len(content)
        yield headers, content[end + 4 : stop]
        at = stop
        while content.startswith(b"\r\n", at):
            at += 2


def records_in(path: str, begin: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset of the member, headers, block) of each record whose member starts in begin <= offset < end."""
    fs, where = _fs(path)
    size = fs.get_file_info(where).size or 0
    with fs.open_input_file(where) as file:
        window = _Window(file, begin, size)
        for after, member in _members(window, end, begin == 0, lambda: _in_row(fs, where, size, window.at)):
            if member is not None:
                for headers, block in parse(member[0]):
                    yield after - member[1], headers, block


_OUT = "path string, offset long, type string, record_id string, uri string, date string, headers map<string,string>, block binary"
_SCHEMA = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for path, begin, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for offset, h, block in records_in(path, begin, end):
                uri = h.get("warc-target-uri")
                if uri is not None and h.get("x-target-uri-quoted") == "yes":
                    uri = unquote(uri)
                rows.append((path, offset, h.get("warc-type"), h.get("warc-record-id"), uri, h.get("warc-date"), list(h.items()), block))
                size += len(block)
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def read_files(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of the files in (path, size): path, offset, type, record_id, uri, date, headers, block. A file of null path, or without bytes, has none; a path that is listed twice is read twice."""
    cut = files.where("path is not null and size > 0").select("path", F.col("size").cast("long").alias("size"))
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long")))
    splits = cut.select("path", "size", begins.alias("begin")).select("path", "begin", F.least(F.col("begin") + split, F.col("size")).alias("end"))
    # a task a range, until there are too many: the number is given, as the few bytes of the list would be coalesced into one task
    tasks = max(1, min(MOST_TASKS, splits.count()))
    return splits.repartition(tasks, "path", "begin").mapInArrow(_reader, _OUT)


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The records of an archive file, or of all files *.warc.gz below a folder."""
    fs, where = _fs(path)
    info = fs.get_file_info(where)
    if info.type == pafs.FileType.Directory:
        prefix = path[: len(path) - len(where)] if path.endswith(where) and not path.startswith("/") else ""
        found = [(prefix + f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(where, recursive=True)) if f.is_file and f.path.endswith(".warc.gz")]
    else:
        found = [(path, info.size)] if info.is_file else []
    return read_files(spark.createDataFrame(found, "path string, size long"), split)


def encode_record(page_id: int | None, url: str | None, html: str | None, level: int = 6) -> bytes:
    """A page as a gzip member. A null html is a record of type metadata without a block; null ids and URLs leave out their headers."""
    body = b"" if html is None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html.encode()
    lines = ["WARC/1.1", f"WARC-Type: {'metadata' if html is None else 'response'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        plain = url == url.strip() and url.isprintable()
        lines += [f"WARC-Target-URI: {url if plain else quote(url, safe='')}"] + ([] if plain else ["X-Target-URI-Quoted: yes"])
    lines += ["WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _fs(folder)
        fs.create_dir(where, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"  # of this attempt alone: a lost or repeated task's file is listed nowhere
        size = records = 0
        with fs.open_output_stream(f"{where}/{name}", compression=None) as file:
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    member = encode_record(*row)
                    file.write(member)
                    size += len(member)
                    records += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "size", "records"])

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages as archives, one file a task, and returns the written list of (path, size, records). Other columns are left out."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string"))
    return materialise(rows.mapInArrow(_writer(folder.rstrip("/")), "path string, size long, records long"), "archives")


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, url, html, n_bytes) of response and metadata records: the page behind the HTTP header, decoded as UTF-8. n_bytes is the page's length in bytes; without a page both are null."""
    block, blank = F.col("block"), F.lit(b"\r\n\r\n")
    head = F.position(blank, block)
    body = F.when(F.col("type") == "response", F.when(head > 0, F.substring(block, head + 4, F.lit(2147483647))).otherwise(block))
    return records.where("type in ('response', 'metadata')").select(F.expr("try_cast(nullif(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)").alias("page_id"), F.col("uri").alias("url"), body.cast("string").alias("html"), F.octet_length(body).cast("long").alias("n_bytes"))


def round_trip(pages: DataFrame, split: int = SPLIT, **columns) -> DataFrame:
    """(page_id, url, html, n_bytes): pages written as archives to the shared folder and read back in ranges. Rows come back as often as they went; nulls stay null."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return pages_of(read_files(write(pages, folder, **columns), split))
