"""WARC: a sequential reader and a writer, one gzip member for each record.

The reader goes through a file once, in chunks. Members are inflated as they come
with incremental zlib; a record's head, of any length, ends at the first empty line and its
block is framed by Content-Length, whether or not the record and its member end
together. Blocks are digested while they stream and compared with
WARC-Block-Digest (sha1 in base 32 or hex, sha256, md5). Files that aren't
compressed are read the same way.

Every record gives a row with its place and a ``status``: ``ok``;
``digest_mismatch``; ``no_digest``; ``truncated`` if the file or member ends
within the record; ``bad_framing`` if the block isn't followed by two line ends;
``bad_header`` if the head can't be read; ``bad_gzip`` if the member can't be
inflated. After damage the reader goes on at the next member that begins a record.

A file is one task, as it must be for a sequential format; the writer starts a
new file after ``FILE_BYTES``. It writes under a temporary name and renames, and
a partition's files are named by its number, so repeated attempts leave the same
files. Null values: a null url leaves out WARC-Target-URI, a null id leaves out
the page number, and a null html is a record of an empty block marked as null.
Line ends within a url become spaces, and spaces around it are lost.
Empty and very long pages, repeated rows and ties need nothing special; an empty
table writes no file and reads as no row. Other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh
from .text import whole

CHUNK, FILE_BYTES = 1 << 18, 1 << 30
SCHEMA = "file string, offset long, record_id string, type string, date string, target_uri string, content_type string, headers map<string,string>, block binary, status string"
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("status", pa.string())])
_HASHES = {"sha1": 20, "sha256": 32, "md5": 16}


@dataclass
class Record:
    offset: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    status: str = "ok"


class _Stream:
    """The inflated bytes of a file, with the place of each member. Buffers what was read ahead."""

    def __init__(self, raw):
        self.raw, self.left, self.at, self.ready = raw, b"", 0, b""
        self.member = 0  # file offset of the member, or record, that the ready bytes belong to
        self.inflate = None
        self.plain: bool | None = None
        self.error = self.skipped = False

    def _fill(self) -> bool:
        """More raw bytes in left; False at the end of the file."""
        if not self.left:
            self.left = self.raw.read(CHUNK)
        return bool(self.left)

    def more(self) -> bool:
        """Inflates another piece of the current member; False if the member is over."""
        while True:
            if self.plain:
                if not self._fill():
                    return False
                self.ready, self.at, self.left = self.ready + self.left, self.at + len(self.left), b""
                return True
            if self.inflate is None or not self._fill():
                if self.inflate is not None:
                    self.inflate, self.error = None, True  # the file ends within a member
                return False
            try:
                out = self.inflate.decompress(self.left, CHUNK * 4)
            except zlib.error:
                # the search for the next member must not find this one again
                self.inflate, self.error = None, True
                self.left, self.at = self.left[1:], self.at + 1
                return False
            rest = self.inflate.unconsumed_tail or self.inflate.unused_data
            self.at += len(self.left) - len(rest)
            self.left = rest
            if self.inflate.eof:
                self.inflate = None
            if out:
                self.ready += out
                return True

    def begin(self) -> bool:
        """Goes to the next member; False at the end of the file."""
        self.ready, self.error, self.skipped = b"", False, False
        while self._fill():
            if self.plain is None:
                while len(self.left) < 2 and (more := self.raw.read(CHUNK)):
                    self.left += more
                self.plain = self.left[:2] != b"\x1f\x8b"
            if self.plain:
                self.member = self.at
                return True
            while len(self.left) < 3 and (more := self.raw.read(CHUNK)):
                self.left += more
            if self.left[:3] == b"\x1f\x8b\x08":
                self.inflate, self.member = zlib.decompressobj(wbits=31), self.at
                return True
            # damage: on to what may be the next member, keeping two bytes that might begin its mark
            found = self.left.find(b"\x1f\x8b\x08", 1)
            self.skipped = True
            step = found if found > 0 else max(1, len(self.left) - 2)
            self.left, self.at = self.left[step:], self.at + step
        return False


def digest_status(headers: dict[str, str], digests: dict[str, bytes]) -> str:
    name, _, value = headers.get("warc-block-digest", "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in digests:
        return "no_digest"
    value = value.strip()
    try:
        want = bytes.fromhex(value) if len(value) == 2 * _HASHES[name] else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return "digest_mismatch"
    return "ok" if want == digests[name] else "digest_mismatch"


def _head(text: bytes) -> dict[str, str] | None:
    lines = re.split(r"\r?\n", text.decode("utf-8", "replace"))
    if not re.fullmatch(r"WARC/\d+\.\d+", lines[0].strip()):
        return None
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
        elif line:
            return None
    return out


_EMPTY_LINE = re.compile(rb"\r?\n\r?\n")


def _may_begin(data: bytes) -> bool:
    """Whether bytes may be those of a record's head, however long it gets; what doesn't begin as one isn't read on to its first empty line."""
    mark = data[:64].lstrip()[:5]
    return b"WARC/".startswith(mark)


def records(raw) -> Iterator[Record]:
    """The records of an open file, from first to last."""
    s = _Stream(raw)
    while s.ready or s.begin():
        offset = s.member if not s.plain else s.at - len(s.ready)
        # head
        end, seen = _EMPTY_LINE.search(s.ready), 0
        while not end and _may_begin(s.ready):
            seen = max(0, len(s.ready) - 3)  # where an empty line may have begun
            if not s.more():
                break
            end = _EMPTY_LINE.search(s.ready, seen)
        if not s.ready.strip() and (not s.error or s.skipped):
            s.ready = b""  # nothing there, or damage that only looked like a member
            continue
        headers = _head(s.ready[: end.start()]) if end else None
        length = (headers or {}).get("content-length", "")
        if headers is None or not length.isdecimal():
            yield Record(offset, headers or {}, b"", "bad_gzip" if s.error else "bad_header")
            # a plain file goes on at the next line that begins a record
            if s.plain:
                while (k := s.ready.find(b"\nWARC/", 1)) < 0:
                    s.ready = s.ready[-6:]
                    if not s.more():
                        break
                s.ready = s.ready[k + 1 :] if k >= 0 else b""
            else:
                while s.more():
                    s.ready = b""
                s.ready = b""
            continue
        # block
        need, pieces = int(length), []
        hashes = {n: hashlib.new(n) for n in _HASHES if headers.get("warc-block-digest", "").lower().replace("-", "").startswith(n + ":")}
        s.ready = s.ready[end.end() :]
        while True:
            piece, s.ready = s.ready[:need], s.ready[need:]
            need -= len(piece)
            pieces.append(piece)
            for h in hashes.values():
                h.update(piece)
            if not need or not s.more():
                break
        block = b"".join(pieces)
        if need:
            yield Record(offset, headers, block, "bad_gzip" if s.error and s.left else "truncated")
            continue
        while len(s.ready) < 4 and s.more():
            pass
        close = re.match(rb"\r\n\r\n|\n\n", s.ready)
        status = digest_status(headers, {n: h.digest() for n, h in hashes.items()}) if close else "bad_framing"
        s.ready = s.ready[close.end() if close else 0 :]
        if not close and s.plain:
            k = s.ready.find(b"WARC/")
            s.ready = s.ready[k:] if k >= 0 else b""
        elif not close:
            while s.more():
                s.ready = b""
            s.ready = b""
        elif not s.plain and not s.ready:
            s.more()  # another record within the member, or its end with the checksum
        yield Record(offset, headers, block, "bad_gzip" if s.error and not s.ready else status)


def member(headers: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member; Content-Length and the block's digest are added."""
    headers = headers | {"WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in headers.items())
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"[a-zA-Z][\w+.-]*:", uri) else f"file://{uri}")


def write_pages(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> int:
    """Writes ``page_id, url, html`` as resource records to ``.warc.gz`` files in a folder; gives the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(folder)
        where.create_dir(base, recursive=True)
        task = TaskContext.get()
        out, name, temporary, size, part, count = None, "", "", 0, 0, 0

        def close() -> None:
            out.close()
            where.move(temporary, name)

        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{base}/part-{task.partitionId():06d}-{part:04d}.warc.gz"
                    temporary = f"{base}/.{task.taskAttemptId()}-{part:04d}.tmp"
                    out, size, part = where.open_output_stream(temporary, compression=None), 0, part + 1
                headers = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Date": date, "Content-Type": "text/html; charset=utf-8"}
                if url is not None:
                    headers["WARC-Target-URI"] = url
                if html is None:
                    headers["X-Null-Block"] = "1"
                data = member(headers, (html or "").encode())
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    rows = pages.select(whole("page_id"), "url", "html").mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first()
    return rows.n or 0


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the WARC files of a folder, see ``SCHEMA``; a task reads whole files, from first to last."""
    where, base = _filesystem(folder)
    info = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    files = sorted(((i.path, i.size) for i in info if i.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path)), key=lambda x: (-x[1], x[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, _ = _filesystem(folder)
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows, size = [], 0
            return out

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with inner.open_input_stream(path, compression=None) as raw:
                    for r in records(raw):
                        h = r.headers
                        rows.append((path, r.offset, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-date"), h.get("warc-target-uri"), h.get("content-type"), list(h.items()), r.block, r.status))
                        size += len(r.block)
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield flush()
        if rows:
            yield flush()

    # largest files first, a task each
    listed = spark.createDataFrame([(p, i) for i, (p, _) in enumerate(files)], "path string, i int")
    return listed.repartitionByRange(max(1, len(files)), "i").select("path").mapInArrow(run, SCHEMA)


def pages_of(found: DataFrame) -> DataFrame:
    """``page_id, url, html, status`` of records that ``write_pages`` wrote."""
    return found.where("type = 'resource'").select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]*)>$', 1) AS bigint)").alias("page_id"),
        F.col("target_uri").alias("url"),
        F.when(F.col("headers")["x-null-block"].isNull(), F.make_valid_utf8(F.col("block").cast("string"))).alias("html"),
        "status",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages, written as WARC files to the shared folder and read back."""
    folder = fresh(pages.sparkSession, "warc")
    write_pages(pages, folder)
    return pages_of(read(pages.sparkSession, folder))
