"""Bounded-space online packing of documents into windows of a fixed number of tokens.

Each partition keeps at most ``OPEN`` windows open. A document goes to the open
window that it fits best, that is with the least room left. If it fits none, a new
window is opened; if that would be one too many, the fullest is emitted first. A
window without room is emitted at once. A document longer than a window fills
windows of its own with its beginning, and its end is placed like a document.
When a partition ends, its open windows are leftovers: their pieces from all
partitions are merged, the longest first, each where it fits best.

What the partitions emit is written to the shared folder before the leftovers are
merged, so a lost executor repeats one partition and changes no window.

Tokens are those of ``mixing.token_estimate``, so token k of a text is its
characters 4k to 4k + 3. Null and empty texts have no tokens and lie in no
window. Very long texts are split, never cut off. Of equally full windows the
one opened first is chosen. Repeated rows are packed as often as they occur, a
null ``doc_id`` included. Other columns, whatever their names, are left alone;
an empty table gives no windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import CHARS_PER_TOKEN, token_estimate
from .store import stored
from .text import whole

WINDOW, OPEN = 2048, 32
#: Leftover windows that one merging task takes.
MERGED = 4096

Piece = tuple[int | None, int, int, str | None]  # doc_id, start, length, text


class Packer:
    """The open windows of one partition."""

    def __init__(self, window: int, most: int | None):
        self.window, self.most = window, most
        self.free: list[tuple[int, int]] = []  # room and number of each open window, in order
        self.pieces: dict[int, list[Piece]] = {}
        self.opened = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Places a piece no longer than a window; yields the windows that this emits."""
        length = piece[2]
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            if self.most is not None and len(self.free) >= self.most:
                yield self.pieces.pop(self.free.pop(0)[1])
            room, number = self.window, self.opened
            self.opened += 1
            self.pieces[number] = []
        self.pieces[number].append(piece)
        if room == length:
            yield self.pieces.pop(number)
        else:
            insort(self.free, (room - length, number))

    def document(self, doc: int | None, length: int, text: str | None) -> Iterator[list[Piece]]:
        start = 0
        while length - start > 0:
            n = min(self.window, length - start)
            piece = (doc, start, n, None if text is None else text[start * CHARS_PER_TOKEN : (start + n) * CHARS_PER_TOKEN])
            if n == self.window:
                yield [piece]
            else:
                yield from self.add(piece)
            start += n

    def rest(self) -> list[list[Piece]]:
        return list(self.pieces.values())


def _schema(texts: bool) -> pa.Schema:
    fields = [("window_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("tokens", pa.int32())]
    return pa.schema([*fields, *([("texts", pa.list_(pa.string()))] if texts else []), ("leftover", pa.bool_())])


_DDL = "window_id long, doc_ids array<long>, starts array<int>, lengths array<int>, tokens int"


class _Rows:
    """Gathers windows into batches, numbered by partition."""

    def __init__(self, texts: bool, first: int):
        self.texts, self.schema, self.number, self.rows, self.size = texts, _schema(texts), first + (TaskContext.get().partitionId() << 32), [], 0

    def put(self, window: list[Piece], leftover: bool) -> None:
        doc, start, length, text = map(list, zip(*window, strict=True))
        self.rows.append((self.number, doc, start, length, sum(length), *([text] if self.texts else []), leftover))
        self.number += 1
        self.size += sum(length)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def pack(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN, texts: bool = False) -> DataFrame:
    """``window_id, doc_ids, starts, lengths, tokens`` of every window, and ``texts`` if wanted; the arrays hold a place for each piece, starts and lengths in tokens."""
    rows = docs.select(whole("doc_id"), token_estimate(F.col("text")).alias("n"), *(["text"] if texts else [])).where("n > 0")

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = Packer(window, open_windows), _Rows(texts, 0)
        for batch in batches:
            text = batch.column(2) if texts else None
            for i, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for done in packer.document(doc, n, text[i].as_py() if texts else None):
                    out.put(done, False)
                if out.size > 2_000_000:
                    yield out.batch()
        for done in packer.rest():
            out.put(done, True)
        if out.rows:
            yield out.batch()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, out = Packer(window, None), _Rows(texts, 1 << 62)
        pieces: list[Piece] = []
        for batch in batches:
            for x in batch.to_pylist():
                pieces += zip(x["doc_ids"], x["starts"], x["lengths"], x["texts"] if texts else [None] * len(x["starts"]), strict=True)
        pieces.sort(key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1]))
        for piece in pieces:
            for done in packer.add(piece):
                out.put(done, False)
        for done in packer.rest():
            out.put(done, False)
        while out.rows:
            some, out.rows = out.rows[4096:], out.rows[:4096]
            yield out.batch()
            out.rows = some

    ddl = _DDL + (", texts array<string>" if texts else "") + ", leftover boolean"
    first = stored(rows.mapInArrow(online, ddl), "windows")
    left = first.where("leftover")
    tasks = -(-left.count() // MERGED)
    done = first.where("not leftover")
    if tasks:
        done = done.unionByName(left.repartition(tasks, "window_id").mapInArrow(merge, ddl))
    return done.drop("leftover")
