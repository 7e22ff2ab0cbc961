"""Vectorised text kernels over Arrow string columns.

Each kernel works on the UTF-8 bytes of a whole slice of documents at once, so
no Python code runs per word or per character. A *word* is a maximal run, in the
lower-cased text, of ASCII letters, digits, ``_`` and any non-ASCII characters
(the regular expression ``WORD`` says the same). Words never cross documents.
Null texts count as empty texts.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9_\u0080-\U0010ffff]+"
#: Bytes of text that a kernel takes at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers.get("p", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("p", _P), ("q", _P_INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["q"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of (data[k] + 1) * P**k over i <= k < j, modulo 2**64."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes in each span; it doesn't depend on where the span lies."""
    _, q = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * q[start] ^ (end - start).astype(np.uint64))


def whole(name: str) -> Column:
    """An id as a long; what isn't a whole number counts as null."""
    return F.col(name).try_cast("long").alias(name)


class Slice:
    """The bytes of some documents side by side: data, and each document's start and end."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: int):
        self.data, self.start, self.end, self.first = data, start, end, first

    def __len__(self) -> int:
        return len(self.start)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the first word of each document with the total at the end."""
        is_word = IS_WORD[self.data]
        begins, ends = is_word.copy(), is_word.copy()
        begins[1:] &= ~is_word[:-1]
        ends[:-1] &= ~is_word[1:]
        full = self.end > self.start
        begins[self.start[full]] = is_word[self.start[full]]
        ends[self.end[full] - 1] = is_word[self.end[full] - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(start, np.append(self.start, len(self.data)))


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous large_string array, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = True, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The documents of a column, in order, in slices of about ``size`` bytes."""
    column = string_array(column)
    if not len(column):
        return
    data, at = raw(pc.utf8_lower(column) if lower else column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield Slice(data[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i], i)
        i = j


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values[bounds[i]:bounds[i + 1]] for each i; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def disjoint(spans: Iterable[tuple]) -> list[tuple]:
    """Of spans ``start, end, ...`` in order of preference, those that overlap none before them; by place."""
    out: list[tuple] = []
    for x in spans:
        at = bisect_right(out, x[0], key=lambda y: y[0])
        if (not at or out[at - 1][1] <= x[0]) and (at == len(out) or x[1] <= out[at][0]):
            insort(out, x, key=lambda y: y[0])
    return out
