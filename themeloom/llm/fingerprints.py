"""Document fingerprints from improbable features.

Every window of ``WIDTH`` bytes has a Shannon entropy; its rank is how common
that entropy (in ``LEVELS`` steps) is among the windows of the whole corpus, and
rarer is better. Of every ``WIDTH`` successive windows the leftmost of lowest rank
gains a point, and windows with ``POINTS`` points or more are the document's
features. Each sets ``HASHES`` bits of a Bloom filter of ``FILTER_BITS``; after
``PER_FILTER`` features the next filter of the chain begins.

Two digests are compared filter by filter: of the digest with fewer filters, each
is held against all filters of the other, and the bits that both share, less what
chance would share, are set against the most that they could share. The mean of
each filter's best value is the similarity, from 0 to 100. Of two documents whose
digests have equally many, it is taken over the filters of the lower ``doc_id``.

``matches`` compares every document with every row of a benchmark, and with every
other document that shares any of its features; ``linked`` gives the same
comparison as one row for each document, with its class and number of links.

The corpus statistic is one histogram of entropies over all windows of all
texts. Where no window gains ``POINTS``, as in any text of fewer than ``2 * WIDTH``
bytes, the best window of the whole text is its only feature; a text shorter than
a window has none. A text with fewer than ``LEAST`` features also sets the bits of
the whole text, so that such digests are equal only if the texts are, and it is
compared only with others of that kind; ``fingerprint`` and ``matches`` search
such reference texts in the documents byte by byte. Nulls and empty texts have an
empty digest and are compared with nothing. Very long texts are read whole and only lengthen the chain. Ties in rank
go to the leftmost window; repeated rows get equal digests. An empty table has an
empty histogram. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .simhash import components, connected
from .store import stored
from .text import mix, prefix_hash, slices, span_hash, whole

WIDTH, POINTS, LEVELS = 64, 16, 1000
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
FILTER_BYTES = FILTER_BITS // 8
#: Texts with fewer features are compared as whole texts.
LEAST = 8
#: Least similarity that ``matches`` reports.
ALIKE = 21.0
#: Documents of a meeting, or of each side of one, about; and pairs that are compared at once.
MEETING, BLOCK = 4096, 1 << 16
#: Share of a filter's possible overlap beyond chance that counts for nothing.
FLOOR = 0.3
_X = np.arange(WIDTH + 1, dtype=float)
_XLOG = _X * np.log2(np.maximum(_X, 1))
_GAIN = np.append(_XLOG[1:] - _XLOG[:-1], 0.0)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The level of every window of the bytes, by position of its first byte."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    # equal bytes among the WIDTH - 1 after and the WIDTH - 1 before each byte
    after, before = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    step = 1 << 17
    for i in range(0, len(data), step):
        stop = min(len(data), i + step)
        for d in range(1, WIDTH):
            last = min(stop, len(data) - d)
            if last > i:
                same = (data[i:last] == data[i + d : last + d]).view(np.uint8)
                after[i:last] += same
                before[i + d : last + d] += same
    first = np.bincount(data[:WIDTH], minlength=256)
    # moving on by a byte removes one of after + 1 equal bytes and adds one to before of them
    total = np.empty(n)
    total[0] = _XLOG[first].sum()
    if n > 1:
        total[1:] = total[0] + np.cumsum(_GAIN[before[WIDTH:]] - _GAIN[after[: n - 1]])
    entropy = np.log2(WIDTH) - total / WIDTH
    return np.clip(np.rint(entropy / np.log2(WIDTH) * LEVELS), 0, LEVELS).astype(np.int32)


def _windows(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: the level at every byte, where a window within one document begins, and each document's number of windows."""
    level = np.zeros(len(part.data), dtype=np.int32)
    got = entropy_levels(part.data)
    level[: len(got)] = got
    count = np.maximum(part.end - part.start - WIDTH + 1, 0)
    edge = np.zeros(len(part.data) + 1, dtype=np.int32)
    np.add.at(edge, part.start[count > 0], 1)
    np.add.at(edge, (part.start + count)[count > 0], -1)
    return level, np.cumsum(edge[:-1]) > 0, count


def histogram(docs: DataFrame) -> np.ndarray:
    """How many windows of the corpus have each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, dtype=np.int64)
        for batch in batches:
            for part in slices(batch.column(0), lower=False):
                level, inside, _ = _windows(part)
                total += np.bincount(level[inside], minlength=LEVELS + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["level", "n"])

    out = np.zeros(LEVELS + 1, dtype=np.int64)
    for row in docs.select("text").mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[row.level] = row.n
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """A level's place in the order of how common levels are, rarest first; ties go to the lower level."""
    rank = np.empty(len(counts), dtype=np.uint64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    return rank


def features(part, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a slice's features, in order, and each one's document."""
    level, inside, count = _windows(part)
    has = np.flatnonzero(count >= WIDTH)  # fewer windows make no neighbourhood
    if not len(has):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(level)
    # rank and position in one number, so that the least is the leftmost of lowest rank
    low = rank[level] << np.uint64(40) | np.arange(n, dtype=np.uint64)
    low[~inside] = np.uint64((1 << 64) - 1)
    span = 1
    while span < WIDTH:
        low[: n - span] = np.minimum(low[: n - span], low[span:])
        span *= 2
    # neighbourhoods that lie within one document
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, part.start[has], 1)
    np.add.at(edge, (part.start + count)[has] - WIDTH + 1, -1)
    winner = (low[np.cumsum(edge[:-1]) > 0] & np.uint64((1 << 40) - 1)).astype(np.int64)
    at, points = np.unique(winner, return_counts=True)
    at = at[points >= POINTS]
    return at, np.searchsorted(part.start, at, "right") - 1


def _features_or_best(part, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``features``, and for each document that has windows but no features its leftmost window of lowest rank."""
    at, doc = features(part, rank)
    bare = np.flatnonzero((part.end - part.start >= WIDTH) & (np.bincount(doc, minlength=len(part)) == 0))
    if not len(bare):
        return at, doc
    best = [part.start[i] + int(np.argmin(rank[entropy_levels(part.data[part.start[i] : part.end[i]])])) for i in bare]
    at, doc = np.append(at, best).astype(np.int64), np.append(doc, bare)
    order = np.argsort(at)
    return at[order], doc[order]


def _digested(column: pa.Array, rank: np.ndarray) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Of each text: its number of features, its filters side by side, and the hashes of its features."""
    for part in slices(column, lower=False):
        at, doc = _features_or_best(part, rank)
        count = np.bincount(doc, minlength=len(part))
        few = np.flatnonzero((count < LEAST) & (part.end > part.start))
        filters = -(-count // PER_FILTER)
        filters[few] = 1
        begin = np.append(0, np.cumsum(filters))
        first = np.append(0, np.cumsum(count))
        nth = np.arange(len(at)) - first[doc]
        prefix = prefix_hash(part.data)
        value = span_hash(prefix, at, at + WIDTH)
        whole = mix(span_hash(prefix, part.start[few], part.end[few]))  # other bits than the same bytes as a feature
        bits = np.zeros(begin[-1] * FILTER_BITS, dtype=bool)
        for k in range(HASHES):
            for owner, what in ((begin[doc] + nth // PER_FILTER, value), (begin[few], whole)):
                spread = mix(what + np.uint64((k + 1) << 32)) % np.uint64(FILTER_BITS)
                bits[owner * FILTER_BITS + spread.astype(np.int64)] = True
        packed = np.packbits(bits).tobytes()
        for i in range(len(part)):
            yield int(count[i]), packed[begin[i] * FILTER_BYTES : begin[i + 1] * FILTER_BYTES], value[first[i] : first[i + 1]]


def digests(column: pa.Array, rank: np.ndarray) -> list[tuple[int, bytes]]:
    """Of each text: its number of features, and its filters side by side."""
    return [(n, filters) for n, filters, _ in _digested(column, rank)]


def _filters(digest: bytes) -> np.ndarray:
    return np.frombuffer(digest, dtype=np.uint64).reshape(-1, FILTER_BYTES // 8)


def similarity(a: tuple[int, bytes], b: tuple[int, bytes]) -> float | None:
    """0 to 100 for two digests (features, filters); None if one is empty, or one is of few features and the other isn't. Texts shorter than a window are alike only if equal."""
    if (a[0] < LEAST) != (b[0] < LEAST) or not a[1] or not b[1]:
        return None
    if min(a[0], b[0]) == 0:
        return 100.0 if a == b else 0.0
    x, y = sorted((_filters(a[1]), _filters(b[1])), key=len)
    nx, ny = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    best = np.empty(len(x))
    for i in range(len(x)):
        shared = np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
        most = np.minimum(nx[i], ny)
        chance = nx[i] * ny / FILTER_BITS
        cut = chance + FLOOR * (most - chance)
        best[i] = np.max(np.clip((shared - cut) / np.maximum(most - cut, 1e-9), 0, 1))
    return float(100 * best.mean())


def _scores(reference: list[tuple[int, bytes]], used: list[int]):
    """A function that gives a digest's similarity with each of the ``used`` references, as ``similarity`` would one by one."""
    chains = [_filters(reference[i][1]) for i in used]
    every = np.concatenate(chains) if chains else np.zeros((0, FILTER_BYTES // 8), np.uint64)
    owner_first = np.cumsum([0, *map(len, chains)])[:-1]
    sizes = np.array([len(c) for c in chains])
    ones = np.bitwise_count(every).sum(axis=1, dtype=np.int64)

    def score(digest: tuple[int, bytes]) -> np.ndarray:
        if not len(every):
            return np.zeros(0)
        x = _filters(digest[1])
        nx = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        value = np.empty((len(x), len(every)))
        for i in range(len(x)):
            shared = np.bitwise_count(x[i] & every).sum(axis=1, dtype=np.int64)
            most = np.minimum(nx[i], ones)
            chance = nx[i] * ones / FILTER_BITS
            cut = chance + FLOOR * (most - chance)
            value[i] = np.clip((shared - cut) / np.maximum(most - cut, 1e-9), 0, 1)
        # the shorter chain is averaged; equally long ones are averaged over the reference's side only if it comes first in order
        by_reference = np.add.reduceat(value.max(axis=0), owner_first) / sizes
        by_digest = np.maximum.reduceat(value, owner_first, axis=1).mean(axis=0)
        return 100 * np.where(sizes < len(x), by_reference, by_digest)

    return score


def _each(reference: list[tuple[int, bytes]]):
    """A function that gives a digest's similarity with every reference, 0 where there is none."""
    kinds = [[i for i, r in enumerate(reference) if r[0] and (r[0] < LEAST) == few] for few in (False, True)]
    scores = [_scores(reference, used) for used in kinds]

    def each(digest: tuple[int, bytes]) -> np.ndarray:
        out = np.zeros(len(reference))
        if digest[1] and digest[0]:
            out[kinds[digest[0] < LEAST]] = scores[digest[0] < LEAST](digest)
        elif digest[1]:
            out[[i for i, r in enumerate(reference) if r == digest]] = 100
        return out

    return each


def _many(reference: list[tuple[int, bytes]]):
    """A function that gives a digest's best similarity and the number of that reference (-1 if there is none), as ``similarity`` would one by one."""
    each = _each(reference)

    def best(digest: tuple[int, bytes]) -> tuple[int, float]:
        score = each(digest)
        at = int(np.argmax(score)) if len(score) else 0
        return (at, float(score[at])) if len(score) and score[at] > 0 else (-1, 0.0)

    return best


def _within(texts: list[bytes]):
    """A function that gives the texts of a column which hold one of ``texts`` byte by byte: pairs of a row and a number of the list."""
    size = min(map(len, texts), default=0)
    heads: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        data = np.frombuffer(t[:size], np.uint8)
        heads.setdefault(int(span_hash(prefix_hash(data), np.array([0]), np.array([size]))[0]), []).append(k)
    known = np.zeros(1 << 16, dtype=bool)
    known[[h & 0xFFFF for h in heads]] = True

    def within(column: pa.Array) -> set[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        for part in slices(column, lower=False) if texts else ():
            begin = np.arange(max(len(part.data) - size + 1, 0))
            value = span_hash(prefix_hash(part.data), begin, begin + size)
            for at in np.flatnonzero(known[(value & np.uint64(0xFFFF)).astype(np.int64)]):
                if found := heads.get(int(value[at])):
                    doc = int(np.searchsorted(part.start, at, "right")) - 1
                    out.update((part.first + doc, k) for k in found if part.data[at : min(at + len(texts[k]), part.end[doc])].tobytes() == texts[k])
        return out

    return within


def _reference(reference: DataFrame | None, rank: np.ndarray):
    """The items of a reference, and a function that gives for each text of a column its digest, its features and its similarity with every item."""
    items = reference.select(whole("item_id"), "text").where("item_id is not null").orderBy("item_id", "text").collect() if reference is not None else []
    known = digests(pa.array([r.text for r in items], pa.string()), rank) if items else []
    few = [i for i, d in enumerate(known) if d[1] and d[0] < LEAST]
    short = [items[i].text.encode() for i in few]

    def open_task():
        each, within = _each(known), _within(short)

        def compare(column: pa.Array) -> list[tuple[int, bytes, np.ndarray, np.ndarray]]:
            rows = [(n, filters, hashes, each((n, filters))) for n, filters, hashes in _digested(column, rank)]
            for row, k in within(column):
                rows[row][3][few[k]] = 100
            return rows

        return compare

    return [r.item_id for r in items], open_task


def fingerprint(docs: DataFrame, counts: np.ndarray, reference: DataFrame | None = None) -> DataFrame:
    """``doc_id, features, digest`` of every document, and ``nearest, similarity``: the row of ``reference`` (item_id, text) that it overlaps most, null if none.

    The reference is a benchmark or another fixed set that every document is compared
    with; its digests go to every task, 256 bytes for each 160 features.
    """
    item_ids, open_task = _reference(reference, ranks(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = open_task()
        for batch in batches:
            found = compare(batch.column(1))
            best = [int(np.argmax(s)) if s.any() else -1 for *_, s in found]
            item = pa.array([item_ids[i] if i >= 0 else None for i in best], pa.int64())
            value = pa.array([float(r[3][i]) if i >= 0 else None for i, r in zip(best, found, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.binary()), item, value], ["doc_id", "features", "digest", "nearest", "similarity"])

    return docs.select(whole("doc_id"), "text").mapInArrow(run, "doc_id long, features int, digest binary, nearest long, similarity double")


def _common(lists: pa.ListArray, order: np.ndarray):
    """A function that says which of the places from ``first`` on in this order of the lists have a value in common with the one at place ``k``."""
    values, at, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    owner = np.repeat(place, lists.value_lengths().to_numpy())
    # a column of bits for each list, one for each value that several have
    number = np.cumsum(count > 1) - 1
    owner, at = owner[count[at] > 1], number[at[count[at] > 1]]
    bits = np.zeros((len(values) and int(number[-1]) // 64 + 1, len(order)), dtype=np.uint64)
    np.bitwise_or.at(bits, (at >> 6, owner), np.uint64(1) << (at & 63).astype(np.uint64))

    def common(k: int, first: int) -> np.ndarray:
        used = np.flatnonzero(bits[:, k])
        return (bits[used, first:] & bits[used, k, None]).any(axis=0)

    return common


def _meeting_pairs(rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of one meeting that have a feature of it in common, and none of a meeting before it."""
    side, part = rows.column("side").to_numpy(), rows.column("part")[0].as_py()
    order = np.argsort(side, kind="stable")
    # of a meeting of two sides only pairs across them
    across = int((side == part["low"]).sum()) if part["low"] != part["high"] else None
    own, before = _common(rows.column("own"), order), _common(rows.column("before"), order)
    for k in range(len(side) if across is None else across):
        first = k + 1 if across is None else across
        j = order[first:][own(k, first) & ~before(k, first)]
        yield np.full(len(j), order[k]), j


def _similarities(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The similarity of each pair of positions."""
    n, size = rows.column("n").to_numpy(), rows.column("size").to_numpy()
    digest, probe = rows.column("digest"), rows.column("probe")
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    held = [digest[int(k)].as_py() for k in used]
    x, y = at[: len(i)], at[len(i) :]
    value = np.zeros(len(i))
    # a short text in a longer one: all its features, by their hashes
    mixed = (n[i] < LEAST) != (n[j] < LEAST)
    hashes: dict[int, frozenset] = {}
    for k in np.flatnonzero(mixed):
        few, many = (i[k], j[k]) if n[i[k]] < LEAST else (j[k], i[k])
        for r in (few, many):
            if r not in hashes:
                hashes[r] = frozenset(probe[int(r)].as_py())
        if len(hashes[few]) == size[few] and hashes[few] <= hashes[many]:
            value[k] = 100.0
    # one filter each, as most have, all at once
    single = np.array([len(h) == FILTER_BYTES for h in held], dtype=bool)
    filters = np.zeros((len(held), FILTER_BYTES // 8), dtype=np.uint64)
    filters[single] = _filters(b"".join(h for h in held if len(h) == FILTER_BYTES))
    ones = np.bitwise_count(filters).sum(axis=1, dtype=np.int64)
    one = single[x] & single[y] & ~mixed
    at = np.flatnonzero(one)
    for k in np.split(at, range(4096, len(at), 4096)):
        nu, nv, both = ones[x[k]], ones[y[k]], np.bitwise_count(filters[x[k]] & filters[y[k]]).sum(axis=1, dtype=np.int64)
        most = np.minimum(nu, nv)
        chance = nu * nv / FILTER_BITS
        cut = chance + FLOOR * (most - chance)
        value[k] = 100 * np.clip((both - cut) / np.maximum(most - cut, 1e-9), 0, 1)
    # of chains as long as each other, the lower document's filters are averaged
    ids = rows.column("doc_id").to_numpy()
    for k in np.flatnonzero(~one & ~mixed):
        first, second = sorted(((ids[i[k]], held[x[k]], int(n[i[k]])), (ids[j[k]], held[y[k]], int(n[j[k]]))))
        value[k] = similarity((first[2], first[1]), (second[2], second[1])) or 0.0
    return value


def _alike(rows: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of all alike pairs of whole meetings, with their similarities, in blocks."""

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        value = _similarities(rows, i, j)
        good = (value > 0) & (value >= least)
        return i[good], j[good], value[good]

    begin = _begins(rows)
    held, count = [], 0
    for first, stop in zip(begin, np.append(begin[1:], rows.num_rows), strict=True):
        if stop - first < 2:
            continue
        for i, j in _meeting_pairs(rows.slice(first, stop - first).combine_chunks().to_batches()[0]):
            held.append((i + first, j + first))
            count += len(i)
            if count >= BLOCK:
                yield block()
                held, count = [], 0
    if count:
        yield block()


def _begins(rows: pa.Table) -> np.ndarray:
    """Where each meeting begins, in rows sorted by meeting."""
    part = rows.column("part").combine_chunks()
    key = np.stack([rows.column("unit").to_numpy(), part.field("low").to_numpy(), part.field("high").to_numpy()])
    return np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))


def _whole_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, sorted by meeting, so that no meeting is split."""
    held = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = int(_begins(rows)[-1])
            if last:
                yield rows.slice(0, last).combine_chunks()
            held = rows.slice(last)
    if held is not None:
        yield held.combine_chunks()


def _pair_batches(least: float):
    """``a, b, similarity`` of all alike pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_meetings(batches):
            ids = rows.column("doc_id").to_numpy()
            for i, j, value in _alike(rows, least):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(value)], ["a", "b", "similarity"])

    return run


def _link_batches(least: float):
    """``a, b, links``: of each document its number of links and the least id that these connect it with; ``links`` is null for pairs, which are given where a ``doc_id`` has several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_meetings(batches):
            ids, at = np.unique(rows.column("doc_id").to_numpy(), return_inverse=True)
            several = rows.column("several").to_numpy()
            links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
            touched = np.zeros(len(ids), dtype=bool)
            for i, j, _ in _alike(rows, least):
                apart = at[i] != at[j]
                i, j = i[apart], j[apart]
                x, y, listed = at[i], at[j], several[i] | several[j]
                links += np.bincount(np.append(x[~listed], y[~listed]), minlength=len(ids))
                touched[x] = touched[y] = True
                # the forest so far and the block's pairs
                node = np.arange(len(ids))
                root = components(len(ids), np.append(node, x), np.append(root, y))
                if listed.any():
                    x, y = x[listed], y[listed]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[np.minimum(x, y)]), pa.array(ids[np.maximum(x, y)]), pa.nulls(len(x), pa.int64())], ["a", "b", "links"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(ids[root[touched]]), pa.array(links[touched])], ["a", "b", "links"])

    return run


def _compared(docs: DataFrame, counts: np.ndarray, reference: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables for ``matches`` and ``linked``: digests with their items, groups of equal digests, and meetings, sorted, of the groups' lowest ids."""
    item_ids, open_task = _reference(reference, ranks(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = open_task()
        for batch in batches:
            found = compare(batch.column(1))
            items = [[{"item_id": item_ids[i], "similarity": float(s[i])} for i in np.flatnonzero((s > 0) & (s >= least))] for *_, s in found]
            columns = [batch.column(0), pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.binary()), pa.array([np.unique(r[2]).view(np.int64) for r in found], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())])))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "hashes", "items"])

    rows = docs.select(whole("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, n int, digest binary, hashes array<long>, items array<struct<item_id: long, similarity: double>>")
    # a digest by its own hash and a row by its number, so that only narrow rows are grouped; the number is odd if the features are few
    key = F.when(F.length("digest") > 0, F.unhex(F.sha2("digest", 256))).otherwise(F.encode(F.concat(F.lit("none of "), "doc_id"), "utf-8"))
    rows = stored(rows.withColumns({"key": key, "row": F.monotonically_increasing_id() * 2 + (F.col("n") < LEAST).cast("long")}), "fingerprints")
    alike = Window.partitionBy("key", "n")
    groups = rows.select("doc_id", "key", "n", "row").repartition("key", "n").groupBy("doc_id", "key", "n").agg(F.min("row").alias("row"))
    groups = groups.select("row", "doc_id", F.min("doc_id").over(alike).alias("first"), (F.count("*").over(alike) - 1).alias("copies"))
    groups = stored(groups.withColumn("several", F.count("*").over(Window.partitionBy("doc_id")) > 1), "groups")

    # All documents that have any feature in common are compared. They meet at the lowest row that has the feature:
    # near copies have many features in common, and most of these have the same lowest row. A row goes to each of its
    # meetings once, so that no pair is ever a row of a table.
    owner = Window.partitionBy("hash")
    owned = rows.select("row", F.explode("hashes").alias("hash"))
    owned = owned.select("row", "hash", F.count("*").over(owner).alias("df"), F.min("row").over(owner).alias("unit"), F.max(F.col("row") % 2).over(owner).alias("few"))
    owned = owned.where("df > 1").select("row", "hash", "unit", "few").repartition("row").groupBy("row")
    # probe has what a text of few features may have in common with this one
    owned = owned.agg(F.collect_list(F.struct("hash", "unit")).alias("of"), F.collect_list(F.when(F.col("few") == 1, F.col("hash"))).alias("probe"))
    shared = owned.join(groups.where("doc_id = first").select("row", "several"), "row").join(rows.select("row", "doc_id", "n", F.size("hashes").alias("size"), "digest"), "row")
    shared = stored(shared.withColumn("units", F.array_distinct("of.unit")), "shared")
    # a large meeting is cut into sides, and each two of them meet
    large = shared.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.ceil(F.count("*") / MEETING).alias("sides")).where("sides > 1")
    place = {
        "own": F.transform(F.filter("of", lambda x: x["unit"] == F.col("unit")), lambda x: x["hash"]),
        "before": F.transform(F.filter("of", lambda x: x["unit"] < F.col("unit")), lambda x: x["hash"]),
        "side": F.coalesce(F.pmod(F.xxhash64("row"), "sides"), F.lit(0).cast("long")),
    }
    met = shared.withColumn("unit", F.explode("units")).join(F.broadcast(large), "unit", "left").withColumns(place)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("sides", F.lit(1).cast("long")) - 1)))
    met = met.withColumn("part", F.struct(F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high")))
    met = met.select("unit", "part", "side", "doc_id", "several", "n", "size", "digest", "own", "before", "probe")
    return rows, groups, met.repartition("unit", "part").sortWithinPartitions("unit", "part")


def matches(docs: DataFrame, counts: np.ndarray, reference: DataFrame, least: float = ALIKE) -> DataFrame:
    """``doc_id, kind, other_id, similarity`` of all pairs at least ``least`` alike; kind is ``item`` or ``document``.

    Every document is compared with every item. Documents of equal digests are given
    as pairs with the lowest id of their group, at 100, and a group's pairs with other
    groups as pairs of the lowest ids, lower first: digests that are equal have equal
    similarities. All documents that have any feature in common are compared, however
    common it is; without one, bits agree by chance only, and the documents aren't a
    pair. A text with fewer than ``LEAST`` features is at 100 with a
    longer one that has them all. Repeated rows count once; rows without ``doc_id``
    are left out.
    """
    rows, groups, met = _compared(docs, counts, reference, least)
    between = met.mapInArrow(_pair_batches(least), "a long, b long, similarity double")
    with_items = rows.select("doc_id", F.explode("items").alias("i")).select("doc_id", F.lit("item").alias("kind"), F.col("i.item_id").alias("other_id"), "i.similarity").distinct()
    copies = groups.where("doc_id > first").select("doc_id", F.lit("document").alias("kind"), F.col("first").alias("other_id"), F.lit(100.0).alias("similarity"))
    return with_items.unionByName(copies).unionByName(between.select(F.col("a").alias("doc_id"), F.lit("document").alias("kind"), F.col("b").alias("other_id"), "similarity"))


def linked(docs: DataFrame, counts: np.ndarray, reference: DataFrame, least: float = ALIKE) -> DataFrame:
    """``doc_id, features, class_id, copies, links, item_ids, similarities``: a row for each document, however many it resembles.

    The pairs are those of ``matches``. ``copies`` is how many other documents have an
    equal digest, ``links`` to how many different digests this one is alike, and
    ``class_id`` the lowest id of all that links and copies connect, a document's own
    if there are none. ``item_ids`` are the benchmark items that it overlaps, the most
    similar first, with their ``similarities``. A ``doc_id`` with several texts has a
    row for each, with the links of all of them if it is the lowest of their groups;
    repeated rows count once, and rows without ``doc_id`` are left out.
    """
    rows, groups, met = _compared(docs, counts, reference, least)
    met = stored(met.mapInArrow(_link_batches(least), "a long, b long, links long"), "links")
    # texts of one doc_id may be alike to the same document, which counts once
    listed = met.where("links is null").select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("first"), F.lit(1).cast("long").alias("links"))
    links = met.where("links is not null").select(F.col("a").alias("first"), "links").unionAll(listed).groupBy("first").agg(F.sum("links").alias("links"))
    roots = connected(met.where("links is not null").select("a", "b")).select(F.col("node").alias("first"), "root")
    items = F.array_sort("items", lambda x, y: F.when(x["similarity"] > y["similarity"], -1).when(x["similarity"] < y["similarity"], 1).otherwise(F.signum(x["item_id"] - y["item_id"]).cast("int")))
    out = rows.select("row", F.col("n").alias("features"), items.alias("items")).join(groups, "row")
    out = out.join(links, "first", "left").join(roots, "first", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "features", F.coalesce("root", "first").alias("class_id"), "copies", F.coalesce("links", none).alias("links"), F.col("items.item_id").alias("item_ids"), F.col("items.similarity").alias("similarities"))
