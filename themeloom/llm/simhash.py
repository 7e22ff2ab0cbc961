"""SimHash near-duplicates by multi-index hashing.

A fingerprint of ``BITS`` bits is cut into ``SEGMENTS`` segments. Every distinct
word of a document votes on every bit. Two documents are near-duplicates if
their fingerprints differ in at most ``max_distance`` bits, and every such pair is
compared: up to ``MAX_DISTANCE``, which is less than ``SEGMENTS * (RADIUS + 1)``, some
segment has at most ``RADIUS`` differing bits. A larger ``max_distance`` is an error.
Each document is a query as well as an entry of the tables.

A ball of that radius needs no row per probe in the shuffle. A segment has
``RADIUS + 1`` parts, of which one is equal; so a document goes to one place for each
part of each segment, and the ball over the other parts is enumerated there
against the rows that came to the same place.

Nulls, empty texts and texts without any word have no fingerprint and belong to
no group. Repeated rows and equal texts have equal fingerprints and so belong
together. Ties don't arise: a group is named by its least ``doc_id``. Other
columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .text import mix, prefix_hash, slices, span_hash, whole

WORDS, BITS = 5, 312
#: Bits that may differ.
MAX_DISTANCE = 44
#: Bits that may differ in a segment, which has one part more; so many segments that a pair can't exceed that in all of them.
RADIUS = 2
PARTS = RADIUS + 1
SEGMENTS = MAX_DISTANCE // PARTS + 1
#: Bits of a part at most, and of a place's number for the value of the part.
PART_BITS, HALF = 7, 12
_MASKS = np.zeros(WORDS * 64, dtype=np.uint8)
_MASKS[:BITS] = 1
#: Buckets with more pairs than this are searched breadth first.
DENSE_PAIRS = 20_000
BLOCK = 1 << 18


def fingerprints_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of packed bits for each document, and whether it has any word."""
    out = np.zeros((len(column), WORDS * 8), dtype=np.uint8)
    known = np.zeros(len(column), dtype=bool)
    for part in slices(column):
        start, end, bounds = part.words()
        if not len(start):
            continue
        words = span_hash(prefix_hash(part.data), start, end)
        doc = np.repeat(np.arange(len(part), dtype=np.uint64), np.diff(bounds))
        # distinct words of each document: 24 bits of document, 40 of hash
        key = (doc << np.uint64(40)) | (words >> np.uint64(24))
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        count = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=len(part))
        first = np.append(0, np.cumsum(count))
        has = np.flatnonzero(count)
        word = key & np.uint64((1 << 40) - 1)
        bits = np.stack([mix(word + np.uint64((k + 1) << 48)) for k in range(WORDS)], axis=1).view(np.uint8)
        # votes are added as bytes, eight to a machine word, 255 features at most at a time
        pieces = -(-count // 255)
        piece_of = np.append(0, np.cumsum(pieces))
        cut = np.repeat(first[:-1], pieces) + 255 * (np.arange(piece_of[-1]) - np.repeat(piece_of[:-1], pieces))
        votes = np.empty((len(cut), WORDS * 64), dtype=np.uint8)
        for i in range(0, len(cut), 512):
            at = cut[i : i + 512]
            stop = cut[i + 512] if i + 512 < len(cut) else len(key)
            spread = np.unpackbits(bits[at[0] : stop], axis=1).view(np.uint64)
            votes[i : i + 512] = np.add.reduceat(spread, at - at[0], axis=0).view(np.uint8)
        total = np.add.reduceat(votes, piece_of[:-1][has], axis=0, dtype=np.int32)
        out[part.first + has] = np.packbits((2 * total > count[has, None]) & (_MASKS == 1), axis=1)
        known[part.first + has] = True
    return out, known


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, known = fingerprints_of(batch.column(1))
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WORDS * 8), len(bits), [None, pa.py_buffer(bits)])
        rows = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), packed.cast(pa.binary())], ["doc_id", "fingerprint"])
        yield rows.filter(pa.array(known))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every document that has a word and an id."""
    return docs.select(whole("doc_id"), "text").where("doc_id is not null").mapInArrow(_fingerprint_batches, "doc_id long, fingerprint binary")


def _bits(column: pa.Array) -> np.ndarray:
    """The fingerprints as rows of uint64."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, WORDS) if len(column) else np.zeros((0, WORDS), np.uint64)


def segments_of(bits: np.ndarray) -> np.ndarray:
    """The value of each segment, a column each."""
    data = bits.view(np.uint8).reshape(len(bits), -1).astype(np.int64)
    out = np.empty((len(bits), SEGMENTS), dtype=np.int64)
    for s in range(SEGMENTS):
        first, last = s * BITS // SEGMENTS, (s + 1) * BITS // SEGMENTS
        at = first // 8
        four = data[:, at] << 24 | data[:, at + 1] << 16 | data[:, at + 2] << 8 | data[:, at + 3]
        out[:, s] = four >> (32 - first % 8 - (last - first)) & ((1 << (last - first)) - 1)
    return out


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = segments_of(_bits(batch.column(1)))
        for s in range(SEGMENTS):
            for part in range(PARTS):
                value = values[:, s] >> (PART_BITS * part) & ((1 << PART_BITS) - 1)
                place = ((PARTS * s + part) << HALF) + value
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), batch.column(0), batch.column(1)], ["place", "doc_id", "fingerprint"])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component in the graph with edges a-b."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label != (jump := label[label])).any():
            label = jump
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], ..., lo[i] + n[i] - 1 for each i, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _dense(bits: np.ndarray, left: np.ndarray, right: np.ndarray | None, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what the pairs within ``most`` connect, breadth first, without listing all pairs.

    left and right are rows; right None means pairs within left. A row is compared with
    rows only that nothing has reached yet, so a tight group of any size costs a few passes.
    """
    edges = []
    rows = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(rows), dtype=bool) if right is None else np.arange(len(rows)) >= len(left)
    todo = np.arange(len(rows))
    frontier: list[int] = []
    while len(todo) or frontier:
        if not frontier:
            frontier, todo = [int(todo[0])], todo[1:]
            continue
        at = frontier.pop()
        near = distance(bits[rows[todo]], bits[rows[at]]) <= most
        if right is not None:
            near &= side[todo] != side[at]
        if near.any():
            hit = todo[near]
            edges.append((np.full(len(hit), rows[at]), rows[hit]))
            frontier.extend(hit.tolist())
            todo = todo[~near]
    return edges


def near_pairs(place: np.ndarray, bits: np.ndarray, most: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges between rows that came to the same place: a spanning forest of all near pairs there."""
    segment, part = np.divmod(place.astype(np.int64) >> HALF, PARTS)
    value = segments_of(bits)[np.arange(len(bits)), segment]
    low = PART_BITS * part
    other = value & ((1 << low) - 1) | value >> (low + PART_BITS) << low
    room = PART_BITS * RADIUS
    key = place.astype(np.int64) << room | other
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(ordered)))
    bucket = ordered[begin]
    first_part = (bucket >> (room + HALF)) % PARTS == 0
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def check(i: np.ndarray, j: np.ndarray) -> None:
        good = distance(bits[i], bits[j]) <= most
        edges.append((i[good], j[good]))

    def cross(x: np.ndarray, y: np.ndarray, within: bool) -> None:
        """Pairs of bucket x[k] with bucket y[k], in blocks."""
        pairs = size[x] * size[y]
        dense = pairs > DENSE_PAIRS
        for k in np.flatnonzero(dense):
            left, right = order[begin[x[k]] : begin[x[k]] + size[x[k]]], order[begin[y[k]] : begin[y[k]] + size[y[k]]]
            edges.extend(_dense(bits, left, None if within else right, most))
        x, y, pairs = x[~dense], y[~dense], pairs[~dense]
        block = np.cumsum(pairs) // BLOCK
        for part in np.split(np.arange(len(x)), np.flatnonzero(np.diff(block)) + 1):
            if len(part):
                k = np.repeat(part, pairs[part])
                step = _ranges(np.zeros(len(part), np.int64), pairs[part])
                i, j = np.divmod(step, size[y[k]])
                i, j = begin[x[k]] + i, begin[y[k]] + j
                if within:
                    i, j = i[i < j], j[i < j]
                check(order[i], order[j])

    # the ball's centre counts at the first part only, else each such pair would come once for each part
    same = np.flatnonzero(first_part & (size > 1))
    cross(same, same, True)
    for n in range(1, RADIUS + 1):
        for flipped in combinations(range(room), n):
            low = np.flatnonzero(bucket & (1 << flipped[-1]) == 0)  # each two buckets once
            wanted = bucket[low] ^ sum(1 << bit for bit in flipped)
            at = np.searchsorted(bucket, wanted)
            found = bucket[np.minimum(at, len(bucket) - 1)] == wanted if len(bucket) else np.zeros(0, bool)
            cross(low[found], at[found], False)
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])


def _edge_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(places: list, ids: list, prints: list) -> pa.RecordBatch:
            doc, bits = np.concatenate(ids), np.concatenate(prints)
            a, b = near_pairs(np.concatenate(places), bits, most)
            used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
            # in order of id, so that the least id of a component is its least node
            used_ids, at = np.unique(doc[used], return_inverse=True)
            node = at[where]
            root = components(len(used_ids), node[: len(a)], node[len(a) :])
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(used_ids[moved]), pa.array(used_ids[root[moved]])], ["a", "b"])

        places: list = []
        ids: list = []
        prints: list = []
        held = 0
        for batch in batches:  # sorted by place; a place is never split
            if not batch.num_rows:
                continue
            place, doc, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _bits(batch.column(2))
            if held + len(place) > 100_000:
                cut = int(np.searchsorted(place, place[-1]))
                if cut or (places and places[-1][-1] != place[0]):
                    if cut:
                        places, ids, prints = [*places, place[:cut]], [*ids, doc[:cut]], [*prints, bits[:cut]]
                    yield out(places, ids, prints)
                    places, ids, prints, held = [], [], [], 0
                    place, doc, bits = place[cut:], doc[cut:], bits[cut:]
            places.append(place)
            ids.append(doc)
            prints.append(bits)
            held += len(place)
        if places:
            yield out(places, ids, prints)

    return run


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is the component's least node.

    Alternates the large-star and small-star steps until nothing changes; each
    round is a table in the shared folder.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = stored(small, "small")
        # stars are the only graphs that neither step changes
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = small


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, group_id, stays`` for every document that has a near-duplicate.

    ``group_id`` is the least ``doc_id`` of the group, and ``stays`` marks that
    document. Groups are connected: members may be further apart than
    ``max_distance`` if others lie between. A repeated ``doc_id`` counts once for
    each distinct fingerprint that it has.
    """
    return _members(stored(fingerprints(docs), "fingerprints"), max_distance)


def _members(prints: DataFrame, max_distance: int) -> DataFrame:
    if max_distance > MAX_DISTANCE:
        raise ValueError(f"max_distance is {MAX_DISTANCE} at most")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "fingerprint", "copies"), "distinct")
    places = distinct.select("doc_id", "fingerprint").mapInArrow(_place_batches, "place int, doc_id long, fingerprint binary")
    edges = places.repartition("place").sortWithinPartitions("place").mapInArrow(_edge_batches(max_distance), "a long, b long")
    # a doc_id with several fingerprints joins what each of them belongs to
    same = prints.join(distinct.where("copies > 1").select("fingerprint", F.col("doc_id").alias("b")), "fingerprint").select(F.col("doc_id").alias("a"), "b")
    roots = connected(edges.union(same))
    members = roots.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))
    return members.union(members.select("group_id", "group_id").distinct()).withColumn("stays", F.col("doc_id") == F.col("group_id"))


def deduplicated(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The documents without those whose group has a lesser ``doc_id``; same columns.

    Repeated rows with one ``doc_id`` and one text become one row. Rows without
    ``doc_id``, and rows whose text has no word, all stay.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    gone = _members(prints, max_distance).where("not stays").select(F.col("doc_id").alias("__gone"))
    kept = docs.join(gone, whole("doc_id") == F.col("__gone"), "left_anti")
    again = stored(prints.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "again")
    if again.isEmpty():
        return kept
    repeated = whole("doc_id") == F.col("__again")
    return kept.join(again, repeated, "left_anti").unionByName(kept.join(again, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
