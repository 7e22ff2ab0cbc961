import random
import re

import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import simhash
from themeloom.llm.text import WORD, slices

SF = "/root/testdata/sf0.01"


def brute_groups(ids, texts, most):
    bits, known = simhash.fingerprints_of(pa.array(texts, pa.string()))
    rows = [i for i in range(len(ids)) if known[i]]
    word = bits.view(np.uint64)
    parent = {ids[i]: ids[i] for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(rows):
        near = simhash.distance(word[rows[n + 1 :]], word[i]) <= most
        for j in np.array(rows[n + 1 :])[near]:
            a, b = find(ids[i]), find(ids[j])
            parent[max(a, b)] = min(a, b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return {k: v for k, v in groups.items() if len(v) > 1}


def found(df):
    groups = {}
    for r in df.collect():
        assert r.stays == (r.doc_id == r.group_id)
        groups.setdefault(r.group_id, set()).add(r.doc_id)
    return groups


def test_words_are_those_of_the_expression():
    texts = ["It's 3 o'clock", None, "", "Ünïcode—Straße, x_1", "a", " b c\n"]
    got = []
    for part in slices(pa.array(texts)):
        start, end, bounds = part.words()
        for i in range(len(part)):
            got.append([bytes(part.data[start[k] : end[k]]).decode() for k in range(bounds[i], bounds[i + 1])])
    assert got == [re.findall(WORD, (t or "").lower()) for t in texts]


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute_groups([r.doc_id for r in rows], [r.text for r in rows], simhash.MAX_DISTANCE)
    got = found(simhash.near_duplicates(docs))
    joined = lambda g: {(x, k) for k, v in g.items() for x in v}
    assert joined(got) <= joined(want)
    assert len(joined(got)) >= 0.95 * len(joined(want)) > 0


def test_planted_copies(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    base = [rng.choices(vocabulary, k=rng.randint(60, 400)) for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, words in enumerate(base[:60]):
        copy = list(words)
        for k in rng.sample(range(len(copy)), max(1, len(copy) // 40)):
            copy[k] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(copy)))
    got = found(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(got.get(i) == {i, 1000 + i} for i in range(60)) >= 58
    assert not {x for v in got.values() for x in v} & set(range(60, 150))


def test_dense_buckets_give_the_same_components(monkeypatch):
    rng = np.random.default_rng(0)
    bits = np.repeat(rng.integers(0, 1 << 62, (4, simhash.WORDS)).astype(np.uint64), 60, axis=0)
    bits ^= (np.uint64(1) << rng.integers(0, 60, (240, 1)).astype(np.uint64)) * (rng.random((240, simhash.WORDS)) < 0.3)
    place = (simhash.segments_of(bits)[:, 2] >> simhash.HALF) + (4 << simhash.HALF)
    results = []
    for most in (20_000, 10):
        monkeypatch.setattr(simhash, "DENSE_PAIRS", most)
        results.append(simhash.components(240, *simhash.near_pairs(place, bits)))
    assert (results[0] == results[1]).all() and len(set(results[0])) < 40


def test_no_pair_within_the_distance_is_left_out():
    """Pairs with their differing bits spread evenly over the fingerprint, the hardest for segments, and at random."""
    rng = np.random.default_rng(3)
    plain = rng.integers(0, 2, (600, 312), dtype=np.uint8)
    flip = np.zeros((600, 312), dtype=np.uint8)
    for i in range(600):
        n = 44 if i < 500 else 45
        flip[i, (np.arange(n) * 312 // n + i % 7) % 312 if i % 2 else rng.choice(312, n, replace=False)] = 1
    rows = np.zeros((1200, 320), dtype=np.uint8)
    rows[::2, :312], rows[1::2, :312] = plain, plain ^ flip
    column = pa.array([r.tobytes() for r in np.packbits(rows, axis=1)], pa.binary())
    places = pa.Table.from_batches(simhash._place_batches(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(1200)), column], ["doc_id", "fingerprint"])])))
    edges = simhash._edge_batches(44)(iter(places.sort_by("place").combine_chunks().to_batches(5000)))
    got = {(int(b), int(a)) for e in edges for a, b in zip(e.column(0).to_pylist(), e.column(1).to_pylist(), strict=True)}
    assert got == {(2 * i, 2 * i + 1) for i in range(500)}


def test_groups_are_those_of_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert found(simhash.near_duplicates(docs)) == brute_groups([r.doc_id for r in rows], [r.text for r in rows], simhash.MAX_DISTANCE)
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, simhash.MAX_DISTANCE + 1)


def test_connected(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.root for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, None, 9), (2, "", 9), (3, "...", 9), (None, "same text here", 9), (4, "same text here", 9), (4, "same text here", 9), (5, "same text here", 9), (6, long, 9), (7, long, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    assert found(simhash.near_duplicates(docs)) == {4: {4, 5}, 6: {6, 7}}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "")[0] for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
    assert found(simhash.near_duplicates(docs.limit(0))) == {}
    assert simhash.deduplicated(docs.limit(0)).count() == 0
