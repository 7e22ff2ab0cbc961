from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import fingerprints as P
from themeloom.llm.text import slices

SF = "/root/testdata/sf0.001"


def brute_levels(data):
    out = []
    for i in range(len(data) - P.WIDTH + 1):
        p = np.array(list(Counter(data[i : i + P.WIDTH]).values())) / P.WIDTH
        out.append(round(float(-(p * np.log2(p)).sum()) / np.log2(P.WIDTH) * P.LEVELS, 6))
    return out


def brute_features(data, rank, levels):
    points = Counter()
    for i in range(len(levels) - P.WIDTH + 1):
        at = min(range(i, i + P.WIDTH), key=lambda k: (rank[levels[k]], k))
        points[at] += 1
    return sorted(k for k, v in points.items() if v >= P.POINTS)


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return [x[:900] for x in t.text[:25]] + [None, "", "short", "a" * 200, "x" * 126, "x" * 127]


def test_levels_and_features_equal_brute_force(texts):
    got_levels = [P.entropy_levels(np.frombuffer((t or "").encode(), np.uint8)) for t in texts]
    for t, got in zip(texts, got_levels, strict=True):
        want = brute_levels((t or "").encode())
        assert len(got) == len(want) and all(abs(a - b) <= 0.5 + 1e-5 for a, b in zip(got, want, strict=True))
    rank = P.ranks(np.bincount(np.concatenate(got_levels), minlength=P.LEVELS + 1))
    found = {i: [] for i in range(len(texts))}
    for part in slices(pa.array(texts), lower=False, size=3000):
        at, doc = P.features(part, rank)
        for a, d in zip(at, doc, strict=True):
            found[part.first + d].append(a - part.start[d])
    assert list(found.values()) == [brute_features((t or "").encode(), rank, lv) for t, lv in zip(texts, got_levels, strict=True)]
    assert sum(map(len, found.values())) > 100


def test_histogram_counts_every_window(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [len(r.text.encode()) for r in docs.collect()]
    assert P.histogram(docs).sum() == sum(max(0, n - P.WIDTH + 1) for n in sizes)


def test_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rank = P.ranks(P.histogram(docs))
    rows = [r.text for r in docs.where("n_chars > 3000 and lang = 'en'").orderBy("doc_id").dropDuplicates(["text"]).limit(30).collect()]
    a, b = rows[0], rows[1]
    half = a[: len(a) // 2] + b[len(b) // 2 :]
    changed = a[:500] + "something else" + a[520:]
    d = P.digests(pa.array([a, b, half, changed, a, a[:1500], "tiny"]), rank)
    assert P.similarity(d[0], d[4]) == 100
    assert P.similarity(d[0], d[3]) > 80 > P.similarity(d[0], d[2]) > 10
    assert P.similarity(d[0], d[1]) < 5 and P.similarity(d[0], d[6]) is None
    assert P.similarity(d[0], d[5]) > 50
    # all at once as one by one
    many = P._many(d)
    for x in d[:6]:
        scores = [P.similarity(x, y) or 0 for y in d]
        at, value = many(x)
        assert value == pytest.approx(max(scores)) and scores[at] == pytest.approx(value)


def test_odd_rows(spark):
    text = " ".join(f"word{i * i}" for i in range(200))
    rows = [(1, None, 1), (2, "", 1), (3, "short", 1), (4, text, 1), (4, text, 1), (None, text, 1), (5, " ".join(str(i**3) for i in range(60_000)), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    reference = spark.createDataFrame([(7, text), (8, None), (None, text)], "item_id long, text string")
    got = P.fingerprint(docs, P.histogram(docs), reference).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and [by[i].features for i in (1, 2, 3)] == [0, 0, 0] and bytes(by[1].digest) == b""
    assert by[4].nearest == 7 == by[None].nearest and by[4].similarity == 100 and by[1].nearest is None
    assert len(by[5].digest) == P.FILTER_BYTES * -(-by[5].features // P.PER_FILTER) > 5000
    empty = docs.limit(0)
    assert P.histogram(empty).sum() == 0 and P.fingerprint(empty, P.histogram(empty)).count() == 0


def test_short_texts_match_their_copies(spark):
    passage = "The quick brown fox jumps over the lazy dog; 0123456789 times."
    texts = [passage, passage + " Then it rests.", (passage + " ") * 2 + "end", "".join(chr(33 + i * i % 90) for i in range(200))]
    sizes = [len(t) for t in texts]
    assert sizes[0] < P.WIDTH <= sizes[1] < 2 * P.WIDTH and all(2 * P.WIDTH - 1 <= n < 254 for n in sizes[2:])
    d = P.digests(pa.array([*texts, *texts, "", None]), P.ranks(np.arange(P.LEVELS + 1)))
    assert all(n < P.LEAST for n, _ in d)
    for i in range(4):
        assert P.similarity(d[i], d[i + 4]) == 100 and P._many(d[:4])(d[i + 4]) == (i, 100)
        assert all((P.similarity(d[i], d[j]) or 0) < 100 for j in range(4) if j != i)
    assert P.similarity(d[8], d[9]) is None
    docs = spark.createDataFrame([(1, texts[0]), (2, "Before. " + texts[1] + " " + " ".join(str(i**3) for i in range(900))), (3, texts[1][:-1]), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {(r.doc_id, r.other_id) for r in P.matches(docs, P.histogram(docs), items).where("kind = 'item' and similarity = 100").collect()}
    assert got == {(1, 0), (2, 0), (2, 1), (3, 0)}


def test_every_pair_that_brute_force_finds(spark):
    from themeloom.llm.queries import op6_fingerprints

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()
    rank, rows = P.ranks(P.histogram(docs)), docs.orderBy("doc_id").collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    all_ = list(P._digested(pa.array([r.text for r in rows]), rank))
    known = P.digests(pa.array([r.text for r in items]), rank)
    want, first = set(), {}
    for r, (n, filters, hashes) in zip(rows, all_, strict=True):
        for item, k in zip(items, known, strict=True):
            if (P.similarity((n, filters), k) or 0) >= P.ALIKE or k[0] < P.LEAST and item.text in r.text:
                want.add((r.doc_id, "item", item.item_id))
        if (n, filters) in first:
            want.add((r.doc_id, "document", first[n, filters][0]))
            continue
        for other, (other_id, others) in first.items():
            same = set(hashes.tolist()) & others
            mixed = (n < P.LEAST) != (other[0] < P.LEAST)
            inside = mixed and len(same) == len(set(hashes.tolist()) if n < P.LEAST else others)
            # without a common feature, bits agree by chance only
            if same and (inside or (P.similarity((n, filters), other) or 0) >= P.ALIKE):
                want.add((other_id, "document", r.doc_id))
        first[n, filters] = r.doc_id, set(hashes.tolist())
    got = [(r.doc_id, r.kind, r.other_id) for r in P.matches(docs, P.histogram(docs), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {k for _, k, _ in want} == {"item", "document"} and len(want) > 10

    # the query: a row for each document
    edges = [(a, b) for a, kind, b in want if kind == "document"]
    near = {r.doc_id: {r.doc_id} for r in rows}
    for a, b in edges:
        if near[a] is not near[b]:
            near[a] |= near[b]
            for x in near[b]:
                near[x] = near[a]
    group = {r.doc_id: first[n, filters][0] if filters else None for r, (n, filters, _) in zip(rows, all_, strict=True)}
    same = Counter(g for g in group.values() if g is not None)
    links = Counter(x for a, b in edges if group[a] != group[b] for x in (a, b))
    wanted = {r.doc_id: (min(near[r.doc_id]), max(0, same[group[r.doc_id]] - 1), links[group[r.doc_id]], {i for d, kind, i in want if kind == "item" and d == r.doc_id}) for r in rows}
    found = op6_fingerprints(spark, SF).collect()
    assert len(found) == len(rows) and {r.doc_id: (r.class_id, r.copies, r.links, set(r.item_ids)) for r in found} == wanted
    assert all(list(r.similarities) == sorted(r.similarities, reverse=True) for r in found)


def test_pairs_by_their_most_common_features(spark):
    """Documents alike by one filter of their chains, or by features that many others have as well."""
    rng = np.random.default_rng(2)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 11))) for _ in range(n))
    common, chapter = words(45), words(1340)
    texts = [words(int(n)) + " " + common for n in rng.integers(110, 220, 50)] + [chapter + " " + words(3800) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = np.arange(P.LEVELS + 1)
    all_ = list(P._digested(pa.array(texts), P.ranks(counts)))
    assert min(n for n, *_ in all_) >= P.LEAST and max(len(f) for _, f, _ in all_) > P.FILTER_BYTES
    want = set()
    for j, (m, y, k) in enumerate(all_):
        for i, (n, x, h) in enumerate(all_[:j]):
            if np.intersect1d(h, k).size and P.similarity((n, x), (m, y)) >= P.ALIKE:
                want.add((i, j))
    items = spark.createDataFrame([], "item_id long, text string")
    assert {(r.doc_id, r.other_id) for r in P.matches(docs, counts, items).collect()} == want and {(50, 51), (52, 53)} <= want
    links = Counter(x for pair in want for x in pair)
    assert {r.doc_id: r.links for r in P.linked(docs, counts, items).collect()} == {i: links[i] for i in range(len(texts))}


def test_linked_odd_rows(spark):
    text = " ".join(f"word{i * i}" for i in range(200))
    rows = [(1, None, 1), (2, "", 1), (3, "short", 1), (4, text, 1), (4, text, 1), (5, text, 1), (4, "short", 1), (None, text, 1), (6, text + " ".join(str(i**3) for i in range(90)), 1), (7, text * 300, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    reference = spark.createDataFrame([(7, text), (8, None), (None, text)], "item_id long, text string")
    got = {(r.doc_id, r.class_id, r.copies, tuple(r.item_ids)) for r in P.linked(docs, P.histogram(docs), reference).collect()}
    assert {g[:3] for g in got} == {(1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 3, 1), (4, 4, 1), (5, 4, 1), (6, 4, 0), (7, 4, 0)}
    assert {g[0] for g in got if g[3] == (7,)} == {4, 5, 6, 7}
    assert P.linked(docs.limit(0), P.histogram(docs.limit(0)), reference).count() == 0
    assert P.linked(docs, P.histogram(docs), reference.limit(0)).where("size(item_ids) > 0").count() == 0


def test_meetings_leave_no_pair_out(spark, monkeypatch):
    """Each pair with a common feature is compared once, whatever the lowest rows with its features are, also where meetings are cut."""
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 11))) for _ in range(n))
    x, y, z, every = words(60), words(60), words(150), words(60)
    # 1 and 2 both meet 0, each by another feature, and have one in common that 0 hasn't
    texts = [f"{x} {y}", f"{words(5)} {x} {z}", f"{words(5)} {y} {z}", *(f"{words(int(n))} {every}" for n in rng.integers(20, 60, 40)), *(f"{words(30)} {t} {words(30)}" for t in (x, y, z))]
    texts += [every[:n] for n in range(170, 300, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    counts = np.arange(P.LEVELS + 1)
    all_ = list(P._digested(pa.array(texts), P.ranks(counts)))
    want, mixed = set(), 0
    for j, (m, v, k) in enumerate(all_):
        for i, (n, u, h) in enumerate(all_[:j]):
            same, short = np.intersect1d(h, k).size, h if n < P.LEAST else k
            inside = (n < P.LEAST) != (m < P.LEAST) and same == np.unique(short).size
            if same and (inside or (P.similarity((n, u), (m, v)) or 0) >= P.ALIKE):
                want.add((i, j))
                mixed += inside
    lowest = [{h for h in all_[i][2] if h in all_[0][2]} for i in (1, 2)]
    assert all(lowest) and not lowest[0] & lowest[1] and (1, 2) in want and len(want) > 700 and mixed > 40
    links = Counter(i for pair in want for i in pair)
    items = spark.createDataFrame([], "item_id long, text string")
    for size in (P.MEETING, 9):
        monkeypatch.setattr(P, "MEETING", size)
        got = [(r.doc_id, r.other_id) for r in P.matches(docs, counts, items).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {r.doc_id: r.links for r in P.linked(docs, counts, items).collect()} == {i: links[i] for i in range(len(texts))}


def test_pairs_are_never_rows_of_a_shuffle(spark):
    """Near copies are compared with each other where they meet: their number, not that of their pairs, is what is moved."""
    rng = np.random.default_rng(7)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 11))) for _ in range(n))
    common = words(150)
    docs = spark.createDataFrame([(i, f"{words(40)} {common}") for i in range(300)], "doc_id long, text string")
    rows, _, met = P._compared(docs, np.arange(P.LEVELS + 1), spark.createDataFrame([], "item_id long, text string"), P.ALIKE)
    assert rows.count() == 300 and met.count() < 3 * 300
    found = met.mapInArrow(P._link_batches(P.ALIKE), "a long, b long, links long").collect()
    assert len(found) < 3 * 300 and sum(r.links for r in found) > 50 * 300
