import random
from collections import Counter
from itertools import combinations

import pytest

from themeloom.llm import licenses as L

SF = "/root/testdata/sf0.1"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def test_increasing_subsequence_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        v = [rng.randrange(9) for _ in range(rng.randrange(9))]
        got = [v[i] for i in L._increasing(v)]
        assert got == sorted(set(got))
        best = max((n for n in range(len(v) + 1) for c in combinations(v, n) if list(c) == sorted(set(c))), default=0)
        assert len(got) == best


def test_alignment_against_longest_common_subsequence():
    rng = random.Random(2)
    t = L.words_of(L.TEMPLATES["MIT"][2])[0]
    for cut in (0.0, 0.05, 0.15):
        text = [w if rng.random() > cut else rng.choice(["foo", "the", "of"]) for w in t]
        text = ["x"] * 5 + text + ["y"] * 5
        pairs = L.align(t, text)
        assert all(t[i] == text[k] for i, k in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert 0.97 * lcs(t, text) <= len(pairs) <= lcs(t, text)


@pytest.mark.parametrize(("name", "text"), [(n, t) for n, ts in L.TEMPLATES.items() for t in ts])
def test_every_wording_is_found_as_itself(name, text):
    wrapped = "Some prose before it. " + text.upper() + ". And prose after it, by the author."
    found = L.find(wrapped)
    assert [f[0] for f in found] == [name] and found[0][1] == 1.0
    assert wrapped[found[0][2] : found[0][3]].lower() == text


def test_worn_copies_and_near_misses():
    t = L.TEMPLATES["MIT"][2].split()
    rng = random.Random(3)
    worn = [w for w in t if rng.random() > 0.08]
    (hit,) = L.find(" ".join(worn))
    assert hit[0] == "MIT" and hit[1] > 0.85
    for text in ("The license of the driver expired.", "Apache helicopters are under the version of the army", "licensed under the apache license version 1.1", " ".join(t[: len(t) // 2])):
        assert L.find(text) == []


def test_table_against_plain_search(spark):
    """Exactly the documents in which the words of a license line follow each other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = {"Apache-2.0": "licensed under the apache license version 2.0", "MIT": "released under the mit license", "GPL-3.0": "this work is licensed under the gnu general public license version 3", "CC-BY-NC-4.0": "licensed under cc by-nc 4.0"}
    spaced = lambda text: f" {' '.join(L.words_of(text)[0])} "
    want = {(r.doc_id, name) for r in docs.collect() for name, line in lines.items() if spaced(line) in spaced(r.text)}
    assert len(want) > 200 and {(r.doc_id, r.license) for r in L.scan(docs).collect()} == want


def brute(text):
    """Every template against the stretch at every word, with the longest common subsequence in place of anchors."""
    words, spans = L.words_of(text)
    found = []
    for name, texts in L.TEMPLATES.items():
        for t in (L.words_of(x)[0] for x in texts):
            need = Counter(w for w in t if w in L._NAMES or w.isdigit())
            slack = int(len(t) * L.SLACK) + 1
            for low in range(max(1, len(words) - len(t) + slack)):
                part = words[low : low + len(t) + slack]
                if need - Counter(part) or sum((Counter(t) & Counter(part)).values()) < L.COVERAGE * len(t):
                    continue
                if (n := lcs(t, part)) >= L.COVERAGE * len(t):
                    found.append((n, name, spans[low][0], spans[low + len(part) - 1][1]))
    best = []
    for n, name, start, end in sorted(found, key=lambda x: -x[0]):
        if all(end <= s or start >= e for _, s, e in best):
            best.append((name, start, end))
    return sorted(best, key=lambda x: x[1])


def test_scan_equals_brute_force(spark):
    rng = random.Random(6)
    base = [r.text[:600] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    wordings = [(n, t) for n, ts in L.TEMPLATES.items() for t in ts]
    texts = []
    for i, text in enumerate(base):
        _, t = wordings[i % len(wordings)]
        worn = [w if rng.random() > 0.04 or w in L._NAMES or w[0].isdigit() else "foo" for w in t.split()]
        texts.append(f"{text}\n{' '.join(worn)}\n{text}")
    rows = spark.createDataFrame(list(enumerate(texts + base)), "doc_id long, text string")
    got = {}
    for r in L.scan(rows).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start, r.end))
    for i, text in enumerate(texts + base):
        want, have = brute(text), sorted(got.get(i, []), key=lambda x: x[1])
        assert [x[0] for x in have] == [x[0] for x in want], i
        assert all(x[1] >= y[1] and x[2] <= y[2] for x, y in zip(have, want, strict=True))


def test_every_wording_is_hinted():
    import re

    for t in L._TEMPLATES:
        for key in t.keys:
            assert re.search(L.HINT, f"x {key.upper()} y")


@pytest.mark.parametrize("shape", ["Released under the MIT license.\n", "license ", "copyright ", "warranties ", L.TEMPLATES["MIT"][2] + " "])
def test_long_texts_take_time_in_proportion(shape):
    import time

    times = []
    for n in (100_000, 400_000):
        began = time.process_time()
        L.find((shape * n)[:n])
        times.append(time.process_time() - began)
    assert times[1] < 9 * times[0] + 0.5


def test_odd_rows(spark):
    line = "Licensed under the Apache License, Version 2.0. "
    rows = [(1, None, "x"), (2, "", "x"), (3, line * 3, "x"), (3, line * 3, "x"), (None, "word " * 100_000 + line, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r.doc_id or 0, r.start) for r in L.scan(docs).collect())
    assert got == [(0, 500_000)] + [(3, k * len(line)) for k in range(3) for _ in range(2)]
    assert L.scan(docs.limit(0)).count() == 0
