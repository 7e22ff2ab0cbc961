import math
import random
from collections import Counter

from themeloom.llm import packing as P

SF = "/root/testdata/sf0.01"


def brute(lengths, window, most):
    """Windows as lists of (doc, start, length), emitted and left open, with plain lists."""
    open_, out = [], []  # (room, number, pieces)
    number = 0
    for doc, n in lengths:
        start = 0
        while n - start >= window:
            out.append([(doc, start, window)])
            start += window
        size = n - start
        if not size:
            continue
        fits = [x for x in open_ if x[0] >= size]
        if fits:
            best = min(fits, key=lambda x: (x[0], x[1]))
        else:
            if len(open_) >= most:
                fullest = min(open_, key=lambda x: (x[0], x[1]))
                open_.remove(fullest)
                out.append(fullest[2])
            best = [window, number, []]
            number += 1
            open_.append(best)
        best[0] -= size
        best[2].append((doc, start, size))
        if not best[0]:
            open_.remove(best)
            out.append(best[2])
    return out, [x[2] for x in open_]


def test_packer_equals_brute_force():
    rng = random.Random(2)
    for most in (1, 3, 8):
        lengths = [(i, rng.choice([rng.randint(1, 30), rng.randint(1, 100), rng.randint(100, 350)])) for i in range(600)]
        packer = P.Packer(100, most)
        got = [[p[:3] for p in w] for doc, n in lengths for w in packer.document(doc, n, None)]
        want, left = brute(lengths, 100, most)
        assert got == want
        assert sorted([p[:3] for p in w] for w in packer.rest()) == sorted(left)


def covered(windows, window):
    """What the windows hold, by document."""
    held = Counter()
    for w in windows:
        assert sum(w.lengths) == w.tokens <= window and len(w.doc_ids) == len(w.starts) == len(w.lengths)
        held.update(zip(w.doc_ids, w.starts, w.lengths, strict=True))
    return held


def test_every_token_lies_in_one_window(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    windows = P.pack(docs, 512, 8).collect()
    held = covered(windows, 512)
    assert max(held.values()) == 1
    total = Counter()
    for doc, _, n in held:
        total[doc] += n
    assert total == {r.doc_id: math.ceil(len(r.text) / 4) for r in docs.collect()}
    assert len({w.window_id for w in windows}) == len(windows)
    # nearly full: no more than 3 % above the least possible number of windows
    assert len(windows) <= 1.03 * sum(total.values()) / 512 + 1


def test_texts_can_be_put_together_again(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = {}
    for w in P.pack(docs, 256, texts=True).collect():
        for doc, start, text in zip(w.doc_ids, w.starts, w.texts, strict=True):
            parts.setdefault(doc, {})[start] = text
    for r in docs.collect():
        assert "".join(x for _, x in sorted(parts[r.doc_id].items())) == r.text


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "é" * 9, 1), (3, "é" * 9, 1), (None, "abc", 1), (4, "z" * 400_001, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    held = covered(P.pack(docs, 1000).collect(), 1000)
    assert held == Counter({(3, 0, 3): 2, (None, 0, 1): 1, (4, 100_000, 1): 1} | {(4, k * 1000, 1000): 1 for k in range(100)})
    assert P.pack(docs.limit(0)).count() == 0
