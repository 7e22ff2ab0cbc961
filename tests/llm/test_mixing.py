import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from themeloom.llm import mixing as M

SF = "/root/testdata/sf0.01"
TARGETS = {"src0": 3.0, "src1": 1.0, "src2": 0.2}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(rows, targets, total, weights, other=0.0, unlabelled=0.5, seed=17):
    """rows: (doc_id, text, source); gives (doc_id, text, epoch) with counts."""
    tokens = lambda t: math.ceil(len(t or "") / 4)
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    has = {s: sum(tokens(r[1]) for r in x) for s, x in by.items()}
    target = {s: targets.get(s, other) if has[s] else 0 for s in by}
    out = Counter()
    for s, x in by.items():
        budget = math.floor(target[s] / sum(target.values()) * sum(has.values()) * total) if sum(target.values()) else 0
        epochs = budget // has[s] if has[s] else 0
        rest, upto = budget - epochs * has[s], 0

        def key(r):
            u = (int(hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 1) / (1 << 52)
            w = weights.get(r[0], unlabelled)
            return (-math.log(u) / w if w > 0 else math.inf, r[0] is not None, r[0] or 0, tokens(r[1]), signed(xxhash.xxh64(r[1], seed=42).intdigest()) if r[1] else 0)

        fits = True
        for r in sorted(x, key=key):
            out.update((r[0], r[1], e) for e in range(1, epochs + 1))
            upto += tokens(r[1])
            fits = fits and upto <= rest
            if fits:
                out[r[0], r[1], epochs + 1] += 1
    return out


def test_equals_brute_force_and_sql(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = M.mix(docs, TARGETS, 1.5, M.quality_weights(labels), other=0.5)
    assert got.columns == [*docs.columns, "epoch"]
    got = Counter((r.doc_id, r.text, r.epoch) for r in got.collect())
    quality = {r.doc_id: 1.0 if r.quality else 0.25 for r in labels.collect()}
    assert got == brute([(r.doc_id, r.text, r.source) for r in docs.collect()], TARGETS, 1.5, quality, 0.5)
    assert max(e for _, _, e in got) > 2
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = con.execute(M.mix_sql(TARGETS, 1.5, 0.5)).fetchall()
    assert Counter((r[0], r[3]) for r in sql) == Counter((d, e) for d, _, e in got.elements())


def test_heavier_documents_come_first(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'abcd' AS text", "'s' AS source")
    weights = spark.range(4000).selectExpr("id AS __id", "CASE WHEN id % 2 = 0 THEN 4.0D ELSE 1.0D END AS __weight")
    got = [r.doc_id for r in M.mix(docs, {"s": 1.0}, 0.2, weights).collect()]
    # drawing one by one with odds 4 : 1
    assert len(got) == 800 and len(set(got)) == 800 and 0.75 < sum(i % 2 == 0 for i in got) / 800 < 0.83


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_odd_rows_in_any_number_of_bins(spark, monkeypatch, bins):
    monkeypatch.setattr(M, "BINS", bins)
    rows = [(i, "x" * (i * 7 % 50), ["a", "b", None][i % 3]) for i in range(60)]
    rows += [(None, "no id", "a"), (3, None, "a"), (6, "", None), (9, "y" * 100_000, "b"), (9, "twice", "a"), (9, "twice", "a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, epoch int, tokens int")
    got = M.mix(docs.drop("epoch"), {"a": 2.0}, 0.9, None, other=0.01)
    assert Counter((r.doc_id, r.text, r.epoch) for r in got.collect()) == brute(rows, {"a": 2.0}, 0.9, {}, 0.01)
    assert M.mix(docs.drop("epoch").limit(0), {"a": 2.0}).count() == 0
    assert M.mix(docs, {"zzz": 1.0}).count() == 0
    assert "__epoch" in M.mix(docs, {"a": 1.0}).columns
