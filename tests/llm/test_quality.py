import numpy as np
import pyarrow as pa
import pytest

from themeloom.llm import quality as Q

SF = "/root/testdata/sf0.1"


def brute_path(forest, tree, row):
    node = 0
    while forest.rule[tree, node] >= 0:
        node = 2 * node + (2 if row[forest.rule[tree, node]] >= forest.value[tree, node] else 1)
    return forest.value[tree, node]


def test_scores_equal_brute_force():
    x = np.random.default_rng(1).normal(size=(400, 3))
    x[0] = 9
    forest = Q.fit_forest(x, trees=20)
    got = forest.score(x)
    want = [2 ** -(np.mean([brute_path(forest, t, row) for t in range(20)]) / forest.norm) for row in x]
    assert np.allclose(got, want) and got.argmax() == 0


def test_statistics_by_hand():
    text = "AB CD the the the x1%% | |\n" + "the same long line here\n" * 4
    x, words = Q.statistics(pa.array([text, None, "", "...", text]))
    rules = dict(zip(Q.RULES, x[0], strict=True))
    n = 6 + 20
    assert words.tolist() == [n, 0, 0, 0, n] and (x[0] == x[4]).all()
    assert rules["symbols_per_word"] == pytest.approx(4 / (n + Q.PRIOR))
    assert rules["capital_words"] == pytest.approx(2 / (n + Q.PRIOR))
    assert rules["repeated_neighbours"] == pytest.approx(2 / (n + Q.PRIOR))
    assert rules["repeated_lines"] == pytest.approx(3 / (5 + 3))


def test_allowance_comes_from_the_good_rows():
    rng = np.random.default_rng(3)
    x, good = rng.random((500, len(Q.RULES))), np.arange(500) % 4 > 0
    want = [np.median(c[good]) + Q.MARGIN * (np.percentile(c[good], Q.CENTILE) - np.median(c[good])) for c in x.T]
    assert np.allclose(Q.allowance(x, good), want) and not Q.allowance(x, np.zeros(500, bool)).any()
    x[~good] = 1e9
    assert np.allclose(Q.allowance(x, good), want)


def test_decisions_equal_brute_force(spark):
    """Every row of the table: statistics of each text alone, paths tree by tree."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    forest = Q.fit(docs, labels)
    kept = {r.doc_id: r.score for r in Q.kept_scores(docs, forest).collect()}
    for r in docs.collect():
        (row,), (words,) = Q.statistics(pa.array([r.text]))
        row = [max(0.0, v - a) for v, a in zip(row, forest.allowed, strict=True)]
        score = 2 ** -(np.mean([brute_path(forest, t, row) for t in range(len(forest.rule))]) / forest.norm)
        assert (r.doc_id in kept) == (score <= forest.threshold and words > 0)
        assert r.doc_id not in kept or kept[r.doc_id] == pytest.approx(score)


def test_calibration():
    score, good = np.array([0.9, 0.8, 0.8, 0.5, 0.4, 0.1]), np.array([False, False, False, True, True, True])
    assert Q.calibrate(score, good) == pytest.approx(0.65)
    assert Q.calibrate(score, ~good) == np.inf
    assert Q.calibrate(score[:0], good[:0]) == np.inf
    assert Q.calibrate(score, np.ones(6, bool)) == np.inf


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    forest = Q.fit(docs, labels, sample=1000)
    rest = labels.join(Q.labelled_sample(docs, labels, "quality", 1000), "doc_id", "left_anti").toPandas()
    kept = {r.doc_id for r in Q.kept_scores(docs, forest).collect()}
    stay = rest.doc_id.isin(kept)
    assert len(rest) > 2000
    assert stay[rest.quality == 1].mean() > 0.995 and stay[rest.quality == 0].mean() < 0.03


def test_every_labelled_row_counts(spark):
    """Allowance and threshold are those of all labelled rows, more than the 8,000 of the former sample."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12), i -> IF((id * i) % 7 = 3, '#', IF(id % 11 = 0, '$$ 12', concat('word', id % (i + 5)))))) AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id % 11 = 0, 0, 1) AS quality")
    forest = Q.fit(docs, labels)
    rows = docs.join(labels, "doc_id").orderBy("doc_id").toPandas()
    x, _ = Q.statistics(pa.array(rows.text))
    good = rows.quality.to_numpy() > 0
    assert np.allclose(forest.allowed, Q.allowance(x, good), rtol=1e-12)
    assert forest.threshold == Q.calibrate(forest.score(forest.excess(x)), good)
    assert Q.labelled_statistics(docs, labels).count() == 9000


def test_odd_rows(spark):
    long = "word " * 100_000
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "?!", 1.0), (None, "a good plain text here", 1.0), (4, "a good plain text here", 1.0), (4, "a good plain text here", None), (5, long, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, 1), (4, None), (5, 0), (None, 1)], "doc_id long, quality int")
    forest = Q.fit(docs, labels)
    kept = Q.accepted(docs, forest)
    assert kept.schema == docs.schema and kept.count() >= 3
    assert sorted(r.doc_id or 0 for r in Q.accepted(docs, Q.fit(docs, labels.limit(0))).collect()) == [0, 4, 4, 5]
    assert Q.kept_scores(docs.limit(0), forest).count() == 0
