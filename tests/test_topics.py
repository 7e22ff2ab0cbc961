import math

import numpy as np
import pytest

from themeloom.operators import consensus, keywords, metrics, topics


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def labels_of(df):
    return {r.id: r.topic for r in df.collect()}


def test_softmax_by_hand(spark):
    v = table(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    c = table(spark, [(0, [2.0, 0.0]), (1, [0.0, 3.0])], "topic int, centroid array<double>")
    p = {(r.id, r.topic): r.prob for r in topics.soft(v, c).collect()}
    assert p[1, 0] == pytest.approx(math.e**5 / (math.e**5 + 1)) and p[2, 0] == p[2, 1] == 0.5
    assert labels_of(topics.assign(v, c)) == {1: 0, 2: -1}


def test_small_topics_and_merging(spark):
    rows = [(i, t) for i, t in enumerate([4] * 5 + [7] * 6 + [2] * 4 + [9] + [-1] * 3)]
    labels = table(spark, rows, "id long, topic int")
    got = labels_of(topics.drop_small(labels, 5))
    assert set(got.values()) == {-1, 0, 1} and got[0] == 0 and got[5] == 1 and got[11] == -1 and len(got) == len(rows)
    assert sorted(set(labels_of(topics.merge(labels, [4, 7, 99])).values())) == [-1, 2, 7, 9]
    with pytest.raises(ValueError):
        topics.merge(labels, [4])
    assert topics.drop_small(labels.limit(0), 5).isEmpty()


def brute_reduce(x, t, n):
    t = t.copy()
    while len(ids := sorted(set(t) - {-1})) > n:
        mean = np.array([x[t == i].mean(0) for i in ids])
        size = np.array([(t == i).sum() for i in ids])
        u = mean / np.linalg.norm(mean, axis=1, keepdims=True)
        sim = u @ u.T
        np.fill_diagonal(sim, -1)
        sim = sim * (np.minimum.outer(size, size) / np.maximum.outer(size, size)) ** 0.3
        i, j = np.unravel_index(np.argmax(sim), sim.shape)
        keep, gone = (i, j) if size[i] >= size[j] else (j, i)
        t[t == ids[gone]] = ids[keep]
    return t


def test_reducing_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x, t = rng.normal(size=(80, 5)), rng.integers(-1, 9, 80)
    v = table(spark, [(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = labels_of(topics.reduce_to(v, table(spark, [(i, int(a)) for i, a in enumerate(t)], "id long, topic int"), 3))
    assert [got[i] for i in range(80)] == brute_reduce(x, t, 3).tolist()


def test_graph_assignment_without_edges_is_uniform(spark):
    edges = table(spark, [(1, 2, 3.0), (1, 3, 1.0)], "src long, dst long, w double")
    labels = table(spark, [(1, -1), (2, 0), (3, 1), (4, 1)], "id long, topic int")
    p = {(r.id, r.topic): r.prob for r in topics.graph_probabilities(edges, labels).collect()}
    assert p[1, 0] == 0.75 and p[1, 1] == 0.25 and p[4, 0] == p[4, 1] == 0.5 and p[2, 0] == 0.5


def test_border_pairs_of_words(spark):
    docs = table(spark, [(1, "red fox", 0), (2, "blue owl", 0), (3, "fox blue", 1), (4, "fox blue zebra", 1)], "id long, text string, topic int")
    got = {r.term: r.score for r in keywords.ctfidf(docs, 20, min_df=2, max_df=1.0).where("topic = 0").collect()}
    # "fox blue" lies across the border of the first topic's texts; terms: fox, blue, fox blue
    assert got["fox blue"] == pytest.approx(1 / 3 * math.log(4 / 3)) and set(got) == {"fox", "blue", "fox blue"}


def test_keywords_of_empty_and_null_texts(spark):
    docs = table(spark, [(1, None, 0), (2, "", 0), (3, "word word other", 1), (4, "word", 1)], "id long, text string, topic int")
    for f in (keywords.ctfidf, keywords.bm25, keywords.keyphrases):
        assert {r.topic for r in f(docs).collect()} <= {0, 1}
    with pytest.raises(ValueError):
        keywords.extract(docs, "magic")


def test_mmr_keywords(spark):
    docs = table(spark, [(1, "apple apple pear", 0), (2, "stone", 1)], "id long, text string, topic int")

    def encode(texts):
        return np.array([[t.count("apple") + 0.1, t.count("pear"), t.count("stone")] for t in texts], float)

    got = keywords.embedded(docs, lambda: encode, 2).where("topic = 0").orderBy("place").collect()
    assert len(got) == 2 and got[0].score >= got[1].score > 0


def brute_ari(a, b):
    n = len(a)
    both = sum(a[i] == a[j] and b[i] == b[j] for i in range(n) for j in range(i))
    sa, sb = (sum(x[i] == x[j] for i in range(n) for j in range(i)) for x in (a, b))
    e = sa * sb / (n * (n - 1) / 2)
    return (both - e) / ((sa + sb) / 2 - e)


def test_rand_index(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 4, 40), rng.integers(-1, 3, 40)
    la, lb = (table(spark, [(i, int(t)) for i, t in enumerate(x)], "id long, topic int") for x in (a, b))
    want = brute_ari(a, b)
    assert metrics.rand_index(metrics.contingency(la, lb)).first()[0] == pytest.approx(want)
    assert consensus.ari(a, b) == pytest.approx(want) and consensus.ari(a, a) == 1.0
    assert metrics.rand_index(metrics.contingency(la, la)).first()[0] == 1.0


def test_coherence_by_hand(spark):
    docs = table(spark, [(1, "cat dog"), (2, "cat dog"), (3, "cat"), (4, "bird")], "id long, text string")
    words = table(spark, [(0, 1, "cat"), (0, 2, "dog"), (0, 3, "cat dog"), (1, 1, "bird")], "topic int, place int, term string")
    got = {r.topic: r.coherence for r in metrics.coherence(words, docs, "umass").collect()}
    assert got == {0: pytest.approx(math.log(3 / 2)), 1: 0.0}
    npmi = {r.topic: r.coherence for r in metrics.coherence(words, docs).collect()}
    assert npmi[0] == pytest.approx(math.log(0.6 / (0.8 * 0.6)) / -math.log(0.6))
    assert metrics.diversity(words) == 1.0 and metrics.diversity(words.limit(0)) == 0.0


def test_consensus_of_signatures_is_that_of_rows(spark):
    rng = np.random.default_rng(5)
    truth = np.repeat(np.arange(4), 10)
    runs = []
    for r in range(6):
        t = truth.copy()
        t[rng.choice(40, 3, replace=False)] = rng.integers(0, 4, 3)
        runs += [(r, i, int(t[i])) for i in range(40)]
    parts = table(spark, runs, "run int, id long, topic int")
    for method in ("graph", "hierarchical"):
        got = labels_of(consensus.consensus(parts, method))
        assert consensus.ari(np.array([got[i] for i in range(40)]), truth) > 0.95
    pairs = {(r.src, r.dst): r.n for r in consensus.cooccurrence(parts).collect()}
    by_run = np.array([t for _, _, t in runs]).reshape(6, 40)
    assert pairs == {(i, j): int(n) for i in range(40) for j in range(i + 1, 40) if (n := (by_run[:, i] == by_run[:, j]).sum())}
    assert 0.7 < metrics.stability(parts) < 1 and metrics.stability(parts.where("run = 0")) == 1.0


def test_resolution_for_a_number_of_communities():
    # two groups of three cliques: weights 1 within a clique, 0.3 within a group, 0.01 across
    n = 30
    pair = np.array([(i, j) for i in range(n) for j in range(i + 1, n)])
    src, dst = pair[:, 0], pair[:, 1]
    w = np.where(src // 5 == dst // 5, 1.0, np.where(src // 15 == dst // 15, 0.3, 0.01))
    graph = (np.arange(n), src, dst, w)
    for target in (2, 6):
        gamma = consensus.search_resolution(graph, 0.1, 5.0, 20, target)
        part = consensus.leiden(n, src, dst, w, gamma, 42)
        assert len(set(part)) == target and len(set(part[:5])) == 1
    assert 0.1 <= consensus.search_resolution(graph) <= 2.0
