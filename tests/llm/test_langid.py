import re
from collections import Counter

import numpy as np
import pyarrow as pa

from themeloom.llm import langid as L
from themeloom.llm.text import WORD, mix, prefix_hash, span_hash

SF = "/root/testdata/sf0.01"


def brute_rows(text):
    """The rows of all n-grams of a text, from its letters, and how often each comes."""
    out = Counter()
    for word in re.findall(WORD, text.lower()):
        raw = b" " + word.encode() + b" "
        for x, whole in [(raw[i : i + n], False) for n in L.SIZES for i in range(len(raw) - n + 1)] + [(raw, True)]:
            h = span_hash(prefix_hash(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))
            out[int((mix(h + np.uint64(1)) if whole else h)[0] >> np.uint64(64 - L.BITS))] += 1
    return out


def brute_answer(model, text):
    """Family and language by counting votes, machine by machine."""
    rows = brute_rows(text)
    if not rows:
        return None, "und"
    margin = [sum(model.table[r, k] * n for r, n in rows.items()) / sum(rows.values()) + model.bias[k] for k in range(model.table.shape[1])]

    def vote(machines, at):
        votes, total = Counter(), Counter()
        for k, (a, b) in enumerate(machines.pairs):
            m = margin[at + k]
            votes[a if m > 0 else b] += 1
            total[a] += m
            total[b] -= m
        return max(range(len(machines.classes)), key=lambda c: (votes[c], total[c], -c))

    family = model.families.classes[vote(model.families, 0)]
    at = len(model.families.pairs)
    for name in model.families.classes:
        if name == family:
            return family, model.within[name].classes[vote(model.within[name], at)]
        at += len(model.within[name].pairs)


def test_answers_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(docs)
    got = {r.doc_id: (r.family, r.language) for r in L.identify(docs, model).collect()}
    assert got == {r.doc_id: brute_answer(model, r.text) for r in docs.collect()} and len(set(got.values())) > 3


def test_sample_is_bounded_by_rows(spark):
    docs = spark.range(500).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text", "IF(id % 2 = 0, 'en', 'fr') AS lang")
    asked = []
    import themeloom.llm.langid as module

    train = module.train
    try:
        module.train = lambda column, languages, families: asked.append((len(column), set(languages))) or train(column, languages, families)
        L.fit(docs, 60)
    finally:
        module.train = train
    assert asked == [(60, {"en", "fr"})]


def test_scores_equal_brute_force():
    rng = np.random.default_rng(1)
    model = L.Model(L.Machines(["a", "b"], [(0, 1)]), {}, rng.normal(size=(1 << L.BITS, 1)).astype(np.float32), np.array([0.3]))
    texts = ["one two two ünï", "x", None, "..."]
    got, known = model.scores(pa.array(texts))
    assert known.tolist() == [True, True, False, False]
    for i in (0, 1):
        ((rows, share),) = L.bags(pa.array([texts[i]]))
        assert np.isclose(share.sum(), 1) and np.isclose(got[i, 0], model.table[rows, 0] @ share + 0.3, atol=1e-6)


def test_votes_and_ties():
    m = L.Machines(["a", "b", "c"], [(0, 1), (0, 2), (1, 2)])
    best, least = m.decide(np.array([[1.0, 2.0, 5.0], [-1.0, 3.0, -1.5], [-2.0, 1.0, 4.0]]))
    # the second row is a circle; a has the margins -1 and 3
    assert best.tolist() == [0, 0, 1] and least.tolist() == [1.0, -1.0, 2.0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs, 400)
    got = L.identify(docs, model).toPandas().set_index("doc_id")
    want = docs.select("doc_id", "lang").toPandas().set_index("doc_id").lang
    assert len(got) == len(want) == 1000
    assert (got.language == want[got.index]).mean() > 0.97
    assert set(got.family[got.language.isin(["fr", "es"])]) == {"romance"}


def test_odd_rows(spark):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "?!", "fr", None), (4, "the house and the garden", "en", "x"), (5, "la maison et le jardin", "fr", "x"), (5, "la maison et le jardin", "fr", "x"), (None, "the house " * 50_000, "en", "x"), (6, "talo ja puutarha", None, "x"), (7, "huis en tuin", "xx", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, family string")
    got = {(r.doc_id or 0, r.family, r.language) for r in L.identify(docs, L.fit(docs)).collect()}
    assert got >= {(1, None, "und"), (2, None, "und"), (3, None, "und"), (4, "germanic", "en"), (5, "romance", "fr"), (0, "germanic", "en"), (7, "xx", "xx")}
    assert {r.language for r in L.identify(docs, L.fit(docs.limit(0))).collect()} == {"und"}
    assert L.identify(docs.limit(0), L.fit(docs)).count() == 0
