"""Language identification in two levels.

First the language family is predicted, then one-versus-one linear support vector
machines separate the languages within that family by majority vote. Families
are separated by one-versus-one machines in the same way. Every machine works on
the shares that hashed character n-grams have of a text, and is trained in numpy
by stochastic subgradient descent on the hinge loss (Pegasos).

The machines are fitted on at most ``SAMPLE`` rows whose language is given, the
first in the order of a hash of ``doc_id``. Every text is read whole.

Null and empty texts and those without any word get the language ``und`` and no
family. Votes that tie are decided by the sum of margins, then by name. A family
with one language needs no machine. Languages that no family lists are families
of their own. Repeated rows get equal answers, a null ``doc_id`` is passed on,
and an empty sample makes every answer ``und``. Other columns, whatever their
names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subwords import bounded_words, ngrams, word_scores
from .text import slices, sums, whole

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
    "indo-aryan": ("hi", "bn", "ur", "mr"),
}
SIZES, BITS = (2, 3, 4), 16
SAMPLE, STEPS, BATCH, PENALTY = 4_000, 300, 64, 1e-3


@dataclass
class Machines:
    """One-versus-one machines between classes: weight columns and biases, a pair each."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)

    def decide(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of margins, a column for each pair: the class with most votes, and its least margin over another."""
        votes, total = np.zeros((len(margin), len(self.classes))), np.zeros((len(margin), len(self.classes)))
        least = np.full((len(margin), len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margin[:, k]
            for c, x in ((a, m), (b, -m)):
                votes[:, c] += x > 0 if c == a else x >= 0
                total[:, c] += x
                least[:, c] = np.minimum(least[:, c], x)
        # votes first, then margins; classes are in order of their names
        best = np.lexsort((np.broadcast_to(-np.arange(len(self.classes)), votes.shape), total, votes), axis=1)[:, -1] if len(margin) else np.zeros(0, int)
        return best, least[np.arange(len(margin)), best]


@dataclass
class Model:
    families: Machines
    within: dict[str, Machines]
    table: np.ndarray  # a column for each machine, families first
    bias: np.ndarray

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The margins of every machine, and whether a text has words."""
        out, known = np.zeros((len(column), self.table.shape[1])), np.zeros(len(column), bool)
        for part in slices(column):
            data, offset, index, first = bounded_words(part)
            score, count = word_scores(data, offset, SIZES, BITS, self.table) if len(index) else (np.zeros((0, self.table.shape[1])), np.zeros(0, int))
            total = sums(count[index], first)
            rows = slice(part.first, part.first + len(part))
            known[rows] = total > 0
            for k in range(self.table.shape[1]):
                out[rows, k] = sums(score[index, k], first) / np.maximum(total, 1) + self.bias[k]
        return out, known

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Family (None if unknown), language, and the margin of the weaker of both decisions."""
        margin, known = self.scores(column)
        family, language = np.full(len(known), None, object), np.full(len(known), "und", object)
        sure = np.zeros(len(known))
        if not self.families.classes:
            return family, language, sure
        chosen, least = self.families.decide(margin[:, : len(self.families.pairs)])
        at = len(self.families.pairs)
        for f, name in enumerate(self.families.classes):
            machines = self.within[name]
            rows = np.flatnonzero(known & (chosen == f))
            best, inner = machines.decide(margin[rows, at : at + len(machines.pairs)])
            at += len(machines.pairs)
            family[rows], language[rows] = name, np.array(machines.classes, object)[best]
            sure[rows] = np.minimum(least[rows], inner)
        return family, language, np.where(np.isfinite(sure), sure, 0.0)


def bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, the n-gram rows that occur in it and their shares."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for part in slices(column):
        data, offset, index, first = bounded_words(part)
        rows, word = ngrams(data, offset, SIZES, BITS) if len(index) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(word, kind="stable")
        rows, begin = rows[order], np.searchsorted(word[order], np.arange(len(offset)))
        for i in range(len(part)):
            words, times = np.unique(index[first[i] : first[i + 1]], return_counts=True)
            n = begin[words + 1] - begin[words] if len(words) else np.zeros(0, int)
            each = np.repeat(times, n)
            at = np.repeat(begin[words], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) if len(words) else np.zeros(0, int)
            unique, where = np.unique(rows[at], return_inverse=True)
            weight = np.bincount(where, weights=each, minlength=len(unique))
            out.append((unique, weight / max(weight.sum(), 1)))
    return out


def pegasos(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A linear machine for labels +1 and -1, both classes drawn equally often. Shares are scaled up, since they are small."""
    w, bias, scale = np.zeros(1 << BITS), 0.0, 30.0
    mean, mean_bias = np.zeros(1 << BITS), 0.0
    sides = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    for t in range(1, STEPS + 1):
        rate = 1 / (PENALTY * (t + 50))
        pick = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        margin = np.array([y[i] * (scale * (w[x[i][0]] @ x[i][1]) + bias) for i in pick])
        w *= 1 - rate * PENALTY
        for i in pick[margin < 1]:
            w[x[i][0]] += rate / BATCH * y[i] * scale * x[i][1]
            bias += 0.01 * rate / BATCH * y[i]
        if t > STEPS // 2:
            mean += w
            mean_bias += bias
    half = STEPS - STEPS // 2
    return mean * scale / half, mean_bias / half


def train(column: pa.Array, languages: list[str], families: dict[str, tuple[str, ...]] = FAMILIES, seed: int = 0) -> Model:
    """All machines from texts with known languages; texts without words don't count."""
    x = bags(column)
    used = [i for i in range(len(x)) if len(x[i][0])]
    x, languages = [x[i] for i in used], [languages[i] for i in used]
    family_of = {lang: f for f, of in families.items() for lang in of}
    names = np.array([family_of.get(lang, lang) for lang in languages], object)
    langs = np.array(languages, object)
    rng = np.random.default_rng(seed)
    columns: list[tuple[np.ndarray, float]] = []

    def machines(rows: np.ndarray, label: np.ndarray) -> Machines:
        classes = sorted(set(label[rows]))
        out = Machines(classes, list(combinations(range(len(classes)), 2)))
        for a, b in out.pairs:
            of = rows[(label[rows] == classes[a]) | (label[rows] == classes[b])]
            columns.append(pegasos([x[i] for i in of], np.where(label[of] == classes[a], 1.0, -1.0), rng))
        return out

    top = machines(np.arange(len(x)), names)
    within = {f: machines(np.flatnonzero(names == f), langs) for f in top.classes}
    table = np.stack([w for w, _ in columns], axis=1).astype(np.float32) if columns else np.zeros((1 << BITS, 0), np.float32)
    return Model(top, within, table, np.array([b for _, b in columns]))


def fit(docs: DataFrame, sample: int = SAMPLE, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """The machines from at most ``sample`` documents with a ``lang``."""
    # ids and hashes first, so that only the texts of the sample are moved; ids may repeat, and so may rows
    chosen = docs.where("doc_id is not null and lang is not null").select("doc_id", F.xxhash64("text").alias("hash"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", "hash"), "doc_id", "hash").limit(sample).distinct().select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"))
    rows = docs.select(F.col("doc_id").alias("__of"), whole("doc_id"), "text", "lang").where("lang is not null")
    rows = rows.join(F.broadcast(chosen), (F.col("__of") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_semi").drop("__of")
    rows = rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "lang", "text").limit(sample).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    return train(rows["text"].combine_chunks(), rows["lang"].to_pylist(), families)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, family, language, margin`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, language, margin = model.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(margin)], ["doc_id", "family", "language", "margin"])

    return docs.select(whole("doc_id"), "text").mapInArrow(run, "doc_id long, family string, language string, margin double")
