"""Quality rules: an isolation forest on rule statistics.

Every document gets the statistics in ``RULES``. The rows labelled good say how far
each may go (``allowance``); a forest of random splits, fitted on the excess over
that in all labelled rows, each tree on ``SUBSAMPLE`` of them as the method has it,
says by mean path length how easily it isolates a document; the threshold on that
score comes from the labels of all labelled rows.

A null text, an empty one and one without any word are rejected outright. Very
long texts are read whole. Ties in the score share one decision, as do repeated
rows. Without labelled rows nothing is known to be anomalous and every other
document stays. Further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .text import mix, prefix_hash, slices, span_hash, sums, whole

RULES = ("symbols_per_word", "capital_words", "digits_per_byte", "repeated_neighbours", "most_frequent_word", "bytes_per_word", "short_words", "marks_per_word", "bars_per_word", "repeated_lines")
#: A statistic counts by what it has beyond this centile of the good rows, taken so many times as far from their median.
CENTILE, MARGIN = 99.8, 3.0
TREES, SUBSAMPLE = 150, 256
#: A rejected good row weighs as much as so many bad rows let through.
COST_OF_GOOD = 20.0
#: Words by which the shares of a short document are drawn to zero.
PRIOR = 8.0

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[]\\^`{}~|/"]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "!?;:"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def _most_frequent(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: how often its most frequent key occurs, and how many keys repeat an earlier one."""
    most, again = np.zeros(n), np.zeros(n)
    both = (doc.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
    both.sort()
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(both)))
    owner = (both[at] >> np.uint64(40)).astype(np.int64)
    np.maximum.at(most, owner, count)
    np.add.at(again, owner, count - 1)
    return most, again


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rule statistics, a row for each document, and its number of words."""
    out, words = np.zeros((len(column), len(RULES))), np.zeros(len(column), dtype=np.int64)
    for part in slices(column, lower=False):
        data, n = part.data, len(part)
        bounds = np.append(part.start, len(data))
        start, end, first = part.words()
        count = np.diff(first)
        doc = np.repeat(np.arange(n), count)
        prefix = prefix_hash(data)
        word = span_hash(prefix, start, end)
        of_bytes = lambda kind: sums(kind[data], bounds)
        upper, lower = np.append(0, np.cumsum(_UPPER[data])), np.append(0, np.cumsum(_LOWER[data]))
        capital = (upper[end] - upper[start] > 1) & (lower[end] == lower[start])
        same = np.zeros(len(word), dtype=bool)
        same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        most, _ = _most_frequent(doc, word, n)
        # lines: between line feeds, of more than two words' length
        breaks = np.flatnonzero(data == 10)
        line_start = np.unique(np.concatenate([part.start[part.end > part.start], breaks + 1]))
        line_start = line_start[line_start < len(data)]
        line_end = np.append(line_start[1:], len(data)) if len(line_start) else line_start
        line_end = np.where((line_end > 0) & (data[np.maximum(line_end - 1, 0)] == 10), line_end - 1, line_end) if len(data) else line_end
        keep = line_end - line_start > 20
        line_doc = np.searchsorted(part.start, line_start[keep], "right") - 1
        _, again = _most_frequent(line_doc, span_hash(prefix, line_start[keep], line_end[keep]), n)
        lines = np.bincount(line_doc, minlength=n)
        size = np.maximum(part.end - part.start, 1)
        share = 1 / (count + PRIOR)
        columns = (
            of_bytes(_SYMBOL) * share,
            sums(capital, first) * share,
            of_bytes(_DIGIT) / (size + 6 * PRIOR),
            sums(same, first) * share,
            np.maximum(most - 2, 0) * share,
            (sums(end - start, first) + 5 * PRIOR) * share,
            sums(end - start <= 3, first) * share,
            of_bytes(_MARK) * share,
            sums(data == ord("|"), bounds) * share,
            again / (lines + 3),
        )
        rows = slice(part.first, part.first + n)
        out[rows], words[rows] = np.column_stack(columns), count
    return out, words


def allowance(rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How much good rows may have of each statistic; nothing if there are none."""
    if not good.any():
        return np.zeros(len(RULES))
    middle, far = np.median(rows[good], axis=0), np.percentile(rows[good], CENTILE, axis=0)
    return middle + MARGIN * (far - middle)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees as arrays; a leaf's rule is -1 and its value the path length."""

    rule: np.ndarray
    value: np.ndarray
    depth: int
    norm: float
    threshold: float = np.inf
    allowed: np.ndarray | None = None

    def excess(self, statistics: np.ndarray) -> np.ndarray:
        return statistics if self.allowed is None else np.maximum(statistics - self.allowed, 0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / that of a random search): near 1 is anomalous."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for rule, value in zip(self.rule, self.value, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                at = rule[node]
                inner = at >= 0
                right = rows[every, np.maximum(at, 0)] >= value[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += value[node]
        return 2.0 ** (-total / len(self.rule) / self.norm) if len(self.rule) else np.zeros(len(rows))


def fit_forest(rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 0) -> Forest:
    """Random rule and random cut between its extremes, until rows are alone or the depth is that of a balanced tree."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(rows))
    return _grown((rows[rng.choice(len(rows), size, replace=False)] for _ in range(trees)), size, trees, rng)


def _grown(samples: Iterable[np.ndarray], size: int, trees: int, rng: np.random.Generator) -> Forest:
    """A tree for each of the samples, of ``size`` rows each."""
    depth = int(np.ceil(np.log2(max(size, 2))))
    nodes = 2 ** (depth + 1) - 1
    rules, values = np.full((trees if size else 0, nodes), -1, dtype=np.int16), np.zeros((trees if size else 0, nodes))
    for t, rows in zip(range(len(rules)), samples):
        todo = [(0, 0, np.arange(size))]
        while todo:
            node, level, of = todo.pop()
            low, high = rows[of].min(axis=0) if len(of) else 0, rows[of].max(axis=0) if len(of) else 0
            can = np.flatnonzero(np.asarray(high) > np.asarray(low)) if len(of) > 1 else []
            if level == depth or not len(can):
                values[t, node] = level + _mean_path(len(of))
                continue
            rule = rng.choice(can)
            cut = rng.uniform(low[rule], high[rule])
            rules[t, node], values[t, node] = rule, cut
            right = rows[of, rule] >= cut
            todo += [(2 * node + 1, level + 1, of[~right]), (2 * node + 2, level + 1, of[right])]
    return Forest(rules, values, depth, float(_mean_path(size)) or 1.0)


def calibrate(score: np.ndarray, good: np.ndarray, cost: float = COST_OF_GOOD) -> float:
    """The cut, midway between two scores, that maximises rejected bad rows less ``cost`` times rejected good ones (as shares); infinite if none is worth it."""
    s, at = np.unique(score, return_inverse=True)  # ties are rejected together
    n = np.bincount(at, weights=good, minlength=len(s))
    return _cut(s, n, np.bincount(at, minlength=len(s)) - n, cost)


def _cut(score: np.ndarray, good: np.ndarray, bad: np.ndarray, cost: float = COST_OF_GOOD) -> float:
    """``calibrate`` from different scores, and how many good and bad rows have each."""
    if not good.sum() or not bad.sum():
        return np.inf
    order = np.argsort(-score)
    s, g, b = score[order], good[order], bad[order]
    gain = np.cumsum(b) / b.sum() - cost * np.cumsum(g) / g.sum()
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return np.inf
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else -np.inf


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """``text`` and ``label`` of at most ``sample`` labelled rows, the first in the order of a hash; the largest label counts where a document has several, and each row of a repeated ``doc_id`` counts."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("__id"), F.col(label).alias("__label"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(whole("doc_id"), "text", F.col("__label").alias("label"))
    # a table may have more rows than ids
    return rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(sample)


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, _ = statistics(batch.column(1))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(RULES)), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values, batch.column(2).cast(pa.int32())], ["doc_id", "rules", "label"])


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> DataFrame:
    """``doc_id, rules, label`` of all labelled rows, or of at most ``sample``; a document's largest label counts. No text is shuffled for all."""
    kind = "doc_id long, rules array<double>, label int"
    if sample is not None:
        return labelled_sample(docs, labels, "quality", sample).mapInArrow(_statistics_batches, kind)
    chosen = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg((F.max("quality") > 0).cast("int").alias("label"))
    rows = docs.select(whole("doc_id"), "text", F.lit(0)).where("doc_id is not null").mapInArrow(_statistics_batches, kind).drop("label")
    return rows.join(chosen, F.col("doc_id") == F.col("__id")).select("doc_id", "rules", "label")


def _allowance(rows: DataFrame) -> np.ndarray:
    """``allowance`` of a table, from the order of all good rows: narrow rows, a task for each statistic."""
    n = rows.where("label > 0").count()
    if not n:
        return allowance(np.zeros((0, len(RULES))), np.zeros(0, bool))
    at = [(n - 1) * q for q in (0.5, CENTILE / 100)]
    wanted = sorted({int(f(x)) for x in at for f in (np.floor, np.ceil)})
    values = rows.where("label > 0").select(F.posexplode("rules").alias("rule", "value")).groupBy("rule", "value").agg(F.count("*").alias("n"))
    last = F.sum("n").over(Window.partitionBy("rule").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("last", last).where(" or ".join(f"{k} >= last - n and {k} < last" for k in wanted))
    found = {(r.rule, k): r.value for r in values.collect() for k in wanted if r.last - r.n <= k < r.last}
    of = lambda rule, x: found[rule, int(np.floor(x))] + (x % 1) * (found[rule, int(np.ceil(x))] - found[rule, int(np.floor(x))])
    middle, far = (np.array([of(rule, x) for rule in range(len(RULES))]) for x in at)
    return middle + MARGIN * (far - middle)


def _draw_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tree the rows with the least hashes, as many as its sample has at most."""
    keys, held = [np.zeros((TREES, 0), np.uint64)], [np.zeros((0, len(RULES)))]
    tree = np.arange(1, TREES + 1, dtype=np.uint64)[:, None] << np.uint64(40)

    def least() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, rows = np.concatenate(keys, axis=1), np.concatenate(held)
        at = np.argsort(key, axis=1, kind="stable")[:, :SUBSAMPLE]
        return key, rows, at

    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            keys.append(mix(mix(part.column(0).to_numpy().view(np.uint64)) + tree))
            held.append(part.column(1).flatten().to_numpy().reshape(-1, len(RULES)))
            key, rows, at = least()
            used = np.unique(at)
            keys, held = [key[:, used]], [rows[used]]
    key, rows, at = least()
    for t in range(TREES):
        values = pa.ListArray.from_arrays(pa.array(np.arange(at.shape[1] + 1, dtype=np.int32) * len(RULES)), pa.array(rows[at[t]].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(at.shape[1], t, np.int32)), pa.array(key[t, at[t]].view(np.int64)), values], ["tree", "key", "rules"])


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Forest:
    """The forest and its threshold, from all labelled rows (``labels``: doc_id, quality 0 or 1), or from at most ``sample``.

    The driver gets each tree's ``SUBSAMPLE`` rows, and how many good and bad rows have each score.
    """
    rows = stored(labelled_statistics(docs, labels, sample), "statistics")
    allowed = _allowance(rows)
    drawn = rows.select(F.xxhash64("doc_id", "rules", "label"), "rules").mapInArrow(_draw_batches, "tree int, key long, rules array<double>")
    drawn = drawn.withColumn("n", F.row_number().over(Window.partitionBy("tree").orderBy("key", "rules"))).where(F.col("n") <= SUBSAMPLE).toPandas().sort_values(["tree", "n"])
    samples = [np.maximum(np.stack(g["rules"]) - allowed, 0) for _, g in drawn.groupby("tree")]
    forest = _grown(samples, len(samples[0]) if samples else 0, TREES, np.random.default_rng(0))
    forest.allowed = allowed

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(RULES))
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(forest.excess(x))), batch.column(1)], ["score", "label"])

    counts = rows.select("rules", "label").mapInArrow(scored, "score double, label int").groupBy("score").agg(F.count_if(F.col("label") > 0).alias("good"), F.count_if(F.col("label") <= 0).alias("bad")).toPandas()
    forest.threshold = _cut(*(counts[c].to_numpy() for c in ("score", "good", "bad")))
    return forest


def _judge(forest: Forest, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows, words = statistics(column)
    score = forest.score(forest.excess(rows))
    return score, (score <= forest.threshold) & (words > 0)


def kept_scores(docs: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id, score`` of every document that isn't rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, keep = _judge(forest, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"]).filter(pa.array(keep))

    return docs.select(whole("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, forest: Forest) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_judge(forest, batch.column(at))[1]))

    return docs.mapInArrow(run, docs.schema)
