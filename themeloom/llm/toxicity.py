"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is judged by its runs of as many words as ``RUNS`` says, each word beginning
one, so that an insult or a toxic phrase counts the same in a short text and in a
very long one: its probability is that of its worst run. Each run is the average
of the embeddings of its character n-grams, and a linear softmax over two classes
follows, one for each length of runs over the same embeddings; all are trained
jointly in numpy by gradient descent. A misspelling that was never seen shares most
of its n-grams with what was. Labels are per document: for each length, a toxic
document trains with the run that the model so far finds worst (at first the one
with the n-grams that toxic documents have most often compared with clean ones) and
with others that it finds toxic, a clean one with its worst run and others drawn at
random. A text with fewer words than a run is one shorter run.

All labelled rows count. One in ``HELD_OUT``, by a hash, is held out and sets the
threshold; the others are dealt by a hash to parts that a task can hold, of about
``PART_ROWS`` rows or ``PART_BYTES`` bytes, and each part trains embeddings and
softmaxes. As a score is linear in the n-grams, the model is the mean of the parts'
scores of each n-gram, over the parts that have met it. A part without one of the
classes could learn nothing, so rows of a rare class go to several parts.

Null and empty texts and those without any word have probability 0. Texts are
read whole. Repeated rows are judged alike; ties in probability share one
decision. Without labelled rows of both classes nothing is found toxic. Other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .quality import COST_OF_GOOD, _cut, labelled_sample
from .store import stored
from .subwords import bounded_words, ngrams, word_scores
from .text import prefix_hash, slices, span_hash, sums, whole

RUNS, SIZES, BITS, DIM = (1, 4), (3, 4, 5, 6), 18, 10
EPOCHS, RATE, BATCH = 12, 0.2, 256
#: Training rows and their bytes of text in a part, about, and rows of each class in it at least, about.
PART_ROWS, PART_BYTES, PART_CLASS = 2_500, 6 << 20, 20
#: A run averages over so many n-grams at least, so that a short word isn't judged by a few.
LEAST = 15
#: One labelled row in so many is held out for the threshold.
HELD_OUT = 4
#: Bits of the map of ids that may have a label, at most: with more ids than a sixteenth of them, more texts are moved.
MAP_BITS = 27
#: Rows of the table of n-grams that a row of a Spark table has.
CHUNK = 1 << 12


@dataclass
class Model:
    """table: for each n-gram row, the difference of the two classes' scores, a column for each length of runs; bias: one for each length; seen: which rows the training texts have."""

    table: np.ndarray
    bias: np.ndarray
    threshold: float = np.inf
    seen: np.ndarray | None = None

    def probability(self, column: pa.Array) -> np.ndarray:
        """The probability of the worst run of each text."""
        out = np.zeros(len(column))
        for part in slices(column):
            data, offset, index, first = bounded_words(part)
            if not len(index):
                continue
            score, count = word_scores(data, offset, SIZES, BITS, self.table)
            has = np.flatnonzero(np.diff(first))
            worst = np.full(len(has), -np.inf)
            size = np.append(0, np.cumsum(count[index]))
            for k, run in enumerate(RUNS):
                total = np.append(0.0, np.cumsum(score[index, k]))
                end = run_ends(first, run)
                begin = np.arange(len(index))
                logit = (total[end] - total[begin]) / np.maximum(size[end] - size[begin], LEAST) + self.bias[k]
                logit[short_runs(first, run)] = -np.inf
                worst = np.maximum(worst, np.maximum.reduceat(logit, first[:-1][has]))
            out[part.first + has] = 1 / (1 + np.exp(-np.clip(worst, -700, 700)))
        return out


def run_ends(first: np.ndarray, run: int) -> np.ndarray:
    """Where the run that begins at each word ends, within its document."""
    count = np.diff(first)
    return np.minimum(np.arange(first[-1]) + run, np.repeat(first[1:], count))


def short_runs(first: np.ndarray, run: int) -> np.ndarray:
    """The words too near to the end of their document for a run of their own, other than the first of a document."""
    begin = np.arange(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - begin
    return np.flatnonzero((left < run) & (begin > np.repeat(first[:-1], np.diff(first))))


def _vocabulary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All distinct words' n-gram rows side by side with their bounds, every word of the texts by number, the bounds in it of the texts that have words, and those texts' numbers."""
    data_of, size_of, index_of, count_of, words = [], [], [], [], 0
    for part in slices(column):
        data, offset, index, first = bounded_words(part)
        data_of.append(data)
        size_of.append(np.diff(offset))
        index_of.append((index + words).astype(np.int32))
        count_of.append(np.diff(first))
        words += len(offset) - 1
    if not words:
        return (np.zeros(0, np.int64),) * 5
    data, offset = np.concatenate(data_of), np.append(0, np.cumsum(np.concatenate(size_of)))
    # a word has been met once in each slice that has it
    _, one, number = np.unique(span_hash(prefix_hash(data), offset[:-1], offset[1:]), return_index=True, return_inverse=True)
    size = np.diff(offset)[one]
    at = np.repeat(offset[:-1][one], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    rows, word = ngrams(data[at], np.append(0, np.cumsum(size)), SIZES, BITS)
    order = np.argsort(word, kind="stable")
    begin = np.searchsorted(word[order], np.arange(len(one) + 1))
    count = np.concatenate(count_of)
    return rows[order].astype(np.int32), begin, number.astype(np.int32)[np.concatenate(index_of)], np.append(0, np.cumsum(count[count > 0])), np.flatnonzero(count)


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begin[i], ..., end[i] - 1 for each i, and their numbers."""
    n = end - begin
    return np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), n


def _spread(begin: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places begin[i], ..., begin[i + 1] - 1 for each picked i, and their numbers."""
    return _ranges(begin[pick], begin[pick + 1])


def train(column: pa.Array, toxic: np.ndarray, seed: int = 0) -> Model:
    """Joint training of embeddings and softmax on runs, with labels by document."""
    rows, begin, index, first, text = _vocabulary(column)
    if not len(index) or not toxic[text].any() or toxic[text].all():
        return Model(np.zeros((1 << BITS, len(RUNS)), np.float32), np.zeros(len(RUNS)))
    toxic = toxic[text]
    grams = np.diff(begin)
    size = np.append(0, np.cumsum(grams[index]))
    ends = [run_ends(first, run).astype(np.int32) for run in RUNS]
    short = [short_runs(first, run) for run in RUNS]
    room = [np.maximum(size[end] - size[:-1], LEAST).astype(np.float32) for end in ends]
    label = np.repeat(toxic, np.diff(first))

    # first guess: by how much more often toxic documents have an n-gram
    pairs = np.unique(np.repeat(np.arange(len(text)), np.diff(first)) << 32 | index)
    odds = np.zeros(1 << BITS)
    for sign, t, some in ((1, True, 0.1), (-1, False, 1.0)):
        docs = np.bincount(pairs[toxic[pairs >> 32] == t] & 0xFFFFFFFF, minlength=len(grams))
        with_ = np.minimum(np.bincount(rows, weights=np.repeat(docs, grams), minlength=1 << BITS), (toxic == t).sum())
        odds += sign * np.log((with_ + some) / ((toxic == t).sum() + 1))
    del pairs
    guess = np.append(0.0, np.cumsum(np.maximum.reduceat(odds[rows], begin[:-1])[index]))

    rng = np.random.default_rng(seed)
    embed = rng.uniform(-0.5 / DIM, 0.5 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weight, bias = rng.uniform(-1, 1, (len(RUNS), DIM, 2)).astype(np.float32), np.zeros((len(RUNS), 2), np.float32)
    squares = np.full(1 << BITS, 1e-6, np.float32)  # AdaGrad, a rate for each row

    def chosen(k: int, epoch: int) -> tuple[np.ndarray, np.ndarray]:
        """The words at which the toxic and the clean runs of one length begin that an epoch trains on."""
        if epoch:
            linear = (embed @ (weight[k, :, 1] - weight[k, :, 0])).astype(np.float64)
            total = np.append(0.0, np.cumsum(sums(linear[rows], begin)[index]))
            logit = ((total[ends[k]] - total[:-1]) / room[k]).astype(np.float32)
        else:
            logit = ((guess[ends[k]] - guess[:-1]) / (ends[k] - np.arange(len(index)))).astype(np.float32)
        logit[short[k]] = -np.inf
        best = np.flatnonzero(logit == np.repeat(np.maximum.reduceat(logit, first[:-1]), np.diff(first)))
        owner = np.searchsorted(first, best, "right")
        best = best[np.append(True, owner[1:] != owner[:-1])]  # a document's first of its worst
        positive, negative = best[label[best]], best[~label[best]]
        if epoch:  # and whatever else the model is sure of, for the runs that are never the worst
            positive = np.union1d(positive, np.flatnonzero(label & (logit + bias[k, 1] - bias[k, 0] > 0)))
        others = np.flatnonzero(~label & np.isfinite(logit))
        return positive, np.union1d(negative, rng.choice(others, min(len(others), 2 * len(text)), replace=False))

    for epoch in range(EPOCHS):
        use, kind, cost = [], [], []
        for k in range(len(RUNS)):
            positive, negative = chosen(k, epoch)
            use += [positive, negative]
            kind.append(np.full(len(positive) + len(negative), k))
            cost += [np.full(len(positive), max(1.0, 0.5 * len(negative) / len(positive)), np.float32), np.ones(len(negative), np.float32)]
        use, kind, cost = (np.concatenate(x) for x in (use, kind, cost))
        order = rng.permutation(len(use))
        for i in range(0, len(use), BATCH):
            at = order[i : i + BATCH]
            pick, of_kind, each = use[at], kind[at], cost[at]
            end, n = np.choose(of_kind, [e[pick] for e in ends]), np.choose(of_kind, [r[pick] for r in room])
            where, words = _ranges(pick, end)
            of_word, grams_of = _spread(begin, index[where])
            bag, count = rows[of_word], sums(grams_of, np.append(0, np.cumsum(words)))
            of = np.repeat(np.arange(len(pick)), count)
            mean = np.add.reduceat(embed[bag], np.cumsum(count) - count, axis=0) / n[:, None]
            z = np.einsum("ij,ijk->ik", mean, weight[of_kind]) + bias[of_kind]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), label[pick].astype(int)] -= 1
            p *= each[:, None] / each.sum()
            back = np.einsum("ik,ijk->ij", p, weight[of_kind])
            for k in range(len(RUNS)):
                mine = of_kind == k
                weight[k] -= RATE * mean[mine].T @ p[mine]
                bias[k] -= RATE * p[mine].sum(axis=0)
            unique, place = np.unique(bag, return_inverse=True)
            step = np.stack([np.bincount(place, weights=back[of, d] / n[of], minlength=len(unique)) for d in range(DIM)], axis=1).astype(np.float32)
            squares[unique] += (step**2).mean(axis=1)
            embed[unique] -= RATE * step / np.sqrt(squares[unique, None])
    return Model(np.stack([embed @ (w[:, 1] - w[:, 0]) for w in weight], axis=1), (bias[:, 1] - bias[:, 0]).astype(float), seen=np.bincount(rows, minlength=1 << BITS) > 0)


def _possible(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of all documents that are among ``ids`` (``__id``), and of few others, so that texts needn't be moved to find the rest."""
    bits = min(MAP_BITS, max(13, int(16 * ids.count()).bit_length()))
    at = lambda column: F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            marks = np.zeros((len(chunks), 1 << 13), dtype=bool)
            marks[of, batch.column(1).to_numpy()] = True
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())], ["chunk", "bits"])

    where = at(F.col("__id"))
    rows = ids.select(F.shiftright(where, 13).cast("int").alias("chunk"), where.bitwiseAND(F.lit((1 << 13) - 1)).cast("int").alias("at"))
    known = np.zeros((1 << bits - 13, 1 << 10), dtype=np.uint8)
    for r in rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(packed, "chunk int, bits binary").collect():
        known[r["chunk"]] |= np.frombuffer(r["bits"], np.uint8)
    known = known.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy()
            yield batch.select(["doc_id", "text"]).filter(pa.array((known[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)))

    rows = docs.select(whole("doc_id"), "text").where("doc_id is not null").withColumn("at", at(F.col("doc_id")))
    return rows.mapInArrow(run, "doc_id long, text string")


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part (rows in order of part), the scores of the n-grams that it has met and, as chunk -1, its biases; with how often to count them."""

    def trained(part: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        model = train(table["text"], table["toxic"].to_numpy())
        seen = model.seen if model.seen is not None else np.zeros(len(model.table), bool)
        values = np.column_stack([np.where(seen[:, None], model.table, 0), seen]).astype(np.float64).reshape(-1, CHUNK * (len(RUNS) + 1))
        chunks = [np.append(model.bias, 1.0) * seen.any(), *values]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(chunks), part, np.int32)), pa.array(np.arange(-1, len(values), dtype=np.int32)), pa.array(chunks, pa.list_(pa.float32()))], ["part", "chunk", "values"])

    now, held = -1, []
    for batch in batches:
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and part[i] != now:
                yield trained(now, held)
                held = []
            now = int(part[i])
            held.append(batch.slice(i, j - i).select(["text", "toxic"]))
    if held:
        yield trained(now, held)


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each chunk over the parts, added in their order."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = values.values.to_numpy().astype(np.float64)
            total[chunk] = total[chunk] + values if chunk in total else values
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["chunk", "values"])


def _trained(rows: DataFrame, size: list) -> Model:
    """The model of ``doc_id, text, toxic``, of which ``size`` has the number and bytes by class: the mean of what the parts have learnt."""
    count = {r.toxic: r.n for r in size}
    if len(count) < 2:
        return Model(np.zeros((1 << BITS, len(RUNS)), np.float32), np.zeros(len(RUNS)))
    parts = max(1, -(-sum(count.values()) // PART_ROWS), -(-sum(r.bytes or 0 for r in size) // PART_BYTES))
    times = {toxic: min(parts, -(-PART_CLASS * parts // n)) for toxic, n in count.items()}
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("toxic"), times[True]).otherwise(times[False]) - 1))
    dealt = rows.withColumn("copy", copy).select(F.pmod(F.shiftright(F.xxhash64("doc_id", "text"), 8) + F.col("copy"), F.lit(parts)).cast("int").alias("part"), "doc_id", "text", "toxic")
    dealt = dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", "doc_id", "text").select("part", "text", "toxic")
    learnt = dealt.mapInArrow(_train_batches, "part int, chunk int, values array<float>")
    summed = learnt.repartition("chunk").sortWithinPartitions("chunk", "part").select("chunk", "values").mapInArrow(_sum_batches, "chunk int, values array<double>")
    values = {r["chunk"]: np.array(r["values"]) for r in summed.toArrow().to_pylist()}
    bias, table = values.pop(-1), np.concatenate([values[k] for k in sorted(values)]).reshape(1 << BITS, -1)
    return Model((table[:, :-1] / np.maximum(table[:, -1:], 1)).astype(np.float32), bias[:-1] / max(bias[-1], 1))


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """The rows with ``score`` instead of ``text``."""
    at, others = rows.columns.index("text"), [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.probability(batch.column(at))), *(batch.column(c) for c in others)], ["score", *others])

    return rows.mapInArrow(run, StructType([StructField("score", DoubleType()), *(rows.schema[c] for c in others)]))


def _threshold(scores: DataFrame) -> float:
    """``calibrate`` of all the rows ``score, toxic``."""
    scores = stored(scores.select("score", "toxic"), "scores")
    # below a score that more than one in COST_OF_GOOD good rows has, no cut is worth it, so those scores are one
    low = scores.where("not toxic").agg(F.percentile_approx("score", 1 - 1.2 / COST_OF_GOOD, 10_000).alias("low")).first().low
    score = F.when(F.col("score") < F.lit(low), -1.0).otherwise(F.col("score"))
    counts = scores.groupBy(score.alias("score")).agg(F.count_if(~F.col("toxic")).alias("good"), F.count_if("toxic").alias("bad")).toPandas()
    return _cut(*(counts[c].to_numpy() for c in ("score", "good", "bad")))


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> Model:
    """The model and its threshold from all labelled rows (``labels``: doc_id, toxic 0 or 1), or from at most ``sample``.

    A document's largest label counts, and each row of a repeated ``doc_id``. The
    driver gets the model, which ids may have a label (``MAP_BITS``), and how many good
    and bad held-out rows have each of the higher scores.
    """
    toxic = (F.col("label") > 0).alias("toxic")
    if sample is not None:
        rows = stored(labelled_sample(docs, labels, "toxic", sample).select("doc_id", "text", toxic), "labelled")
        labelled = lambda x: x
    else:
        chosen = labels.where("toxic is not null").select(whole("doc_id"), "toxic").where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("label"))
        chosen = stored(chosen.select("__id", toxic), "labels")
        rows = _possible(docs, chosen)
        labelled = lambda x: x.join(chosen.hint("merge"), F.col("doc_id") == F.col("__id")).drop("__id")
    held = F.pmod(F.xxhash64("doc_id", "text"), F.lit(HELD_OUT)) == 0
    size = labelled(rows.where(~held).withColumn("bytes", F.octet_length("text")).drop("text")).groupBy("toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
    model = _trained(labelled(rows.where(~held)).select("doc_id", "text", "toxic"), size)
    model.threshold = _threshold(labelled(_scored(rows.where(held), model)))
    return model


def toxic_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, toxicity`` of every document whose probability exceeds the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "toxicity"]).filter(pa.array(p > model.threshold))

    return docs.select(whole("doc_id"), "text").mapInArrow(run, "doc_id long, toxicity double")
