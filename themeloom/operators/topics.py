"""Topics over vectors and labels: centroids, soft assignment, editing, summaries.

Labels are ``id, topic`` with -1 for outliers; vectors ``id, v``; centroids
``topic, centroid``; probabilities ``id, topic, prob``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import mapped, matrix, summed, unit, vectors_of
from ..functions.vectors import cosine
from .graphs import knn

OUTLIER = -1


Centers = tuple[np.ndarray, np.ndarray]  # topics in order, and a row for each


def _width(vectors: DataFrame) -> int:
    row = vectors.where("v is not null").select(F.size("v").alias("n")).first()
    return row.n if row else 0


def centers_of(centers: DataFrame) -> Centers:
    """Centroids on the driver: a row for each topic."""
    rows = centers.orderBy("topic").collect()
    return np.array([r.topic for r in rows], np.int64), np.array([r.centroid for r in rows], float) if rows else np.zeros((0, 0))


def centroids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """The mean vector of every topic but the outliers. Each task sums up its own rows by topic, and only those sums are moved."""
    dims = _width(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: Counter[int] = Counter()
        for batch in batches:
            topics, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_inverse=True)
            sums = np.zeros((len(topics), dims))
            np.add.at(sums, at, matrix(batch.column(1), dims))
            for t, x, n in zip(topics.tolist(), sums, np.bincount(at, minlength=len(topics)).tolist(), strict=True):
                total[t] = total[t] + x if t in total else x
                count[t] += n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([count[t] for t in total], pa.int64()), vectors_of(np.stack(list(total.values())))], ["topic", "n", "total"])

    rows = vectors.where("v is not null").join(labels.where(F.col("topic") != OUTLIER), "id").select(F.col("topic").cast("int").alias("topic"), "v")
    parts = summed(rows.mapInArrow(run, "topic int, n long, total array<double>"), "topic", "int")
    return parts.select("topic", F.transform("total", lambda x: x / F.col("n")).alias("centroid"))


def refine(vectors: DataFrame, labels: DataFrame, blend: float = 0.2) -> DataFrame:
    """Vectors pulled towards their topic's centroid, by the root of their cosine with it; all are then scaled to length 1."""
    topics, center = centers_of(centroids(vectors, labels))
    dims = _width(vectors)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column(1), dims)
        topic = batch.column(2).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(topics, topic), max(len(topics) - 1, 0))
        has = topics[at] == topic if len(topics) else np.zeros(len(x), bool)
        c = center[at[has]]
        pull = blend * np.sqrt(np.clip((unit(x[has]) * unit(c)).sum(axis=1, keepdims=True), 0, 1))
        x[has] = (1 - pull) * x[has] + pull * c
        return pa.RecordBatch.from_arrays([batch.column(0), vectors_of(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10))], ["id", "v"])

    rows = vectors.join(labels, "id", "left").select("id", "v", F.coalesce(F.col("topic").cast("long"), F.lit(OUTLIER)).alias("topic"))
    return mapped(rows, run, f"id {dict(vectors.dtypes)['id']}, v array<double>")


def _scored(vectors: DataFrame, centers: DataFrame, run: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``run`` on ids, topics and cosines of every batch: one matrix product with the centroids, no shuffle."""
    topics, center = centers_of(centers)
    known = unit(center)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return run(batch.column(0), topics, unit(matrix(batch.column(1), known.shape[1])) @ known.T if len(topics) else np.zeros((batch.num_rows, 0)))

    return mapped(vectors.select("id", "v"), each, f"id {dict(vectors.dtypes)['id']}, {schema}")


def _long(ids: pa.Array, topics: np.ndarray, value: np.ndarray, name: str) -> pa.RecordBatch:
    rows = ids.take(pa.array(np.repeat(np.arange(len(ids)), len(topics))))
    return pa.RecordBatch.from_arrays([rows, pa.array(np.tile(topics, len(ids)).astype(np.int32)), pa.array(value.ravel())], ["id", "topic", name])


def similarities(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """``id, topic, cos`` for every row and topic."""
    return _scored(vectors, centers, lambda ids, topics, cos: _long(ids, topics, cos, "cos"), "topic int, cos double")


def soft(vectors: DataFrame, centers: DataFrame, temperature: float = 5.0) -> DataFrame:
    """``id, topic, prob``: a softmax of the cosines with all topics."""

    def run(ids: pa.Array, topics: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
        raw = np.exp(temperature * (cos - cos.max(axis=1, keepdims=True))) if len(topics) else cos
        return _long(ids, topics, raw / raw.sum(axis=1, keepdims=True) if len(topics) else raw, "prob")

    return _scored(vectors, centers, run, "topic int, prob double")


def nearest(topics: np.ndarray, cos: np.ndarray, threshold: float) -> tuple[pa.Array, pa.Array]:
    """Topic and cosine of the best of each row, or -1 below the threshold; ties go to the lower topic, and without topics there is no cosine."""
    if not len(topics):
        return pa.array(np.full(len(cos), OUTLIER, np.int32)), pa.nulls(len(cos), pa.float64())
    at = cos.argmax(axis=1)
    best = cos[np.arange(len(cos)), at]
    return pa.array(np.where(best < threshold, OUTLIER, topics[at]).astype(np.int32)), pa.array(best)


def assign(vectors: DataFrame, centers: DataFrame, threshold: float = 0.35) -> DataFrame:
    """``id, topic, cos``: the nearest topic, or -1 where its cosine is below the threshold; ties go to the lower topic."""
    return _scored(vectors, centers, lambda ids, topics, cos: pa.RecordBatch.from_arrays([ids, *nearest(topics, cos, threshold)], ["id", "topic", "cos"]), "topic int, cos double")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").union(edges.select("dst", "src", "w"))


def graph_probabilities(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row's share of edge weight to every topic; uniform without any."""
    topics = labels.where(F.col("topic") != OUTLIER).select("topic").distinct()
    near = both_ways(edges).join(labels.where(F.col("topic") != OUTLIER).withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "topic").agg(F.sum("w").alias("w"))
    grid = labels.select("id").distinct().crossJoin(topics)
    by = Window.partitionBy("id")
    rows = grid.join(near, ["id", "topic"], "left").withColumn("w", F.coalesce("w", F.lit(0.0))).withColumn("sum", F.sum("w").over(by)).withColumn("n", F.count("*").over(by))
    return rows.select("id", "topic", F.when(F.col("sum") > 0, F.col("w") / F.col("sum")).otherwise(1 / F.col("n")).alias("prob"))


def document_topics(probabilities: DataFrame, doc_id: int | None = None, top_n: int = 3) -> DataFrame:
    """The likeliest topics of one document or, without an id, of all."""
    rows = probabilities if doc_id is None else probabilities.where(F.col("id") == doc_id)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("prob"), "topic"))).where(F.col("place") <= top_n)


def overlap(probabilities: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``a, b, n``: how many rows have both topics at ``threshold`` or more, for every pair of topics."""
    topics = probabilities.select("topic").distinct()
    # a row's active topics are few: pairs are made within the row
    active = probabilities.where(F.col("prob") >= threshold).groupBy("id").agg(F.collect_set("topic").alias("t"))
    pairs = active.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    grid = topics.withColumnRenamed("topic", "a").crossJoin(topics.withColumnRenamed("topic", "b"))
    return grid.join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def topic_similarity(centers: DataFrame) -> DataFrame:
    """``a, b, cos`` for every pair of topics."""
    other = centers.select(F.col("topic").alias("b"), F.col("centroid").alias("c2"))
    return centers.crossJoin(other).select(F.col("topic").alias("a"), "b", cosine(F.col("centroid"), F.col("c2")).alias("cos"))


def representatives(vectors: DataFrame, labels: DataFrame, n: int = 5) -> DataFrame:
    """``topic, id, place``: the rows nearest to their topic's mean (Euclidean); of the outliers, those with the lowest ids. Each task hands on its best n of a topic only."""
    topics, center = centers_of(centroids(vectors, labels))
    dims = _width(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            topic, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            apart = ids.astype(float)
            inside = np.flatnonzero(topic != OUTLIER)
            if len(inside):
                x = matrix(batch.column(2), dims)[inside]
                apart[inside] = np.linalg.norm(x - center[np.searchsorted(topics, topic[inside])], axis=1)
            topic, ids, apart = (np.concatenate(x) for x in zip(best, (topic, ids, apart), strict=True))
            order = np.lexsort((ids, apart, topic))
            first = np.searchsorted(topic[order], topic[order], "left")
            order = order[np.arange(len(order)) - first < n]
            best = (topic[order], ids[order], apart[order])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(best, (pa.int32(), pa.int64(), pa.float64()), strict=True)], ["topic", "id", "apart"])

    rows = vectors.where("v is not null").join(labels, "id").select(F.col("topic").cast("long").alias("topic"), F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "topic int, id long, apart double")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("apart", "id"))).where(F.col("place") <= n)


def adopt_by_centroid(vectors: DataFrame, labels: DataFrame, centers: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Outliers with a topic at cosine ``threshold`` or more join the nearest one."""
    found = assign(vectors.join(labels.where(F.col("topic") == OUTLIER), "id").select("id", "v"), centers, threshold).select("id", F.col("topic").alias("new"))
    return labels.join(found, "id", "left").select("id", F.coalesce("new", "topic").alias("topic"))


def adopt_by_neighbours(vectors: DataFrame, labels: DataFrame, k: int = 15) -> DataFrame:
    """Outliers take the commonest topic among their k nearest others that have one; ties go to the lower topic."""
    out = vectors.join(labels.where(F.col("topic") == OUTLIER), "id").select("id", "v")
    rest = vectors.join(labels.where(F.col("topic") != OUTLIER), "id").select("id", "v")
    votes = knn(rest, k, queries=out).join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "topic").agg(F.count("*").alias("n"))
    new = votes.groupBy("id").agg(F.max_by("topic", F.struct("n", -F.col("topic"))).alias("new"))
    return labels.join(new, "id", "left").select("id", F.coalesce("new", "topic").alias("topic"))


def merge(labels: DataFrame, topics: list[int]) -> DataFrame:
    """The topics become the largest of them; of equals, the one listed first. Ids that don't occur are ignored."""
    if len(topics) < 2:
        raise ValueError("merging takes two topics or more")
    sizes = {r.topic: r.n for r in labels.where(F.col("topic").isin(topics)).groupBy("topic").agg(F.count("*").alias("n")).collect()}
    keep = max(topics, key=lambda t: (sizes.get(t, 0), -topics.index(t)))
    return labels.withColumn("topic", F.when(F.col("topic").isin(topics), F.lit(keep)).otherwise(F.col("topic")).cast("int"))


def reduce_to(vectors: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Merges the most similar pair of topics until n are left; similarity is cosine times (smaller / larger size) to the power 0.3, and the smaller joins the larger.

    One job gives sums and sizes; the merging is arithmetic on as many rows as there are topics.
    """
    rows = centroids(vectors, labels).join(labels.groupBy("topic").agg(F.count("*").alias("n")), "topic").orderBy("topic").collect()
    if len(rows) <= max(n, 1):
        return labels
    ids, sizes = [r.topic for r in rows], np.array([r.n for r in rows], float)
    total = np.array([r.centroid for r in rows]) * sizes[:, None]
    into = {t: t for t in ids}
    while len(ids) > max(n, 1):
        mean = total / sizes[:, None]
        unit = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
        sim = unit @ unit.T
        np.fill_diagonal(sim, -1)
        sim *= (np.minimum.outer(sizes, sizes) / np.maximum.outer(sizes, sizes)) ** 0.3
        i, j = np.unravel_index(int(np.argmax(sim)), sim.shape)
        keep, gone = (j, i) if sizes[j] > sizes[i] else (i, j)
        total[keep] += total[gone]
        sizes[keep] += sizes[gone]
        into = {t: ids[keep] if x == ids[gone] else x for t, x in into.items()}
        total, sizes, ids = np.delete(total, gone, 0), np.delete(sizes, gone), [t for k, t in enumerate(ids) if k != gone]
    moves = labels.sparkSession.createDataFrame([(t, x) for t, x in into.items() if t != x], "topic int, new int")
    return labels.join(F.broadcast(moves), "topic", "left").select("id", F.coalesce("new", "topic").alias("topic"))


def drop_small(labels: DataFrame, least: int = 5) -> DataFrame:
    """Topics with fewer rows become outliers; the others are numbered from 0 in the order of their ids."""
    sizes = labels.where(F.col("topic") != OUTLIER).groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    number = sizes.withColumn("new", F.row_number().over(Window.orderBy("topic")) - 1).select("topic", "new")
    return labels.join(number, "topic", "left").select("id", F.coalesce("new", F.lit(OUTLIER)).cast("int").alias("topic"))


def over_time(rows: DataFrame, unit: str = "month") -> DataFrame:
    """``period, topic, n, share`` from ``ts, topic``: counts by calendar period, with zeros, and percent of the period."""
    counts = rows.where(F.col("topic").cast("string") != str(OUTLIER)).groupBy(F.date_trunc(unit, "ts").alias("period"), "topic").agg(F.count("*").alias("n"))
    grid = counts.select("period").distinct().crossJoin(counts.select("topic").distinct())
    rows = grid.join(counts, ["period", "topic"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("period")))


def label_collisions(names: DataFrame) -> DataFrame:
    """``prefix, topics`` of labels (``topic, label``) that begin with the same three words, in any case."""
    prefix = F.array_join(F.slice(F.split(F.lower(F.trim("label")), r"\s+"), 1, 3), " ")
    return names.groupBy(prefix.alias("prefix")).agg(F.sort_array(F.collect_list("topic")).alias("topics")).where(F.size("topics") > 1)


def parents(child: DataFrame, parent: DataFrame) -> DataFrame:
    """``topic, parent``: the topic of the coarser level that shares most rows; of equals, the one met first by id."""
    both = child.join(parent.select("id", F.col("topic").alias("parent")), "id").groupBy("topic", "parent").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return both.groupBy("topic").agg(F.max_by("parent", F.struct("n", -F.col("first"))).alias("parent"))
