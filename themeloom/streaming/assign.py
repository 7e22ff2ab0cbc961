"""Topics of documents that arrive on a stream."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions.blocks import mapped, matrix, unit
from ..operators.topics import OUTLIER, nearest


def assigned(vectors: DataFrame, centers: list[tuple[int, list[float]]], threshold: float = 0.35) -> DataFrame:
    """The rows with ``topic, cos``, without state or shuffle; the topics' centroids, of which there are few, go to every task.

    Works alike on a stream and a table. Without centroids every row is an outlier.
    """
    centers = sorted(centers)
    topics, known = np.array([t for t, _ in centers], np.int64), unit(np.array([c for _, c in centers], float) if centers else np.zeros((0, 0)))
    at = vectors.columns.index("v")
    schema = StructType([*vectors.schema.fields, StructField("topic", IntegerType()), StructField("cos", DoubleType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cos = unit(matrix(batch.column(at), known.shape[1])) @ known.T if len(topics) else np.zeros((batch.num_rows, 0))
        return pa.RecordBatch.from_arrays([*batch.columns, *nearest(topics, cos, threshold)], schema.names)

    return mapped(vectors, run, schema)


def counts_over_time(rows: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``period, topic, n`` of a stream of ``ts, topic``, with rows up to ``late`` behind."""
    by = rows.where(F.col("topic") != OUTLIER).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "topic")
    return by.agg(F.count("*").alias("n")).select(F.col("w.start").alias("period"), "topic", "n")
