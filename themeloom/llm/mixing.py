"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a budget of tokens: its share of the target weights times the
total. A budget that covers a source takes that many complete epochs of it. What
is left is filled by weighted sampling without replacement: every document draws
an exponential key, -ln(u) / weight, and the source's documents are taken in the
order of their keys for as long as the running sum of tokens stays within it.

The order is never sorted as a whole, however large one source is. Keys fall
into ``BINS`` ranges, tokens are summed by source and range, and that tells in
which range the budget ends; only the documents of that one range of each source
are sorted. Everything before it is taken and everything after it isn't.

u comes from a hash of seed and ``doc_id``, so a run can be repeated anywhere.
Null sources are a source of their own. A null or empty text has no tokens: it
comes with each complete epoch, and with the fraction if its key lies before the
cut. A null ``doc_id`` hashes as an empty one. Weights that are null, zero or
negative put a document behind all others. Equal keys are ordered by doc_id,
then tokens, then a hash of the text; repeated rows are documents of their own. Sources without a target
weight get ``other``; an empty table gives an empty result. Columns that are
called like the ones used here are safe: inner names begin with ``__``. A column
``epoch`` of the input comes back as ``__epoch``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

BINS = 4096
CHARS_PER_TOKEN = 4


def token_estimate(text: Column) -> Column:
    """Tokens of a text at four characters each, rounded up; 0 if there is none."""
    return F.coalesce(F.ceil(F.length(text) / CHARS_PER_TOKEN), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1]: the first 52 bits of the MD5 of ``seed:doc_id``, plus one, by 2**52."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def quality_weights(labels: DataFrame, good: float = 1.0, bad: float = 0.25) -> DataFrame:
    """``__id, __weight`` of the labelled documents; the largest label counts where there are several."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.when(F.max("quality") > 0, good).otherwise(bad).alias("__weight"))


def _keyed(docs: DataFrame, weights: DataFrame | None, unlabelled: float, seed: int, tokens: Column, tie: Column) -> DataFrame:
    """docs with ``__source, __tokens, __key, __bin, __hash``."""
    docs = docs.withColumn("__tokens", tokens)
    if weights is not None:
        # weights grow with the documents, so they are never broadcast
        docs = docs.join(weights.hint("merge"), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    weight = F.coalesce(F.col("__weight"), F.lit(unlabelled)) if weights is not None else F.lit(unlabelled)
    key = F.when(weight > 0, -F.log(uniform(F.col("doc_id"), seed)) / weight).otherwise(F.lit(float("inf")))
    docs = docs.withColumns({"__source": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")), "__key": key, "__hash": tie})
    # monotone in the key, and even where keys are dense
    docs = docs.withColumn("__bin", F.least(F.lit(BINS - 1), F.floor(BINS * (1 - F.exp(-F.col("__key"))))).cast("int")).drop("__weight")
    return stored(docs, "keyed") if weights is not None else docs


def mix(docs: DataFrame, targets: dict[str, float], total: float = 1.0, weights: DataFrame | None = None, other: float = 0.0, unlabelled: float = 0.5, seed: int = 17, tokens: Column | None = None, tie: Column | None = None) -> DataFrame:
    """The documents chosen, a row for each time one is taken: their columns and ``epoch``.

    ``targets`` weighs the sources by name, and ``other`` is the weight of each
    further source; weights count relative to those of the sources that have
    tokens. ``total`` is the budget as a multiple of the tokens of the whole table.
    ``tokens`` counts a document's tokens and ``tie`` orders equal ones, by default
    a hash of the text; a table that has both needs no ``text``.
    ``epoch`` counts from 1; the fraction's is one more than the complete ones.
    """
    if "epoch" in docs.columns:
        docs = docs.withColumnRenamed("epoch", "__epoch")
    keyed = _keyed(docs, weights, unlabelled, seed, token_estimate(F.col("text")) if tokens is None else tokens, F.xxhash64("text") if tie is None else tie)
    bins = stored(keyed.groupBy("__source", "__bin").agg(F.sum("__tokens").alias("tokens")), "bins")
    target = F.lit(float(other))
    for name, value in targets.items():
        target = F.when(F.col("__source") == F.lit(f"s{name}"), float(value)).otherwise(target)
    sources = bins.groupBy("__source").agg(F.sum("tokens").alias("has")).withColumn("target", F.when(F.col("has") > 0, target).otherwise(F.lit(0.0)))
    all_ = sources.agg(F.sum("has").alias("all"), F.sum("target").alias("sum"))
    budget = F.when(F.col("sum") > 0, F.floor(F.col("target") / F.col("sum") * F.col("all") * float(total))).otherwise(F.lit(0)).cast("long")
    epochs = F.when(F.col("has") > 0, F.floor(F.col("budget") / F.col("has"))).otherwise(F.lit(0)).cast("long")
    sources = sources.crossJoin(all_).withColumn("budget", budget).withColumn("__epochs", epochs).select("__source", "__epochs", (F.col("budget") - F.col("__epochs") * F.col("has")).alias("rest"))
    # the range in which the sum passes the rest, and what comes before it; the last range if it never does
    running = bins.join(sources, "__source").withColumn("upto", F.sum("tokens").over(Window.partitionBy("__source").orderBy("__bin")))
    cut = running.groupBy("__source", "__epochs", "rest").agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), F.col("__bin"))), F.lit(BINS)).alias("__cut"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("before"))
    cut = stored(cut, "cut")
    order = Window.partitionBy("__source").orderBy("__key", "doc_id", "__tokens", "__hash").rowsBetween(Window.unboundedPreceding, 0)
    edge = keyed.join(cut.select("__source", "__cut", "rest", "before").withColumnRenamed("__source", "__of"), (F.col("__source") == F.col("__of")) & (F.col("__bin") == F.col("__cut"))).drop("__of")
    edge = edge.withColumn("__sum", F.sum("__tokens").over(order) + F.col("before"))
    # the order ends at the first document that doesn't fit
    inside = edge.where(F.col("__sum") <= F.col("rest"))
    whole = keyed.join(cut.select(F.col("__source").alias("__of"), "__epochs", "__cut"), F.col("__source") == F.col("__of")).drop("__of")
    times = F.col("__epochs") + (F.col("__bin") < F.col("__cut")).cast("long")
    taken = whole.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    inside = inside.join(cut.select(F.col("__source").alias("__of"), "__epochs"), F.col("__source") == F.col("__of")).withColumn("epoch", (F.col("__epochs") + 1).cast("int"))
    columns = [*docs.columns, "epoch"]
    return taken.select(*columns).unionByName(inside.select(*columns))


def mix_sql(targets: dict[str, float], total: float, other: float, unlabelled: float = 0.5, seed: int = 17, good: float = 1.0, bad: float = 0.25) -> str:
    """DuckDB SQL for the ids, sources, tokens and epochs that ``mix`` chooses."""
    cases = " ".join(f"WHEN source = '{name}' THEN {float(value)!r}::DOUBLE" for name, value in targets.items())
    return f"""
WITH w AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN {good!r}::DOUBLE ELSE {bad!r}::DOUBLE END AS weight FROM labels GROUP BY doc_id),
k AS (
  SELECT d.doc_id, d.source, CAST(ceil(length(d.text) / 4.0::DOUBLE) AS BIGINT) AS tokens,
    -ln((CAST('0x' || substr(md5('{seed}:' || d.doc_id), 1, 13) AS BIGINT) + 1)::DOUBLE / 4503599627370496.0::DOUBLE) / coalesce(w.weight, {unlabelled!r}::DOUBLE) AS key
  FROM documents d LEFT JOIN w USING (doc_id)),
s AS (SELECT source, sum(tokens) AS has, CASE {cases} ELSE {float(other)!r}::DOUBLE END AS target FROM k GROUP BY source),
b AS (SELECT source, has, CAST(floor(target / sum(target) OVER () * (sum(has) OVER ())::DOUBLE * {float(total)!r}::DOUBLE) AS BIGINT) AS budget FROM s),
e AS (SELECT source, budget // has AS epochs, budget - budget // has * has AS rest FROM b),
o AS (SELECT k.*, e.epochs, e.rest, sum(tokens) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN e USING (source))
SELECT doc_id, source, tokens, CAST(epoch AS INTEGER) AS epoch
FROM (SELECT doc_id, source, tokens, unnest(range(1, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) + 1)) AS epoch FROM o)
"""
