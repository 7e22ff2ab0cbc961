"""Registered queries over the topic operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.stopwords import stopword_list
from .functions.text import WORD1, WORD2, grams, tokens
from .operators import consensus, graphs, keywords, metrics, topics
from .operators.embed import hashed_texts
from .operators.hierarchy import Hierarchy
from .operators.labels import simple_labels
from .plans.fit import Config, TopicModel
from .sources.exports import projector_metadata
from .sources.store import spread, stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
K = 15
STOP = stopword_list("english")


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, topic``: the source's number is the topic."""
    return spread(_table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text", F.substring("source", 4, 9).cast("int").alias("topic"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, topic`` of the embeddings; label 9 plays the outliers."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int").alias("topic"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.knn(_vectors(spark, sf_dir), K)


def _r(c: str | Column, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def _wide(c: str) -> Column:
    return F.col(c).cast("long")


# --- texts -------------------------------------------------------------------

_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP) + "]"
_LIST = f"""t AS (SELECT doc_id AS id, CAST(substr(source, 4) AS INTEGER) AS topic, [x FOR x IN regexp_extract_all(lower(text), '{WORD2}') IF NOT list_contains({_STOP_SQL}, x)] AS t FROM documents)"""
_GRAMS = f"""{_LIST},
g AS (SELECT id, topic, unnest(t) AS term FROM t UNION ALL SELECT id, topic, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) FROM t),
c AS (SELECT id, topic, term, count(*) AS n FROM g GROUP BY ALL), nn AS (SELECT count(*)::DOUBLE AS total FROM documents)"""
_DF = """df AS (SELECT term, count(*) AS df, sum(n) AS occurs FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * (SELECT total FROM nn))"""


@_query(f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD2}')) AS term FROM documents) GROUP BY term")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word of two letters or more occurs."""
    return _docs(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@_query(f"WITH {_GRAMS} SELECT term, sum(n)::BIGINT AS n, count(*) AS df FROM c GROUP BY term")
def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and document frequencies of words and pairs of words, stop words left out first."""
    return keywords.term_counts(keywords.by_document(_docs(spark, sf_dir).select("id", "text")), STOP).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


@_query(f"WITH {_LIST} SELECT id, len(t)::BIGINT AS words, list_unique(t)::BIGINT AS distinct_words FROM t")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in each document without stop words."""
    t = tokens(F.col("text"), WORD2, STOP)
    return _docs(spark, sf_dir).select("id", F.size(t).cast("long").alias("words"), F.size(F.array_distinct(t)).cast("long").alias("distinct_words"))


@_query(f"""WITH {_GRAMS}, {_DF}, v AS (SELECT term, df FROM df ORDER BY occurs DESC, term LIMIT 10000),
w AS (SELECT id, term, (1 + ln(n)) * (ln((1 + total) / (1 + df)) + 1) AS w FROM c JOIN v USING (term) CROSS JOIN nn)
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weight of the lexical matrix."""
    return keywords.tfidf(_docs(spark, sf_dir), STOP).select("id", "term", _r("weight").alias("weight"))


@_query(f"""WITH {_GRAMS}, {_DF}, idf AS (SELECT term, ln(total / (1 + df)) AS idf FROM df CROSS JOIN nn),
b AS (SELECT topic, z || ' ' || next AS term, count(*) AS n FROM (SELECT topic, t[-1] AS z, lead(t[1]) OVER (PARTITION BY topic ORDER BY id) AS next FROM t WHERE len(t) > 0) WHERE next IS NOT NULL GROUP BY ALL),
f AS (SELECT topic, term, idf, sum(n)::DOUBLE AS n FROM (SELECT topic, term, n FROM c UNION ALL SELECT topic, term, n FROM b) JOIN idf USING (term) GROUP BY ALL),
s AS (SELECT topic, term, n / (sum(n) OVER (PARTITION BY topic) + 1e-10::DOUBLE) * idf AS score FROM f)
SELECT topic, place, term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS place FROM s) WHERE place <= 10""")
def ctfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten keywords of each source's documents by class-based TF-IDF."""
    return keywords.ctfidf(_docs(spark, sf_dir), 10, STOP).select("topic", _wide("place").alias("place"), "term", _r("score").alias("score"))


_WORDS1 = f"""t AS (SELECT doc_id AS id, CAST(substr(source, 4) AS INTEGER) AS topic, [x FOR x IN regexp_extract_all(lower(text), '{WORD1}') IF NOT list_contains({_STOP_SQL}, x)] AS t FROM documents)"""


@_query(f"""WITH {_WORDS1}, w AS (SELECT id, topic, term FROM (SELECT id, topic, unnest(t) AS term FROM t) WHERE length(term) > 2),
tf AS (SELECT id, topic, term, count(*) AS f FROM w GROUP BY ALL), nn AS (SELECT count(*)::DOUBLE AS total FROM documents),
dl AS (SELECT id, sum(f)::DOUBLE AS dl FROM tf GROUP BY id), av AS (SELECT sum(dl) / (SELECT total FROM nn) AS av FROM dl),
r AS (SELECT term, ln(total - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM tf CROSS JOIN nn GROUP BY term, total),
idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT 0.25::DOUBLE * avg(raw) FROM r) ELSE raw END AS idf FROM r),
x AS (SELECT topic, term, f, idf * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)) AS w FROM tf JOIN dl USING (id) JOIN idf USING (term) CROSS JOIN av),
m AS (SELECT topic, term, sum(w) AS w, sum(f)::DOUBLE AS f FROM x GROUP BY ALL), z AS (SELECT CAST(substr(source, 4) AS INTEGER) AS topic, count(*) AS size FROM documents GROUP BY ALL),
c AS (SELECT term, sum(w) / (SELECT total FROM nn) AS mean FROM m GROUP BY term),
s AS (SELECT topic, term, w / size / (mean + 1e-10::DOUBLE) * ln(1 + f) AS score FROM m JOIN z USING (topic) JOIN c USING (term))
SELECT topic, round(score / max(score) OVER (PARTITION BY topic), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS place FROM s) WHERE place <= 10""")
def bm25_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each source's ten keywords by BM25 (words that occur in one source only tie up to rounding, so the words aren't compared)."""
    return keywords.bm25(_docs(spark, sf_dir), 10, STOP).select("topic", _r("score", 4).alias("score"))


@_query(f"""WITH {_WORDS1}, g AS (SELECT topic, unnest(t) AS term FROM t UNION ALL SELECT topic, unnest([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]) FROM t UNION ALL SELECT topic, unnest([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)]) FROM t),
c AS (SELECT topic, term, count(*) AS n FROM g GROUP BY ALL)
SELECT topic, place, term, round(n / most, 6) AS score FROM (SELECT *, max(n) OVER (PARTITION BY topic) AS most, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS place FROM c) WHERE place <= 10""")
def keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest runs of one to three words of each source."""
    return keywords.keyphrases(_docs(spark, sf_dir), 10, 3, stopwords=STOP).select("topic", _wide("place").alias("place"), "term", _r("score").alias("score"))


# --- graphs ------------------------------------------------------------------

_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label = 9 THEN -1 ELSE CAST(label AS INTEGER) END AS topic FROM embeddings)"
_KNN = f"""{_E}, p AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS sim FROM e a JOIN e b ON a.id <> b.id),
k AS (SELECT src, dst, sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS place FROM p) WHERE place <= {K})"""
_MUTUAL = "m AS (SELECT a.src, a.dst, (a.sim + b.sim) / 2 AS w FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst AND least(a.sim, b.sim) > 0)"
_SNN = f"""u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM k),
s AS (SELECT u.src, u.dst, count(*) / {K}::DOUBLE AS w FROM u JOIN k a ON a.src = u.src JOIN k b ON b.src = u.dst AND b.dst = a.dst GROUP BY ALL)"""
_HYBRID = f"""{_KNN}, {_MUTUAL}, {_SNN},
h AS (SELECT src, dst, 0.5::DOUBLE * coalesce(m.w / (SELECT max(w) FROM m), 0) + 0.5::DOUBLE * coalesce(s.w / (SELECT max(w) FROM s), 0) AS w FROM m FULL JOIN s USING (src, dst))"""


@_query(f"WITH {_KNN} SELECT src, dst, round(sim, 6) AS sim FROM k")
def cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 nearest of every embedding."""
    return _neighbours(spark, sf_dir).select("src", "dst", _r("sim").alias("sim"))


@_query(f"""WITH {_E}, p AS (SELECT a.id AS src, b.id AS dst, 1 / (1 + list_distance(a.v, b.v)) AS sim FROM e a JOIN e b ON a.id <> b.id)
SELECT src, dst, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS place FROM p) WHERE place <= {K}""")
def euclidean_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 nearest of every embedding by distance."""
    return graphs.knn(_vectors(spark, sf_dir), K, "euclidean").select("src", "dst", _r("sim").alias("sim"))


@_query(f"WITH {_KNN} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(sim), 6) AS w FROM k GROUP BY ALL")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.undirected(_neighbours(spark, sf_dir)).select("src", "dst", _r("w").alias("w"))


@_query(f"WITH {_KNN}, {_MUTUAL} SELECT src, dst, round(w, 6) AS w FROM m")
def mutual_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.mutual(_neighbours(spark, sf_dir)).select("src", "dst", _r("w").alias("w"))


@_query(f"WITH {_KNN}, {_SNN} SELECT src, dst, round(w, 6) AS w FROM s")
def snn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.shared(_neighbours(spark, sf_dir), K).select("src", "dst", _r("w").alias("w"))


@_query(f"WITH {_HYBRID} SELECT src, dst, round(w, 6) AS w FROM h")
def hybrid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.semantic(_vectors(spark, sf_dir), K).select("src", "dst", _r("w").alias("w"))


@_query(f"WITH {_E} SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) + 0.0::DOUBLE AS cos FROM e a CROSS JOIN e b WHERE a.id % 20 = 0")
def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of the query rows, those whose id is divisible by 20, with all rows."""
    v = _vectors(spark, sf_dir)
    return graphs.similarity(v.where("id % 20 = 0"), v).select("a", "b", _r("cos").alias("cos"))


_CATEGORICAL = "SELECT a.doc_id AS src, b.doc_id AS dst, 1.0::DOUBLE AS w FROM documents a JOIN documents b ON a.{0} = b.{0} AND a.doc_id < b.doc_id"


@_query(f"SELECT src, dst, sum(w) AS w FROM ({_CATEGORICAL.format('lang')} UNION ALL {_CATEGORICAL.format('source')}) GROUP BY ALL")
def metadata_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many of language and source two documents agree."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return graphs.categorical_edges(rows, ["lang", "source"])


_NUMERIC = f"""d AS (SELECT doc_id AS id, n_chars::DOUBLE AS x FROM documents WHERE n_chars IS NOT NULL), r AS (SELECT min(x) AS low, max(x) AS high FROM d),
n AS (SELECT id, (x - low) / (high - low) AS x FROM d CROSS JOIN r),
p AS (SELECT a.id AS src, b.id AS dst, abs(a.x - b.x) AS apart FROM n a JOIN n b ON a.id <> b.id),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY apart, dst) AS place FROM p) WHERE place <= {K} AND 1 - apart > 0.8::DOUBLE)"""


@_query(f"WITH {_NUMERIC} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(sum(1 - apart), 6) AS w FROM q GROUP BY ALL")
def metadata_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of near lengths."""
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return graphs.numeric_edges(rows, "n_chars", K).select("src", "dst", _r("w").alias("w"))


@_query(f"""WITH {_HYBRID}, g AS (SELECT src, dst, w / (SELECT max(w) FROM h) AS s FROM h), y AS (SELECT a.id AS src, b.id AS dst, 1.0::DOUBLE AS c FROM e a JOIN e b ON a.topic = b.topic AND a.id < b.id),
f AS (SELECT src, dst, coalesce(s, 0) * (0.5::DOUBLE / 0.7::DOUBLE) + coalesce(c, 0) * (0.2::DOUBLE / 0.7::DOUBLE) AS w FROM g FULL JOIN y USING (src, dst))
SELECT src, dst, round(w, 6) AS w FROM f WHERE w > 0""")
def fused_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic and metadata view of the embeddings in one graph."""
    sem = graphs.semantic(_vectors(spark, sf_dir), K)
    # the label of each vector is a category
    return graphs.fuse_category(sem, _labels(spark, sf_dir), "topic").select("src", "dst", _r("w").alias("w"))


@_query()
def lexical_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual nearest documents by TF-IDF; tests compare it with brute force."""
    return graphs.lexical(keywords.tfidf(_docs(spark, sf_dir), STOP), K)


# --- vectors and topics ------------------------------------------------------

_CENT = f"""{_E}, cl AS (SELECT topic, i, avg(v[i]) AS x FROM e CROSS JOIN (SELECT unnest(range(1, 65)) AS i) WHERE topic >= 0 GROUP BY ALL), ce AS (SELECT topic, list(x ORDER BY i) AS c FROM cl GROUP BY topic)"""
_COS = f"""{_CENT}, cs AS (SELECT e.id, ce.topic, list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c))) AS cos FROM e CROSS JOIN ce)"""
_PROB = f"""{_COS}, ex AS (SELECT id, topic, exp(5.0::DOUBLE * (cos - max(cos) OVER (PARTITION BY id))) AS raw FROM cs), pr AS (SELECT id, topic, raw / sum(raw) OVER (PARTITION BY id) AS prob FROM ex)"""


def _centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.centroids(_vectors(spark, sf_dir), _labels(spark, sf_dir))


def _soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.soft(_vectors(spark, sf_dir), _centers(spark, sf_dir))


@_query(f"WITH {_CENT} SELECT topic, i AS at, round(x, 6) + 0.0::DOUBLE AS x FROM cl")
def topic_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centers(spark, sf_dir).select("topic", F.posexplode("centroid").alias("at", "x")).select("topic", (F.col("at") + 1).cast("long").alias("at"), _r("x").alias("x"))


@_query(f"""WITH {_CENT}, b AS (SELECT e.id, e.v, c, 0.2::DOUBLE * sqrt(greatest(0, least(1, list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(c, c)))))) AS b FROM e LEFT JOIN ce USING (topic)),
y AS (SELECT id, CASE WHEN c IS NULL THEN v ELSE [(1 - b) * v[i] + b * c[i] FOR i IN range(1, 65)] END AS y FROM b)
SELECT id, round(y[1] / sqrt(list_dot_product(y, y)), 6) + 0.0::DOUBLE AS first, round(y[64] / sqrt(list_dot_product(y, y)), 6) + 0.0::DOUBLE AS last, round(list_sum(y) / sqrt(list_dot_product(y, y)), 6) + 0.0::DOUBLE AS total FROM y""")
def refined_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors pulled towards their centroids, by first and last element and sum."""
    v = topics.refine(_vectors(spark, sf_dir), _labels(spark, sf_dir))
    return v.select("id", _r(F.element_at("v", 1)).alias("first"), _r(F.element_at("v", -1)).alias("last"), _r(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@_query(f"WITH {_PROB} SELECT id, topic, round(prob, 6) AS prob FROM pr")
def soft_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _soft(spark, sf_dir).select("id", "topic", _r("prob").alias("prob"))


@_query(f"WITH {_PROB} SELECT id, topic, place, round(prob, 6) AS prob FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, topic) AS place FROM pr) WHERE place <= 3")
def document_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest topics of each row."""
    return topics.document_topics(_soft(spark, sf_dir)).select("id", "topic", _wide("place").alias("place"), _r("prob").alias("prob"))


@_query(f"""WITH {_HYBRID}, w2 AS (SELECT src, dst, w FROM h UNION ALL SELECT dst, src, w FROM h), ts AS (SELECT DISTINCT topic FROM e WHERE topic >= 0),
a AS (SELECT src AS id, e.topic, sum(w) AS w FROM w2 JOIN e ON e.id = w2.dst WHERE e.topic >= 0 GROUP BY ALL),
g AS (SELECT e.id, ts.topic, coalesce(a.w, 0) AS w FROM e CROSS JOIN ts LEFT JOIN a ON a.id = e.id AND a.topic = ts.topic)
SELECT id, topic, round(CASE WHEN sum(w) OVER q > 0 THEN w / sum(w) OVER q ELSE 1 / (count(*) OVER q)::DOUBLE END, 6) AS prob FROM g WINDOW q AS (PARTITION BY id)""")
def graph_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft assignment by neighbours' topics."""
    return topics.graph_probabilities(graphs.semantic(_vectors(spark, sf_dir), K), _labels(spark, sf_dir)).select("id", "topic", _r("prob").alias("prob"))


@_query(f"""WITH {_COS} SELECT id, CASE WHEN cos < 0.35::DOUBLE THEN -1 ELSE topic END AS topic, round(cos, 6) + 0.0::DOUBLE AS cos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, topic) AS place FROM cs) WHERE place = 1""")
def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's nearest topic, or -1 below the threshold."""
    return topics.assign(_vectors(spark, sf_dir), _centers(spark, sf_dir)).select("id", "topic", _r("cos").alias("cos"))


@_query(f"""WITH {_PROB}, a AS (SELECT id, topic FROM pr WHERE prob >= 0.1::DOUBLE), t AS (SELECT DISTINCT topic FROM pr), n AS (SELECT x.topic AS a, y.topic AS b, count(*) AS n FROM a x JOIN a y USING (id) GROUP BY ALL)
SELECT t.topic AS a, u.topic AS b, coalesce(n, 0) AS n FROM t CROSS JOIN t u LEFT JOIN n ON n.a = t.topic AND n.b = u.topic""")
def topic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.overlap(_soft(spark, sf_dir)).select("a", "b", _wide("n").alias("n"))


@_query(f"WITH {_CENT} SELECT x.topic AS a, y.topic AS b, round(list_dot_product(x.c, y.c) / (sqrt(list_dot_product(x.c, x.c)) * sqrt(list_dot_product(y.c, y.c))), 6) + 0.0::DOUBLE AS cos FROM ce x CROSS JOIN ce y")
def topic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_similarity(_centers(spark, sf_dir)).select("a", "b", _r("cos").alias("cos"))


@_query(f"""WITH {_CENT}, d AS (SELECT e.topic, e.id, CASE WHEN e.topic = -1 THEN e.id::DOUBLE ELSE list_distance(v, c) END AS apart FROM e LEFT JOIN ce USING (topic))
SELECT topic, id, place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY apart, id) AS place FROM d) WHERE place <= 5""")
def representative_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.representatives(_vectors(spark, sf_dir), _labels(spark, sf_dir)).select("topic", "id", _wide("place").alias("place"))


@_query(f"""WITH {_COS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cos DESC, topic) AS place FROM cs) WHERE place = 1)
SELECT e.id, CASE WHEN e.topic = -1 AND cos >= 0.1::DOUBLE THEN b.topic ELSE e.topic END AS topic FROM e JOIN b USING (id)""")
def outliers_by_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers join the nearest topic."""
    return topics.adopt_by_centroid(_vectors(spark, sf_dir), _labels(spark, sf_dir), _centers(spark, sf_dir), 0.1)


@_query(f"""WITH {_E}, p AS (SELECT a.id AS src, b.topic, b.id AS dst, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS sim FROM e a JOIN e b ON a.topic = -1 AND b.topic >= 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS place FROM p) WHERE place <= {K}), n AS (SELECT src, topic, count(*) AS n FROM k GROUP BY ALL),
b AS (SELECT src, topic FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, topic) AS place FROM n) WHERE place = 1)
SELECT e.id, coalesce(b.topic, e.topic) AS topic FROM e LEFT JOIN b ON b.src = e.id""")
def outliers_by_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers join the commonest topic of their neighbours."""
    return topics.adopt_by_neighbours(_vectors(spark, sf_dir), _labels(spark, sf_dir), K)


_BY_CUSTOMER = "l AS (SELECT o_orderkey AS id, CAST(o_custkey AS INTEGER) AS topic FROM orders)"


@_query(f"""WITH {_BY_CUSTOMER}, k AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS new FROM l GROUP BY topic HAVING count(*) >= 12)
SELECT id, CAST(coalesce(new, -1) AS INTEGER) AS topic FROM l LEFT JOIN k USING (topic)""")
def small_topics_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer, customers with fewer than twelve as outliers, the rest renumbered."""
    labels = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("int").alias("topic"))
    return topics.drop_small(labels, 12)


@_query(f"""WITH {_E}, s AS (SELECT topic FROM e WHERE topic IN (2, 5, 7) GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 1) SELECT id, CASE WHEN topic IN (2, 5, 7) THEN (SELECT topic FROM s) ELSE topic END AS topic FROM e""")
def merged_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.merge(_labels(spark, sf_dir), [2, 5, 7])


@_query()
def reduced_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics merged pairwise until four are left; tests compare it with brute force."""
    return topics.reduce_to(_vectors(spark, sf_dir), _labels(spark, sf_dir), 4)


@_query("""WITH b AS (SELECT CAST(substr(source, 4) AS INTEGER) AS topic, ascii(lang) AS parent, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL)
SELECT topic, parent FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, first) AS place FROM b) WHERE place = 1""")
def parent_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language, by its first letter's code, that shares most documents with each source."""
    docs = _table(spark, sf_dir, "documents")
    languages = docs.select(F.col("doc_id").alias("id"), F.ascii("lang").alias("topic"))
    return topics.parents(_docs(spark, sf_dir).select("id", "topic"), languages)


@_query("""WITH c AS (SELECT date_trunc('month', ts)::TIMESTAMP AS period, event_type AS topic, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT period FROM c) CROSS JOIN (SELECT DISTINCT topic FROM c))
SELECT strftime(period, '%Y-%m-%d') AS period, topic, coalesce(n, 0) AS n, round(100.0::DOUBLE * coalesce(n, 0) / sum(n) OVER (PARTITION BY period), 6) AS share FROM g LEFT JOIN c USING (period, topic)""")
def topics_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_time(spark, sf_dir, "month")


_SQL["topics_by_day"] = _SQL["topics_by_month"].replace("'month'", "'day'")


@_query(_SQL["topics_by_day"])
def topics_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_time(spark, sf_dir, "day")


def _over_time(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    rows = topics.over_time(_table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("topic")), unit)
    return rows.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "topic", _wide("n").alias("n"), _r("share").alias("share"))


# --- scores ------------------------------------------------------------------

_ARI = """ct AS (SELECT a, b, count(*) AS n FROM ab GROUP BY ALL), ij AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS ij, sum(n)::DOUBLE AS t FROM ct),
sa AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS sa FROM (SELECT sum(n)::DOUBLE AS n FROM ct GROUP BY a)), sb AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS sb FROM (SELECT sum(n)::DOUBLE AS n FROM ct GROUP BY b))
SELECT round((ij - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari FROM ij, sa, sb"""


def _sources_and_languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents")
    return _docs(spark, sf_dir).select("id", "topic"), docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("topic"))


@_query("SELECT CAST(substr(source, 4) AS INTEGER) AS a, lang AS b, count(*) AS n FROM documents GROUP BY ALL")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contingency(*_sources_and_languages(spark, sf_dir))


@_query(f"WITH ab AS (SELECT source AS a, lang AS b FROM documents), {_ARI}")
def rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjusted Rand index of sources against languages."""
    return metrics.rand_index(metrics.contingency(*_sources_and_languages(spark, sf_dir))).select(_r("ari").alias("ari"))


def _three_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(7)).alias("a"), F.pmod("o_custkey", F.lit(14)).alias("b"), F.pmod("o_orderkey", F.lit(5)).alias("c"))
    runs = F.array(*[F.struct(F.lit(i).alias("run"), F.col(c).cast("int").alias("topic")) for i, c in enumerate("abc")])
    return orders.select("id", F.explode(runs).alias("r")).select("r.run", "id", "r.topic")


_RUNS = "r AS (SELECT o_orderkey AS id, o_custkey % 7 AS x, o_custkey % 14 AS y, o_orderkey % 5 AS z FROM orders)"


@_query("WITH " + _RUNS + ", p AS (" + " UNION ALL ".join(f"SELECT * FROM (WITH ab AS (SELECT {a} AS a, {b} AS b FROM r), {_ARI.replace('round(', '(').replace(', 6) AS ari', ') AS ari')})" for a, b in ("xy", "xz", "yz")) + ") SELECT round(avg(ari), 6) + 0.0::DOUBLE AS stability FROM p")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean index over pairs of three partitions of the orders."""
    return spark.createDataFrame([(round(metrics.stability(_three_runs(spark, sf_dir)), 6) + 0.0,)], "stability double")


@_query(f"""WITH {_RUNS}, s AS (SELECT min(id) AS node, x, y, z FROM r GROUP BY x, y, z)
SELECT node, a, b, round(freq, 6) AS freq FROM (SELECT least(p.node, q.node) AS a, greatest(p.node, q.node) AS b, p.node AS node, ((p.x = q.x)::INT + (p.y = q.y)::INT + (p.z = q.z)::INT) / 3.0::DOUBLE AS freq FROM s p JOIN s q ON p.node < q.node) WHERE freq >= 0.5""")
def consensus_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of orders with equal labels in all runs, paired where they agree in half of the runs or more."""
    _, nodes = consensus.signatures(_three_runs(spark, sf_dir))
    return consensus.agreement(nodes, 0.5).select(F.col("a").alias("node"), "a", "b", _r("freq").alias("freq"))


_COHERENCE = f"""WITH {_WORDS1.replace(f"IF NOT list_contains({_STOP_SQL}, x)", "")}, nn AS (SELECT count(*)::DOUBLE AS total FROM documents), h AS (SELECT DISTINCT id, topic, unnest(t) AS term FROM t),
q AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS place FROM (SELECT topic, term, count(*) AS n FROM h WHERE length(term) > 6 GROUP BY ALL) QUALIFY place <= 6),
s AS (SELECT id, term FROM h WHERE term IN (SELECT term FROM q)), df AS (SELECT term, count(*) AS f FROM s GROUP BY term),
j AS (SELECT x.term AS w1, y.term AS w2, count(*) AS f FROM s x JOIN s y USING (id) GROUP BY ALL),
pp AS (SELECT a.topic, d1.f AS f1, d2.f AS f2, coalesce(j.f, 0) AS f, (d1.f + 1) / (total + 1) AS p1, (d2.f + 1) / (total + 1) AS p2, (coalesce(j.f, 0) + 1) / (total + 1) AS p FROM q a JOIN q b ON a.topic = b.topic AND a.place < b.place JOIN df d1 ON d1.term = a.term JOIN df d2 ON d2.term = b.term LEFT JOIN j ON j.w1 = a.term AND j.w2 = b.term CROSS JOIN nn)
SELECT topic, round(avg({{}}), 6) + 0.0::DOUBLE AS coherence FROM pp GROUP BY topic"""


def _long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six long words that most documents of each source have."""
    words = _docs(spark, sf_dir).select("id", "topic", F.explode(F.array_distinct(tokens(F.col("text"), WORD1))).alias("term")).where(F.length("term") > 6)
    return keywords.top_terms(words.groupBy("topic", "term").agg(F.count("*").alias("score")), 6)


def _coherence(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return metrics.coherence(_long_words(spark, sf_dir), _docs(spark, sf_dir).select("id", "text"), method).select("topic", _r("coherence").alias("coherence"))


@_query(_COHERENCE.replace("{}", "ln(p / (p1 * p2)) / (-ln(p) + 1e-12::DOUBLE)"))
def coherence_npmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coherence(spark, sf_dir, "npmi")


@_query(_COHERENCE.replace("{}", "ln(p / (p1 * p2 + 1e-12::DOUBLE))"))
def coherence_uci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coherence(spark, sf_dir, "uci")


@_query(_COHERENCE.replace("{}", "ln((f + 1) / f2::DOUBLE)"))
def coherence_umass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coherence(spark, sf_dir, "umass")


@_query(_COHERENCE.split("s AS (SELECT id, term")[0].rstrip().rstrip(",") + " SELECT round(count(DISTINCT term) / count(*), 6) AS diversity FROM q")
def keyword_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(metrics.diversity(_long_words(spark, sf_dir)), 6),)], "diversity double")


@_query(f"""WITH {_E}, l AS (SELECT * FROM e WHERE topic >= 0), m AS (SELECT a.id, a.topic, b.topic AS ot, avg(list_distance(a.v, b.v)) AS d FROM l a JOIN l b ON a.id <> b.id GROUP BY ALL),
ab AS (SELECT id, max(CASE WHEN topic = ot THEN d END) AS a, min(CASE WHEN topic <> ot THEN d END) AS b FROM m GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0::DOUBLE AS silhouette FROM ab""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(metrics.silhouette(_vectors(spark, sf_dir), _labels(spark, sf_dir)), 6) + 0.0,)], "silhouette double")


@_query()
def downstream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 of vectors and topics for predicting the labels' parity."""
    labels = _labels(spark, sf_dir)
    truth = labels.select("id", F.pmod("topic", F.lit(2)).alias("y"))
    return spark.createDataFrame([(metrics.downstream(_vectors(spark, sf_dir), labels, truth),)], "score double")


# --- names and exports -------------------------------------------------------

@_query(_SQL["keyphrases"].split("SELECT topic, place, term")[0] + """, q AS (SELECT topic, place, term FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS place FROM c) WHERE place <= 6)
SELECT topic, string_agg(array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(term, ' ')], ' '), ' & ' ORDER BY place) FILTER (place <= 3) AS label, 'Topics related to: ' || string_agg(term, ', ' ORDER BY place) AS description FROM q GROUP BY topic""")
def simple_topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the commonest phrases."""
    return simple_labels(keywords.keyphrases(_docs(spark, sf_dir), 10, 3, stopwords=STOP))


@_query("""WITH n AS (SELECT o_orderkey AS topic, CAST(o_orderpriority AS VARCHAR) || ' ' || CAST(o_orderstatus AS VARCHAR) || ' x' || CAST(o_custkey AS VARCHAR) || ' y' AS label FROM orders)
SELECT prefix, array_to_string(list(topic ORDER BY topic), ',') AS topics FROM (SELECT topic, array_to_string(regexp_split_to_array(lower(trim(label)), '\\s+')[1:3], ' ') AS prefix FROM n) GROUP BY prefix HAVING count(*) > 1""")
def label_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose names, made of priority, state and customer, begin with the same three words."""
    name = F.concat(F.col("o_orderpriority").cast("string"), F.lit(" "), F.col("o_orderstatus").cast("string"), F.lit(" x"), F.col("o_custkey").cast("string"), F.lit(" y"))
    names = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("topic"), name.alias("label"))
    return topics.label_collisions(names).select("prefix", F.concat_ws(",", F.col("topics").cast("array<string>")).alias("topics"))


@_query(_SQL["keyphrases"].split("SELECT topic, place, term")[0] + """, q AS (SELECT topic, string_agg(term, ', ' ORDER BY place) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS place FROM c) WHERE place <= 5 GROUP BY topic)
SELECT doc_id AS id, topic AS topic_id, 'Topic ' || topic AS topic_label, keywords, translate(left(text, 150), chr(9) || chr(10) || chr(13), '   ') AS document FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS topic FROM documents) JOIN q USING (topic)""")
def projector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata file of the projector export."""
    docs = _docs(spark, sf_dir)
    return projector_metadata(docs.select("id", "text"), docs.select("id", "topic"), keywords.keyphrases(docs, 10, 3, stopwords=STOP))


# --- partitions and models ---------------------------------------------------

@_query()
def leiden_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten Leiden runs with other seeds over the hybrid graph."""
    v = _vectors(spark, sf_dir)
    return consensus.many(consensus.packed(graphs.semantic(v, K), v), spark, [(r, 1.0, 42 + r) for r in range(10)])


@_query()
def consensus_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus of ten runs, small topics left out."""
    v = _vectors(spark, sf_dir)
    return consensus.cluster(consensus.packed(graphs.semantic(v, K), v), spark)[0]


@_query()
def fitted_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of a model fitted on all documents with the default numbers of iterations and runs, as ``topic_info`` gives them."""
    docs = _docs(spark, sf_dir).select("id", "text")
    return TopicModel(Config(dim_reduction_method="pca", language="english")).fit(docs).topic_info()


@_query()
def embedded_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten keywords of each source's documents by embeddings, all terms of a source being candidates; tests compare it with brute force."""
    return keywords.embedded(_docs(spark, sf_dir), hashed_texts(64), 10, STOP)


@_query()
def topic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a tree of topics at three resolutions over the embeddings' graph, each with all that hangs below it; tests compare the tree with its table."""
    v = _vectors(spark, sf_dir)
    graph = consensus.packed(graphs.semantic(v, K), v)
    runs = stored(consensus.many(graph, spark, [(i, g, 42) for i, g in enumerate((0.25, 1.0, 4.0))]), "levels")
    tree = Hierarchy.of_levels(runs, [0.25, 1.0, 4.0])
    rows = [(n.node_id, n.level, n.topic_id, n.parent.node_id if n.parent else None, n.size, n.is_leaf(), [x.node_id for x in n.subtopics(3)]) for n in tree.flatten()]
    return spark.createDataFrame(rows, "node_id string, level int, topic_id int, parent_id string, size long, is_leaf boolean, below array<string>")
