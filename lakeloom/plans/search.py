"""Vector and text search over `embeddings` and `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.nearest import knn_join
from ..operators.search import build_cells, knn, pq_encode, sq8_encode
from ..operators.text import bm25_topk, tfidf_vectors
from ..session import new_path
from .registry import query

K = 10
#: Share of the true neighbours that the index queries find at least.
RECALL = 0.9


def centres(t):
    """The query set: the mean vector of each label, made of all vectors."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One entry per dimension and label, whatever the number of vectors.
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(vector.alias("embedding"))


def asking_rows(t):
    """The query set of real rows: every vector whose id is divisible by 50."""
    asking = t.embeddings.filter("vec_id % 50 = 0 AND embedding IS NOT NULL")
    return asking.select(F.col("vec_id").alias("query_id"), "embedding")


CENTRES_SQL = """
WITH x AS (SELECT vec_id, label, unnest(embedding) :: DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label AS query_id, i, avg(x) AS x FROM x GROUP BY label, i),
q AS (SELECT query_id, list(x ORDER BY i) AS qv FROM m GROUP BY query_id),
b AS (SELECT vec_id, label, list(x ORDER BY i) AS bv FROM x GROUP BY vec_id, label),
"""

ROWS_SQL = """
WITH x AS (SELECT vec_id, label, unnest(embedding) :: DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
b AS (SELECT vec_id, label, list(x ORDER BY i) AS bv FROM x GROUP BY vec_id, label),
q AS (SELECT vec_id AS query_id, bv AS qv FROM b WHERE vec_id % 50 = 0),
"""

DISTANCE_SQL = {
    "l2": "list_distance(qv, bv)",
    "ip": "list_inner_product(qv, bv)",
    "cosine": "1 - list_cosine_similarity(qv, bv)",
    "hamming": "len(list_filter(list_zip(qv, bv), lambda p : (p[1] > 0) <> (p[2] > 0)))",
    "jaccard": "1 - len(list_filter(list_zip(qv, bv), lambda p : p[1] > 0 AND p[2] > 0)) / "
    "len(list_filter(list_zip(qv, bv), lambda p : p[1] > 0 OR p[2] > 0))",
}


def knn_sql(metric: str, where: str = "true", asked: str = CENTRES_SQL) -> str:
    order = "DESC" if metric == "ip" else "ASC"
    return f"""{asked}
d AS (SELECT query_id, vec_id AS base_id, round(({DISTANCE_SQL[metric]}) :: DOUBLE, 6) AS distance FROM q, b WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance {order}, base_id) AS place FROM d)
SELECT query_id :: BIGINT AS query_id, base_id, distance, place FROM r WHERE place <= {K}"""


def _placed(found):
    return found.withColumn("place", F.col("place").cast("bigint"))


for _metric in DISTANCE_SQL:
    query(f"knn_{_metric}", knn_sql(_metric))(
        lambda t, metric=_metric: _placed(knn(centres(t), t.embeddings, K, metric))
    )
    query(f"knn_rows_{_metric}", knn_sql(_metric, asked=ROWS_SQL))(
        lambda t, metric=_metric: _placed(knn_join(asking_rows(t), t.embeddings, K, metric))
    )


@query("knn_filtered", knn_sql("l2", "label IN (1, 3, 5)"))
def knn_filtered(t):
    """Only the vectors of the named partitions are searched."""
    return _placed(knn(centres(t), _named_partitions(t), K, "l2"))


@query("knn_rows_filtered", knn_sql("l2", "label IN (1, 3, 5)", ROWS_SQL))
def knn_rows_filtered(t):
    """The same, asked with rows of all partitions."""
    return _placed(knn_join(asking_rows(t), _named_partitions(t), K, "l2"))


def _named_partitions(t):
    return t.embeddings.filter(F.col("label").isin(1, 3, 5))


def _ivf(t, queries):
    index = build_cells(t.embeddings.select("vec_id", "embedding")).write(new_path(t.spark, "cells"))
    return index.search(queries, K, probes=4, recall=RECALL)


@query("knn_ivf")
def knn_ivf(t):
    """Approximate search in the nearest cells, as many as the recall takes; k-means has no SQL equivalent."""
    return _ivf(t, centres(t))


@query("knn_rows_ivf")
def knn_rows_ivf(t):
    """The same, asked with rows."""
    return _ivf(t, asking_rows(t))


@query("sq8_encode", """
WITH x AS (SELECT vec_id, unnest(embedding) :: DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, min(x) AS lo, max(x) - min(x) AS span FROM x GROUP BY i)
SELECT vec_id, string_agg(CAST(round((x - lo) / span * 255) AS INT), ',' ORDER BY i) AS code FROM x JOIN s USING (i) GROUP BY vec_id
""")
def sq8_encode_embeddings(t):
    """One byte per dimension."""
    coded = sq8_encode(t.embeddings)
    return coded.select("vec_id", F.concat_ws(",", F.transform("code", lambda c: c.cast("string"))).alias("code"))


@query("pq_encode")
def pq_encode_embeddings(t):
    """Product codes; codebooks come from k-means, so there is no SQL equivalent."""
    coded, _ = pq_encode(t.embeddings, parts=8, codes=16)
    return coded.select("vec_id", "code")


@query("bm25_topk", """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w : w <> '') AS w FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w : w <> '')) AS term FROM benchmark),
tf AS (SELECT doc_id, len(w) AS dl, term, count(*) AS n FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, dl, term),
c AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d),
df AS (SELECT term, count(*) AS found FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - found + 0.5) / (found + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY query_id, doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 10
""")
def bm25_topk_benchmark(t):
    """The ten best documents for every benchmark text."""
    found = bm25_topk(t.benchmark, t.documents, K, "item_id", "text", "doc_id", "text")
    return found.withColumn("place", F.col("place").cast("bigint"))


@query("tfidf_vectors")
def tfidf_vectors_documents(t):
    """Hashed term weights; the hash has no SQL equivalent."""
    vectors = tfidf_vectors(t.documents.select("doc_id", "text"), "text")
    # The stored entries only: one of 2**18 slots in a few hundred is set.
    stored = F.unwrap_udt("features")["values"]
    return vectors.select("doc_id", F.size(F.filter(stored, lambda x: x != 0)).alias("nonzero"),
                          F.round(F.aggregate(stored, F.lit(0.0), lambda a, x: a + x * x), 4).alias("sq"))
