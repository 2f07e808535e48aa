"""Exact and approximate nearest neighbours, and vector compression."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import closer_sign, distances
from ..sinks.tables import write_partitioned
from .bounded import collect_bounded
from .nearest import FOUND, Closest, knn_join, matrix, nearest_in_cells, ranked, sort_keys, vectors_of, with_cells

QUERY_BLOCK = 1024
#: Queries, at most about, that the number of cells for an asked recall is measured on.
MEASURED_QUERIES = 256
#: Cells of an index, at most; their centres are sent to all tasks. Rows per cell, about, that the centres are fitted on.
MAX_CELLS, FIT_ROWS = 65_536, 256


def _nearest(ids: np.ndarray, shared, metric: str, k: int):
    """Task function: the k closest base rows of its partition for every query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Closest(len(ids), k)
        for batch in batches:
            if batch.num_rows:
                names = batch.column(0).to_numpy(zero_copy_only=False)
                best.add(sort_keys(metric, matrix(batch.column(1)), shared.value), names)
        if len(best.query):
            columns = best.rows(ids, closer_sign(metric))
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "base_id", "distance"])

    return run


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "l2",
    query_id: str = "query_id",
    base_id: str = "vec_id",
    vector: str = "embedding",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, base_id, distance, place): the k closest base vectors of each query.

    Up to `block` queries go to every task; the base is read once and not shuffled, and each task keeps k rows per query.
    More queries are joined in tiles (`nearest.knn_join`). Distances are rounded to six digits before ranking, ties rank
    by id. Ids are BIGINT; rows without an id or a vector are left out.
    """
    first = vectors_of(queries, query_id, vector).limit(block + 1).collect()
    if len(first) > block:
        return knn_join(queries, base, k, metric, query_id, base_id, vector)
    if not first:
        return ranked(base.sparkSession.createDataFrame([], FOUND), k, metric)
    return ranked(_read_by_all(first, base, k, metric, base_id, vector), k, metric)


def _read_by_all(asked: list, base: DataFrame, k: int, metric: str, base_id: str, vector: str) -> DataFrame:
    """What each task finds for a bounded list of (id, vector)."""
    ids = np.array([r[0] for r in asked], dtype=np.int64)
    shared = base.sparkSession.sparkContext.broadcast(np.array([r[1] for r in asked], dtype=np.float64))
    return vectors_of(base, base_id, vector).mapInArrow(_nearest(ids, shared, metric, k), FOUND)


class CellIndex:
    """Vectors grouped into cells around k-means centres; a search reads the nearest cells only."""

    def __init__(self, base: DataFrame, centres: np.ndarray, base_id: str, vector: str):
        self.base, self.centres, self.base_id, self.vector = base, centres, base_id, vector

    def write(self, path: str) -> CellIndex:
        """Store the vectors partitioned by cell, so that a search skips the other folders."""
        write_partitioned(self.base, "cell", path)
        stored = self.base.sparkSession.read.parquet(path)
        return CellIndex(stored, self.centres, self.base_id, self.vector)

    def search(
        self,
        queries: DataFrame,
        k: int,
        probes: int,
        metric: str = "l2",
        query_id: str = "query_id",
        recall: float | None = None,
    ) -> DataFrame:
        """Like `knn` over the `probes` nearest cells of each query; with `recall`, over as many more as it takes.

        Queries are a table like the base: a row for each query and near cell, joined with the rows on the cell.
        """
        if recall is not None:
            probes = self.probes_for(queries, k, probes, recall, metric, query_id)
        rows = vectors_of(self.base, self.base_id, self.vector, "cell")
        return ranked(nearest_in_cells(self._asked(queries, probes, query_id), rows, k, metric), k, metric)

    def _asked(self, queries: DataFrame, probes: int, query_id: str) -> DataFrame:
        return with_cells(vectors_of(queries, query_id, self.vector), self.centres, probes)

    def pairs_compared(self, queries: DataFrame, probes: int, query_id: str = "query_id") -> int:
        """The distances that a search computes."""
        asked = self._asked(queries, probes, query_id).groupBy("cell").agg(F.count("*").alias("asked"))
        rows = self.base.groupBy("cell").agg(F.count("*").alias("rows"))
        return asked.join(rows, "cell").agg(F.sum(F.col("asked") * F.col("rows"))).first()[0] or 0

    def probes_for(
        self, queries: DataFrame, k: int, least: int, recall: float, metric: str = "l2", query_id: str = "query_id"
    ) -> int:
        """The fewest cells, `least` or more, that hold the share `recall` of the k closest rows, two standard errors safe.

        It is measured by brute force over all rows for a sample of the queries, chosen by hashes of their ids: one scan,
        which is little beside a search with many queries. A search with few can be given its `probes` instead.
        """
        asked = _sample(vectors_of(queries, query_id, self.vector), MEASURED_QUERIES)
        if not asked:
            return least
        true = ranked(_read_by_all(asked, self.base, k, metric, self.base_id, self.vector), k, metric)
        cells = self.base.select(F.col(self.base_id).alias("base_id"), "cell")
        # At most k rows for each query of the sample.
        held = cells.join(F.broadcast(true), "base_id").select("query_id", "cell").collect()
        points = np.array([r[1] for r in asked], dtype=np.float64)
        # The place of each cell in each query's order; a neighbour is found from that many cells on.
        place = np.argsort(np.argsort(distances("l2", self.centres, points), axis=1, kind="stable"), axis=1)
        at = {r[0]: i for i, r in enumerate(asked)}
        query = np.array([at[r[0]] for r in held], dtype=np.int64)
        needed = place[query, [r[1] for r in held]] + 1
        all_of = np.maximum(np.bincount(query, minlength=len(asked)), 1)
        for probes in range(least, len(self.centres)):
            found = np.bincount(query, needed <= probes, len(asked)) / all_of
            if found.mean() - 2 * found.std() / len(found) ** 0.5 >= recall:
                return probes
        return max(least, len(self.centres))


def _sample(asked: DataFrame, most: int) -> list:
    """Queries chosen by a hash of their id, about `most` of more; the same ones each time."""
    n = -(-asked.count() // most)
    return collect_bounded(asked.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == 0), 4 * most) if n else []


def build_cells(
    base: DataFrame, cells: int | None = None, base_id: str = "vec_id", vector: str = "embedding", seed: int = 7
) -> CellIndex:
    """Fit the cell centres and assign every vector to its cell; rows without a vector are left out.

    Without `cells` there are as many as the root of the rows, at most `MAX_CELLS`. The centres are fitted on about
    `FIT_ROWS` rows a cell, chosen by hashes of their ids.
    """
    there = base.filter(F.col(vector).isNotNull())
    rows = there.count()
    cells = cells or max(min(isqrt(rows), MAX_CELLS), 2)
    ready = there.withColumn("_v", array_to_vector(vector))
    one_in = max(rows // (cells * FIT_ROWS), 1)
    fitted = ready.filter(F.pmod(F.xxhash64(base_id), F.lit(one_in)) == 0) if one_in > 1 else ready
    model = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=10).fit(fitted)
    placed = model.transform(ready).drop("_v")
    return CellIndex(placed, np.array(model.clusterCenters()), base_id, vector)


def dimension_ranges(base: DataFrame, vector: str = "embedding", max_dims: int = 100_000) -> tuple[list, list]:
    """Smallest and largest value per dimension: one pair per dimension reaches the driver."""
    rows = collect_bounded(
        base.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x"), F.max("x")),
        max_dims,
    )
    rows.sort(key=lambda r: r[0])
    return [float(r[1]) for r in rows], [float(r[2]) for r in rows]


def sq8_encode(base: DataFrame, vector: str = "embedding", out: str = "code") -> DataFrame:
    """One byte (0..255) per dimension, scaled to the range of that dimension."""
    low, high = dimension_ranges(base, vector)
    lows = F.lit(low)
    spans = F.lit([(h - l) or 1.0 for l, h in zip(low, high)])
    code = F.transform(
        vector,
        lambda x, i: F.round((x.cast("double") - F.get(lows, i)) / F.get(spans, i) * 255).cast("int"),
    )
    return base.withColumn(out, code)


def sq8_decode(codes: DataFrame, low: list, high: list, code: str = "code", out: str = "embedding") -> DataFrame:
    lows = F.lit(low)
    spans = F.lit([(h - l) or 1.0 for l, h in zip(low, high)])
    return codes.withColumn(out, F.transform(code, lambda c, i: F.get(lows, i) + c / 255 * F.get(spans, i)))


def pq_encode(
    base: DataFrame, parts: int, codes: int, vector: str = "embedding", out: str = "code", seed: int = 7
) -> tuple[DataFrame, list[np.ndarray]]:
    """Product codes: per slice of the vector the number of its nearest codebook entry."""
    dims = base.select(F.size(vector)).first()[0]
    if dims % parts:
        raise ValueError(f"{dims} dimensions do not split into {parts} equal parts")
    width = dims // parts
    coded, books = base, []
    for p in range(parts):
        piece = coded.withColumn("_v", array_to_vector(F.slice(vector, p * width + 1, width)))
        model = KMeans(k=codes, seed=seed, featuresCol="_v", predictionCol=f"_c{p}", maxIter=5).fit(piece)
        books.append(np.array(model.clusterCenters()))
        coded = model.transform(piece).drop("_v")
    names = [f"_c{p}" for p in range(parts)]
    return coded.withColumn(out, F.array(*names)).drop(*names), books

