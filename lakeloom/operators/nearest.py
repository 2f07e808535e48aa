"""The nearest rows of each query, by a join of tiles: blocks of queries meet blocks of rows of the same cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import closer_sign, distances
from ..session import settle
from .bounded import broadcast_if_small

DIGITS = 6
FOUND = "query_id bigint, base_id bigint, distance double"
#: A tile holds about so many bytes of vectors on each side; a task works on one tile at a time.
TILE_BYTES = 8 << 20
#: Queries and rows whose distances are computed at a time.
STEP_QUERIES, STEP_ROWS = 512, 4096


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of an Arrow list column as one float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Closest:
    """The k closest rows so far of each query of a block; ties are settled by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.limit = np.full(queries, np.inf)
        self.query, self.who = np.empty(0, np.int64), np.empty(0, np.int64)
        self.far = np.empty(0)

    def add(self, far: np.ndarray, who: np.ndarray) -> None:
        """Rows `who` at sort keys `far` (queries x rows, lower is closer)."""
        limit = self.limit
        if far.shape[1] > self.k:
            # Everything up to the k-th distance, so that ties at it are still there.
            limit = np.minimum(limit, np.partition(far, self.k - 1, axis=1)[:, self.k - 1])
        query, at = np.nonzero(far <= limit[:, None])
        query, found, who = (
            np.concatenate([self.query, query]),
            np.concatenate([self.far, far[query, at]]),
            np.concatenate([self.who, who[at]]),
        )
        order = np.lexsort((who, found, query))
        query, found, who = query[order], found[order], who[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.limit[query[last]] = found[last]
        keep = place < self.k
        self.query, self.far, self.who = query[keep], found[keep], who[keep]

    def rows(self, ids: np.ndarray, sign: float) -> list[pa.Array]:
        return [pa.array(ids[self.query]), pa.array(self.who), pa.array(self.far * sign)]


def sort_keys(metric: str, base: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Rounded distances (queries x base) with the sign that makes lower closer."""
    return np.round(distances(metric, base, queries), DIGITS) * closer_sign(metric)


def _of_tile(metric: str, k: int):
    """Task function: the k closest rows of a tile for each of its queries."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and rows.num_rows:
            base, names = matrix(rows["row_vector"]), rows["row_id"].to_numpy()
            for q in range(0, asked.num_rows, STEP_QUERIES):
                some = asked.slice(q, STEP_QUERIES)
                points, best = matrix(some["query_vector"]), Closest(some.num_rows, k)
                for b in range(0, len(base), STEP_ROWS):
                    best.add(sort_keys(metric, base[b : b + STEP_ROWS], points), names[b : b + STEP_ROWS])
                out.append(best.rows(some["query_id"].to_numpy(), closer_sign(metric)))
        parts = [pa.concat_arrays(c) for c in zip(*out, strict=True)]
        parts = parts or [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())]
        return pa.Table.from_arrays(parts, names=["query_id", "base_id", "distance"])

    return run


def _block_rows(rows: DataFrame) -> int:
    """Rows of a block, from the width of the first vector; 0 without rows."""
    first = rows.select(F.size("vector")).first()
    return 0 if first is None else max(TILE_BYTES // (8 * max(first[0], 1)), 1)


def _in_tiles(asked: DataFrame, rows: DataFrame, k: int, metric: str) -> DataFrame:
    """Best rows of each tile; both sides have (id, vector, cell) and the cell's numbers query_blocks and row_blocks."""

    def placed(side: DataFrame, own: str, other: str) -> DataFrame:
        number = F.pmod(F.xxhash64("id", "vector"), F.col(f"{own}_blocks")).cast("int").alias(own)
        meets = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other)
        # New names for all columns, since both sides may come from one table.
        return side.select(*(F.col(c).alias(f"{own}_{c}") for c in ("id", "vector", "cell")), number, meets)

    queries = placed(asked, "query", "row").groupBy("query_cell", "query", "row")
    base = placed(rows, "row", "query").groupBy("row_cell", "query", "row")
    return queries.cogroup(base).applyInArrow(_of_tile(metric, k), FOUND)


def nearest_in_cells(asked: DataFrame, rows: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, base_id, distance): the k closest rows of each tile for its queries; the final ranking is `ranked`.

    Both sides have (id BIGINT, vector, cell INT) without nulls; a query may be in several cells. Rows and queries of a cell
    are cut into blocks of about `TILE_BYTES` by hashes, and each pair of blocks of one cell is a tile: a row is sent as
    often as its cell has blocks of queries, and the other way round. Neither a crowded nor an often asked cell makes a
    task larger than a tile, nothing passes the driver, and a tile sends k rows per query.
    """
    block = _block_rows(rows)
    if not block:
        return rows.sparkSession.createDataFrame([], FOUND)

    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    # One row per cell that is asked and holds rows.
    cuts = settle(blocks(asked, "query_blocks").join(blocks(rows, "row_blocks"), "cell"), "cuts")
    cuts = broadcast_if_small(cuts)
    return _in_tiles(asked.join(cuts, "cell"), rows.join(cuts, "cell"), k, metric)


def ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    """The k closest of all that was found, with their place; only k rows per query and task are shuffled."""
    near = F.col("distance").desc() if metric == "ip" else F.col("distance")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(near, "base_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def vectors_of(side: DataFrame, id_col: str, vector: str, *more) -> DataFrame:
    """(id, vector) and more columns; rows without an id or a vector are left out."""
    there = side.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
    return there.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("vector"), *more)


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "l2",
    query_id: str = "query_id",
    base_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Exact search with a query table of any size: every block of queries meets every block of rows, as tiles.

    Same rows as `search.knn`. Rows without an id or a vector are left out on both sides; ids are distinct on each side.
    """
    asked, rows = vectors_of(queries, query_id, vector), vectors_of(base, base_id, vector)
    block = _block_rows(rows)
    if not block:
        return ranked(rows.sparkSession.createDataFrame([], FOUND), k, metric)
    # The whole table is one cell.
    query_blocks, row_blocks = (max(-(-side.count() // block), 1) for side in (asked, rows))
    numbers = {"cell": F.lit(0), "query_blocks": F.lit(query_blocks), "row_blocks": F.lit(row_blocks)}
    return ranked(_in_tiles(asked.withColumns(numbers), rows.withColumns(numbers), k, metric), k, metric)


def with_cells(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, vector, cell): each query with each of its `probes` nearest cells."""
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_QUERIES):
                some = batch.slice(at, STEP_QUERIES)
                order = np.argsort(distances("l2", shared.value, matrix(some.column(1))), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))],
                    names=["id", "vector", "cells"],
                )

    kind = queries.schema["vector"].dataType.simpleString()
    placed = queries.mapInArrow(near, f"id bigint, vector {kind}, cells array<int>")
    return placed.select("id", "vector", F.explode("cells").alias("cell"))
