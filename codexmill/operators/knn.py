"""Exact nearest neighbours of a table of queries: packed blocks of both sides met by one shuffle.

The corpus is scanned once: each Arrow batch becomes a packed block, dealt to one of the join's
cells. Queries are packed too, and every cell gets all their blocks, so no vector passes the driver
and more queries don't mean more scans. A task multiplies each of its corpus blocks with each query
block and keeps k rows a query on the way, so k rows a query and cell are all that goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a packed block; best rows of all queries that a task holds before it hands them on.
BLOCK, HELD = 4096, 1 << 22
#: Decimals of a distance: equal vectors tie, wherever they stand in a product.
PLACES = 12


def _unit(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: (row numbers, unit vectors) of the rows that have a direction."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    ends, out = np.cumsum(size), {}
    for dim in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == dim)
        x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        length = np.linalg.norm(x, axis=1)
        good = np.isfinite(length) & (length > 0)
        out[int(dim)] = rows[good], x[good] / length[good, None]
    return out


def packed(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(dim, ids, data) blocks of at most BLOCK rows: unit vectors as bytes, ids in order."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, (at, x) in _unit(b.column(1)).items():
                for a in range(0, len(at), BLOCK):
                    ids = b.column(0).take(pa.array(at[a : a + BLOCK]))
                    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), lists, pa.array([x[a : a + BLOCK].tobytes()], pa.binary())], ["dim", "ids", "data"])

    return rows.select(F.col(id_col), F.col(vector)).mapInArrow(run, f"dim int, ids array<{kind}>, data binary")


class Best:
    """The k nearest so far of each query of a block, as flat arrays ordered by (query, distance, id)."""

    def __init__(self, n: int, k: int):
        self.k, self.edge = k, np.full(n, np.inf)
        self.query, self.distance, self.ids = np.zeros(0, int), np.zeros(0), None

    def add(self, distance: np.ndarray, ids: np.ndarray) -> None:
        """``distance`` has a row for each new id and a column for each query."""
        edge = self.edge
        if len(ids) > self.k:
            edge = np.minimum(edge, np.partition(distance, self.k - 1, axis=0)[self.k - 1])
        row, query = np.nonzero(distance <= edge)
        if not len(row):
            return
        q, d = np.concatenate([self.query, query]), np.concatenate([self.distance, distance[row, query]])
        i = ids[row] if self.ids is None else np.concatenate([self.ids, ids[row]])
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.query, self.distance, self.ids = q[keep], d[keep], i[keep]
        full = rank == self.k - 1
        self.edge[q[full]] = d[full]


def nearest_batch(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest rows of each query, exact.

    Rows and queries whose vector is null, zero, not finite or of another length than the other
    side's are near nothing; ties go to the smaller id. Rows that repeat an id each count, and so do
    queries. An empty side gives an empty result; other columns are not used.
    """
    spark = corpus.sparkSession
    kind_id, kind_q = dict(corpus.dtypes)[id_col], dict(queries.dtypes)[query_id]
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = packed(corpus, id_col, vector).withColumn("cell", F.pmod(F.xxhash64("data"), F.lit(cells)))
    asked = packed(queries, query_id, vector).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.xxhash64("data").alias("q_key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"))
    met = blocks.join(asked.hint("shuffle_hash"), ["cell", "dim"]).select("dim", "ids", "data", "q_ids", "q_data", "q_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, tuple[Best, pa.Array]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for b, names in best.values():
                for a in range(0, len(b.query), 1 << 16):
                    at = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(b.query[at])), pa.array(b.ids[at], kind), pa.array(b.distance[at])], [query_id, id_col, "distance"])
            best.clear()

        kind = None
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column("dim")[row].as_py()
                ids, names = batch.column("ids")[row].values, batch.column("q_ids")[row].values
                kind = ids.type
                x, q = (np.frombuffer(batch.column(c)[row].as_py(), float).reshape(-1, dim) for c in ("data", "q_data"))
                key = (dim, len(names), batch.column("q_key")[row].as_py(), names[0].as_py())
                if key not in best:
                    if sum(len(b.edge) for b, _ in best.values()) * k > HELD:
                        yield from told()
                    best[key] = Best(len(names), k), names
                best[key][0].add(np.round(1.0 - x @ q.T, PLACES), np.asarray(ids))
        yield from told()

    near = met.mapInArrow(run, f"`{query_id}` {kind_q}, `{id_col}` {kind_id}, distance double")
    order = Window.partitionBy(query_id).orderBy("distance", id_col)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
