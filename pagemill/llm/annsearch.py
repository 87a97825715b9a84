"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are scaled to unit length and rounded to int8 with a scale of their own; what rounding took is kept as a norm.
The rows of all vectors and the stated queries are dealt over a grid of blocks; a block multiplies its two int8 tiles
(exact integers in float32) and bounds each cosine by the rounding norms (Cauchy-Schwarz).  A pair survives a
tile if its upper bound reaches the k-th best lower bound that its query has seen in the block.  Survivors are
recomputed from the original vectors in double precision and kept in a heap of k per query; the heaps of all
blocks are merged at the end.  The bounds are proven, so the k nearest are exact.

Defined cases: vectors that are null, zero, empty or hold a null or non-finite component take no part, neither do pairs
of different length meet; components of any finite size count, as vectors are scaled by a power of two; a query's own id is no candidate; repeated rows are candidates each; of rows that repeat a
query's id every different vector asks, and the best k of all stay; ties go to the smaller id; an empty table gives
an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of one block of the grid, at most about; and of one tile.
ROWS, QUERIES = 32_768, 4_096
TILE_ROWS, TILE_QUERIES = 4_096, 512
#: Components up to which sums of int8 products stay exact in float32.
EXACT = 1024


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise sums of products in double precision, component by component from the first."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Side:
    """One side of a block: vectors of one length with their int8 form and rounding norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        # the order of ids makes ties and batches alike on every run
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        # a power of two takes no bit and changes no cosine, and no product of components leaves the doubles' range
        _, power = np.frexp(np.abs(self.vectors).max(axis=1))
        self.vectors = np.ldexp(self.vectors, -power[:, None])
        self.square = dot(self.vectors, self.vectors)
        top = np.abs(self.vectors).max(axis=1, keepdims=True)
        unit = self.vectors / top
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        whole = np.rint(unit / self.scale[:, None])
        self.small = whole.astype(np.int8)
        near = whole * self.scale[:, None]
        self.near = np.sqrt((near * near).sum(axis=1))
        # what rounding took, and a little for the arithmetic itself
        self.lost = np.sqrt(((unit - near) ** 2).sum(axis=1)) + 1e-12


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of two int8 tiles."""
    if a.shape[1] <= EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum(product(a[:, i : i + EXACT], b[:, i : i + EXACT]).astype(np.float64) for i in range(0, a.shape[1], EXACT))


def search(queries: Side, rows: Side, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query id, row id and score of the k best rows of the block for each query."""
    for q in range(0, len(queries.ids), TILE_QUERIES):
        qs = slice(q, q + TILE_QUERIES)
        n = len(queries.ids[qs])
        best_score, best_id, best_row = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)
        for r in range(0, len(rows.ids), TILE_ROWS):
            rs = slice(r, r + TILE_ROWS)
            about = product(queries.small[qs], rows.small[rs]) * (queries.scale[qs, None] * rows.scale[None, rs])
            error = queries.near[qs, None] * rows.lost[None, rs] + queries.lost[qs, None] * (rows.near + rows.lost)[None, rs] + 1e-6 * np.abs(about) + 1e-9
            own = queries.ids[qs, None] == rows.ids[None, rs]
            low = np.where(own, -np.inf, about - error)
            m = min(k, low.shape[1])
            floor = np.partition(low, low.shape[1] - m, axis=1)[:, low.shape[1] - m] if m == k else np.full(n, -np.inf)
            floor = np.maximum(floor, best_score[:, -1] - 1e-9)
            i, j = np.nonzero((about + error >= floor[:, None]) & ~own)
            if not i.size:
                continue
            score = dot(queries.vectors[qs][i], rows.vectors[rs][j]) / (np.sqrt(queries.square[qs][i]) * np.sqrt(rows.square[rs][j]))
            # heaps of k: the old ones and the survivors, by query, score and id
            i = np.concatenate([np.repeat(np.arange(n), k), i])
            score, ids = np.concatenate([best_score.ravel(), score]), np.concatenate([best_id.ravel(), rows.ids[rs][j]])
            row = np.concatenate([best_row.ravel(), r + j])
            order = np.lexsort((row, ids, -score, i))
            i, score, ids, row = i[order], score[order], ids[order], row[order]
            rank = np.arange(i.size) - np.searchsorted(i, i)
            stay = rank < k
            best_score, best_id, best_row = (x[stay].reshape(n, k) for x in (score, ids, row))
        i, j = np.nonzero(best_row >= 0)
        yield queries.ids[qs][i], best_id[i, j], best_score[i, j]


def _sides(table: pa.Table) -> dict[int, Side]:
    """The sound vectors of a block by length."""
    lists = table.column(1).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], table.schema.field(1).type)
    ids, length = table.column(0).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(length)
    return {int(d): Side(ids[length == d], flat[np.repeat(length == d, length)].reshape(-1, d)) for d in np.unique(length) if d and ends.size}


def _block(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def block(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and rows.num_rows:
            asked, there = _sides(queries.select(["id", "v"])), _sides(rows.select(["id", "v"]))
            for d in asked.keys() & there.keys():
                found += [pa.table(list(map(pa.array, x)), schema=schema) for x in search(asked[d], there[d], k)]
        return pa.concat_tables([schema.empty_table(), *found])

    return block


def sound(column: str):
    """Neither null nor zero, all components finite."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``queries``: the condition that states the query set.  Returns query_id, rank, vec_id, score."""
    rows = vectors.where(sound(vector_col)).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    asked = vectors.where(sound(vector_col) & queries).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where("id is not null").distinct()
    n, m = rows.count(), asked.count()
    high, wide = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    hashed = F.xxhash64("id", "v")
    left = asked.select("id", "v", F.pmod(hashed, F.lit(wide)).cast("int").alias("j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))
    right = rows.where("id is not null").select("id", "v", F.pmod(hashed, F.lit(high)).cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_block(k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

