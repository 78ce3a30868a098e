"""Exact top-k inner products over vectors sorted by length.

1. Vectors are dealt by descending length (one range shuffle, equal lengths by id) and written in that order. The
   second moments of all vectors give an orthogonal basis, the right singular vectors, whose leading axes hold
   most of the length.
2. Opening: the longest OPENING_ROWS of every task are multiplied out. The k-th best score a query has found over all tasks
   is its floor: nothing below it can be among the k best.
3. Search: every task streams its vectors past the queries, block by block. By Cauchy-Schwarz a block whose longest vector is c
   holds no score above |q||c|, so queries whose floor is higher skip it. For the others the partial product over
   the leading axes plus the product of the remaining lengths bounds every score; only pairs whose bound reaches the floor are
   multiplied out, in whole numbers. What a task finds raises its floors as it goes.
4. The k best of all tasks are ranked.

Queries are broadcast in chunks of CHUNK_BYTES, one after the other; vectors are not copied, and only scores at or above
a floor, k for each query and task at most, are shuffled. No step relies on the number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quorica.llm.common import stored
from quorica.llm.vectors import (
    BLOCK_ROWS,
    TILE_ROWS,
    Leaders,
    blocks,
    by_score,
    chunked,
    from_sortable,
    identity,
    matrix,
    products,
    reach_of,
    score_columns,
    whole_vectors,
)

SCALE = 64
K = 20
LEADING = 16
BASIS_DIMENSIONS = 1024
OPENING_ROWS = 1024
DENSE_SHARE = 0.1
PARTITION_ROWS = 1 << 20
_EXACT = 1 << 53
_MARGIN = 1e-9
_HITS = "uid long, query_id long, id long, nameless boolean, score long, exact binary"
_HIT_COLUMNS = ["uid", "query_id", "id", "nameless", "score", "exact"]


@F.pandas_udf(DoubleType())
def length_of(v: pd.Series) -> pd.Series:
    return pd.Series(np.linalg.norm(matrix(pa.array(v, pa.binary())), axis=1))


def _moments(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for block in blocks(batches):
            rows = matrix(block.column(0))[:, :dims]
            rows = np.pad(rows, ((0, 0), (0, dims - rows.shape[1])))
            rows = rows / np.abs(rows).max(initial=1.0)
            total += rows.T @ rows
        at, to = np.divmod(np.arange(dims * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(to), pa.array(total.ravel())], names=["at", "to", "x"])

    return run


def basis(vectors: DataFrame, dims: int) -> np.ndarray:
    """Orthogonal axes by falling share of the squared length. Any basis keeps the result exact; this one prunes.

    Only the first BASIS_DIMENSIONS components are rotated, which bounds what reaches the driver.
    """
    dims = min(dims, BASIS_DIMENSIONS)
    parts = vectors.select("v").mapInArrow(_moments(dims), "at long, to long, x double")
    sums = parts.groupBy("at", "to").agg(F.sum("x").alias("x")).toArrow()  # dims * dims numbers
    gram = np.zeros((dims, dims))
    gram[sums.column("at").to_numpy(), sums.column("to").to_numpy()] = sums.column("x").to_numpy()
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _sketch(v: np.ndarray, axes: np.ndarray, leading: int, margin: float) -> np.ndarray:
    """Leading axes, remaining length, and the length for a margin: the product of two sketches bounds that of the vectors.

    Rotating rounds; a relative margin on the lengths, put on one side, keeps the bound an upper one.
    """
    turned = np.hstack([v[:, : len(axes)] @ axes, v[:, len(axes) :]])
    rest = np.linalg.norm(turned[:, leading:], axis=1)
    return np.hstack([turned[:, :leading], rest[:, None], margin * np.linalg.norm(v, axis=1)[:, None]])


def _offer(best: Leaders, row: np.ndarray, score: np.ndarray, id: np.ndarray, nameless: np.ndarray) -> None:
    enters = best.may_enter(row, score, id)
    if enters.any():
        best.offer(row[enters], score[enters], id[enters], nameless[enters])


def _dense(best: Leaders, mine: np.ndarray, scores: np.ndarray, other: np.ndarray, id: np.ndarray, nameless: np.ndarray):
    """Offer a whole tile: the k best of each of its rows and their equals."""
    suits = other
    if scores.dtype != object and scores.shape[1] > best.k:
        kth = np.partition(np.where(other, scores, -np.inf), -best.k, axis=1)[:, -best.k]
        suits = other & (scores >= np.maximum(kth, best.floor[mine])[:, None])
    row, at = np.nonzero(suits)
    _offer(best, mine[row], scores[row, at], id[at], nameless[at])


def _search(held, axes: np.ndarray, dims: int, reach: float, k: int, leading: int, block_rows: int, opening: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, ids, q, floors = held.value
        wide = reach >= _EXACT
        best = Leaders(len(uids), k, wide)
        best.floor[:] = floors
        lengths = np.linalg.norm(q, axis=1)
        asked = _sketch(q, axes, leading, _MARGIN)
        stream = blocks(batches, block_rows if opening is None else min(block_rows, opening))
        for block in stream if opening is None else islice(stream, 1):
            c = matrix(block.column("v"), dims)
            id = block.column("id").to_numpy()
            nameless = block.column("nameless").to_numpy(zero_copy_only=False)
            known = _sketch(c, axes, leading, 1.0)
            longest = np.linalg.norm(c, axis=1).max(initial=0.0)
            for start in range(0, len(uids), TILE_ROWS):
                mine = np.arange(start, min(start + TILE_ROWS, len(uids)))
                if not wide:
                    mine = mine[lengths[mine] * longest * (1 + _MARGIN) + 1 >= best.floor[mine]]
                    if not len(mine):
                        continue
                    near = asked[mine] @ known.T >= (best.floor[mine] - 1e-6)[:, None]
                    share = np.count_nonzero(near) / near.size
                    if share <= DENSE_SHARE:
                        row, at = np.nonzero(near)
                        clear = (ids[mine[row]] != id[at]) | nameless[at]
                        row, at = mine[row[clear]], at[clear]
                        scores = np.einsum("ij,ij->i", q[row], c[at])
                        _offer(best, row, scores, id[at], nameless[at])
                        continue
                other = (ids[mine, None] != id) | nameless
                _dense(best, mine, products(q[mine], c, reach), other, id, nameless)
        if best.columns:
            group, score, id, nameless = best.columns
            columns = [pa.array(uids[group]), pa.array(ids[group]), pa.array(id), pa.array(nameless), *score_columns(score)]
            yield pa.RecordBatch.from_arrays(columns, names=_HIT_COLUMNS)

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(*by_score()))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, query: str = "vec_id % 20 = 0", k: int = K, block_rows: int = BLOCK_ROWS, leading: int = LEADING
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows.

    `vectors` needs vec_id and embedding; `query` is a condition on vec_id that is false for null. Components become
    floor(64 * x). Vectors that are null or hold a null, NaN or infinite component take no part; an empty table has an empty
    result. Shorter vectors count as padded with zeros. Rows with the query's own id are not its candidates; of repeated
    query rows each is a query, of which results of equal id and vector are the same. Candidates of null id come last
    among equal scores. Ranks follow the exact products, whatever their size; a score beyond 64 bits is cut to the
    range when it is returned.
    """
    spark = vectors.sparkSession
    named = vectors.select(
        *identity(), F.coalesce(F.expr(query), F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("uid"), "embedding"
    )
    whole = whole_vectors(named, SCALE, "scaled")
    rows, dims, reach = reach_of(whole)
    dims = max(dims, 1)
    axes = basis(whole, dims) if rows else np.eye(1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))
    ordered = whole.select("id", "nameless", "v", length_of("v").alias("length"))
    by_length = [F.desc("length"), F.asc("id")]
    ordered = stored(ordered.repartitionByRange(parts, *by_length).sortWithinPartitions(*by_length), "ordered")
    ordered = ordered.select("id", "nameless", "v")

    queries = whole.where("asks AND NOT nameless").select("uid", "id", "v")
    queries, n = chunked(queries, queries.count(), dims)
    found = None
    for chunk in range(n):
        asked = queries.where(F.col("chunk") == chunk)
        floors = None
        for opening in (OPENING_ROWS, None):
            table = asked if floors is None else asked.join(floors, "uid", "left")
            table = table.toArrow()  # CHUNK_BYTES of vectors, a parameter
            floor = np.full(table.num_rows, -np.inf, object if reach >= _EXACT else np.float64)
            if floors is not None:
                for i, (score, exact) in enumerate(zip(table.column("score").to_pylist(), table.column("exact").to_pylist())):
                    if score is not None:
                        floor[i] = score if exact is None else from_sortable(exact)
            columns = [table.column(c).to_numpy() for c in ("uid", "id")]
            held = spark.sparkContext.broadcast((*columns, matrix(table.column("v"), dims), floor))
            search = _search(held, axes, dims, reach, k, leading, block_rows, opening)
            hits = stored(ordered.mapInArrow(search, _HITS), f"hits_{chunk}")
            held.destroy()
            floors = _ranked(hits, k).where(F.col("rank") == k).select("uid", "score", "exact")
        found = hits if found is None else found.unionByName(hits)
    return _ranked(found, k).select("query_id", "rank", F.when(~F.col("nameless"), F.col("id")).alias("vec_id"), "score")
