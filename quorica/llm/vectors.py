"""Vectors with whole components, exact products, and the best few of many scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from quorica.llm.common import stored

BLOCK_ROWS = 2048
TILE_ROWS = 512
CHUNK_BYTES = 1 << 25
NO_ID = (1 << 63) - 1
_EXACT = float(1 << 53)
_EDGE = 1 << 63
_SIGN = 1 << 15


def identity(vec_id: str = "vec_id") -> list[Column]:
    """A missing id as a flag: numpy has no whole number beside null."""
    id = F.col(vec_id).cast("long")
    return [F.coalesce(id, F.lit(NO_ID)).alias("id"), id.isNull().alias("nameless")]


def _scaled(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            there = lists.is_valid().to_numpy(zero_copy_only=False)
            batch, lists = batch.filter(pa.array(there)), lists.drop_null()
            x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            broken = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            whole = np.flatnonzero(broken[ends] == broken[ends - sizes])
            kept = batch.take(pa.array(whole))
            v = pa.array([x[ends[i] - sizes[i] : ends[i]].tobytes() for i in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], v], names=[*batch.schema.names[:-1], "v"])

    return run


def whole_vectors(rows: DataFrame, scale: int, name: str) -> DataFrame:
    """The columns of `rows` before the last, and v: floor(scale * x) of the last one as float64 bytes; written.

    Rows whose vector is null, or holds a null, NaN or infinite component, are left out.
    """
    *others, last = rows.columns
    typed = rows.select(*others, F.col(last).cast("array<double>").alias(last))
    schema = StructType(typed.schema.fields[:-1]).add("v", BinaryType())
    return stored(typed.mapInArrow(_scaled(scale), schema), name)


def reach_of(vectors: DataFrame) -> tuple[int, int, float]:
    """Rows, largest number of components and a bound on every product's size, in one pass over the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, dims, largest = 0, 0, 0.0
        for batch in batches:
            v = matrix(batch.column(0))
            rows, dims = rows + len(v), max(dims, v.shape[1])
            largest = max(largest, float(np.abs(v).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([dims]), pa.array([largest])], names=["n", "d", "x"])

    parts = vectors.select("v").mapInArrow(run, "n long, d long, x double")
    rows, dims, largest = parts.agg(F.sum("n"), F.max("d"), F.max("x")).first()
    return rows or 0, dims or 0, (largest or 0.0) ** 2 * (dims or 0)


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of v, shorter ones padded with zeros, to `dims` columns or to the longest row."""
    values = column.to_pylist()
    sizes = [len(v) // 8 for v in values]
    width = max(sizes, default=0) if dims is None else dims
    if all(size == width for size in sizes):
        return np.frombuffer(b"".join(values)).reshape(len(values), width)
    out = np.zeros((len(values), width))
    for i, value in enumerate(values):
        out[i, : sizes[i]] = np.frombuffer(value)
    return out


def products(left: np.ndarray, right: np.ndarray, reach: float) -> np.ndarray:
    """Exact products of all rows: float64 where every partial sum is exact, Python's whole numbers beyond."""
    if reach < _EXACT:
        return left @ right.T
    whole = np.vectorize(int, otypes=[object])
    return whole(left) @ whole(right).T


def sortable(score: int) -> bytes:
    """Bytes in the order of whole numbers of any size."""
    n = (score.bit_length() + 8) // 8
    return (_SIGN + n if score >= 0 else _SIGN - n).to_bytes(2, "big") + (score % (1 << 8 * n)).to_bytes(n, "big")


def from_sortable(key: bytes) -> int:
    n = abs(int.from_bytes(key[:2], "big") - _SIGN)
    return int.from_bytes(key[2 : 2 + n], "big") - (1 << 8 * n if int.from_bytes(key[:2], "big") < _SIGN else 0)


def score_columns(scores: np.ndarray) -> list[pa.Array]:
    """`score`, cut to 64 bits, and `exact`: sortable bytes of scores that may be longer, else null."""
    if scores.dtype != object:
        return [pa.array(scores.astype(np.int64)), pa.nulls(len(scores), pa.binary())]
    cut = [max(-_EDGE, min(_EDGE - 1, int(s))) for s in scores]
    return [pa.array(cut, pa.int64()), pa.array([sortable(int(s)) for s in scores], pa.binary())]


def by_score() -> list[Column]:
    """Higher scores first, then smaller ids, rows without id last."""
    return [F.desc("exact"), F.desc("score"), F.asc("id"), F.asc("nameless")]


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches gathered to some `rows` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def chunked(asked: DataFrame, rows: int, dims: int) -> tuple[DataFrame, int]:
    """`asked` with a column `chunk`, and the number of chunks: each has some CHUNK_BYTES of vectors.

    Rows are dealt by a hash of their unique uid, so chunks are even whatever the ids.
    """
    most = max(1, CHUNK_BYTES // (8 * max(dims, 1)))
    n = max(1, -(-rows // most))
    return asked.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(n))), n


class Leaders:
    """The k best of every group among all that was offered: higher score, then smaller id."""

    def __init__(self, groups: int, k: int, wide: bool):
        self.k = k
        self.floor = np.full(groups, -np.inf, object if wide else np.float64)
        self.floor_id = np.full(groups, NO_ID)
        self.columns: list[np.ndarray] = []

    def may_enter(self, group, score, id) -> np.ndarray:
        """Whether a score can still be among the k best of its group."""
        floor = self.floor[group]
        return (score > floor) | ((score == floor) & (id <= self.floor_id[group]))

    def offer(self, group: np.ndarray, score: np.ndarray, id: np.ndarray, nameless: np.ndarray, *more: np.ndarray) -> None:
        new = [group, score, id, nameless, *more]
        if self.columns:
            new = [np.concatenate(pair) for pair in zip(self.columns, new)]
        group, score, id, nameless = new[:4]
        falling = -score if score.dtype != object else -np.unique(score, return_inverse=True)[1]
        order = np.lexsort((nameless, id, falling, group))
        group = group[order]
        firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(group)) - np.repeat(firsts, np.diff(np.concatenate([firsts, [len(group)]])))
        kept = place < self.k
        self.columns = [column[order[kept]] for column in new]
        last = order[place == self.k - 1]
        self.floor[new[0][last]] = new[1][last]
        self.floor_id[new[0][last]] = new[2][last]
