"""Hard negatives by slot-decomposed selection.

A negative suits a positive if its score lies in a window below the positive's score. The windows of an anchor's positives
overlap, so they aren't searched one by one:

1. Positives: the best rows of the anchor's own label, kept per task and merged by Spark.
2. The upper limits of the positives, in falling order, split the scores into disjoint slots; a score is in the slot of the
   smallest limit it does not exceed. Every task keeps the k best negatives of every slot, and Spark keeps the k best
   of these, so a slot has k rows in the end, however many rows match.
3. A positive's window reaches from its limit down, which are its own slot and all later ones. The slots of an
   anchor, merged in falling order, hold the best k of every such suffix; the lower limit cuts them.

Anchors meet all rows in blocks: a chunk of CHUNK_BYTES of anchors at most is broadcast, and every task streams its part of the
rows past it, as products of tiles. Nothing but the kept rows is shuffled. Chunks follow each other, so memory doesn't
depend on the number of anchors; a lost executor costs its tasks of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorica.llm.common import stored
from quorica.llm.vectors import (
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

SCALE = 256
ANCHORS = "vec_id % 100 = 0"
POSITIVES = 5
NEGATIVES = 5
LOW_PERCENT = 80
HIGH_PERCENT = 100
_HITS = "uid long, slot int, first int, id long, nameless boolean, score long, exact binary"
_HIT_COLUMNS = ["uid", "slot", "first", "id", "nameless", "score", "exact"]


def _limits(scores: list[list[int]], n: int, wide: bool, percent: int, up: bool) -> np.ndarray:
    """percent of each positive's score in whole numbers, rounded towards the window; -inf where there is no positive."""
    out = np.full((len(scores), n), -np.inf, object if wide else np.float64)
    for i, row in enumerate(scores):
        for j, score in enumerate(row):
            out[i, j] = -(-percent * score // 100) if up else percent * score // 100
    return out


def _emit(uids: np.ndarray, slots: int, best: Leaders) -> Iterator[pa.RecordBatch]:
    if best.columns:
        group, score, id, nameless, first = best.columns
        columns = [pa.array(uids[group // slots]), pa.array((group % slots).astype(np.int32)), pa.array(first.astype(np.int32))]
        columns += [pa.array(id), pa.array(nameless), *score_columns(score)]
        yield pa.RecordBatch.from_arrays(columns, names=_HIT_COLUMNS)


def _tiles(batches, asked, dims: int, reach: float):
    """(range of anchors, block, scores, whether labels agree, whether it is another row) of every tile."""
    uids, ids, labels, v = asked
    for block in blocks(batches):
        known = matrix(block.column("v"), dims)
        id = block.column("id").to_numpy()
        nameless = block.column("nameless").to_numpy(zero_copy_only=False)
        label = block.column("label").to_numpy()
        for start in range(0, len(uids), TILE_ROWS):
            rows = slice(start, start + TILE_ROWS)
            scores = products(v[rows], known, reach)
            other = (ids[rows, None] != id) | nameless
            yield start, id, nameless, scores, labels[rows, None] == label, other


def _find_positives(held, dims: int, reach: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, _ = held.value
        best = Leaders(len(asked[0]), k, wide=reach >= 1 << 53)
        for start, id, nameless, scores, same, other in _tiles(batches, asked, dims, reach):
            mine = np.arange(start, start + len(scores))
            suits = same & other
            if scores.dtype != object and scores.shape[1] > k:
                # Only the k best of a tile and their equals can count.
                masked = np.where(suits, scores, -np.inf)
                kth = np.partition(masked, -k, axis=1)[:, -k]
                suits &= scores >= kth[:, None]
            row, at = np.nonzero(suits & best.may_enter(mine[:, None], scores, id))
            if len(row):
                best.offer(mine[row], scores[row, at], id[at], nameless[at], np.zeros(len(row), np.int64))
        yield from _emit(asked[0], 1, best)

    return run


def _find_negatives(held, dims: int, reach: float, n_positives: int, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, positives = held.value
        wide = reach >= 1 << 53
        uppers = _limits(positives, n_positives, wide, high, up=False)
        lowers = _limits(positives, n_positives, wide, low, up=True)
        best = Leaders(len(asked[0]) * n_positives, k, wide)
        for start, id, nameless, scores, same, other in _tiles(batches, asked, dims, reach):
            upper, lower = (limit[start : start + len(scores)] for limit in (uppers, lowers))
            row, at = np.nonzero((scores <= upper[:, :1]) & ~same & other)
            score = scores[row, at]
            slot = (score[:, None] <= upper[row]).sum(axis=1) - 1
            # Lower limits fall too: windows up to the one before `first` end above the score.
            first = (score[:, None] < lower[row]).sum(axis=1)
            group = (start + row) * n_positives + slot
            suits = (first <= slot) & best.may_enter(group, score, id[at])
            if suits.any():
                at = at[suits]
                best.offer(group[suits], score[suits], id[at], nameless[at], first[suits])
        yield from _emit(asked[0], n_positives, best)

    return run


def _passes(asked: DataFrame, n: int, vectors: DataFrame, dims: int, search, name: str) -> list[DataFrame]:
    """Hits of every chunk of anchors, each written before the next chunk is fetched."""
    spark = vectors.sparkSession
    found = []
    for chunk in range(n):
        table = asked.where(F.col("chunk") == chunk).toArrow()  # CHUNK_BYTES of vectors, a parameter
        table = table.combine_chunks()
        columns = [table.column(c).to_numpy() for c in ("uid", "id", "label")]
        v = matrix(table.column("v"), dims)
        scores = [
            [s["score"] if s["exact"] is None else from_sortable(s["exact"]) for s in row or []]
            for row in table.column("positives").to_pylist()
        ]
        held = spark.sparkContext.broadcast(((*columns, v), scores))
        found.append(stored(vectors.mapInArrow(search(held), _HITS), f"{name}_{chunk}"))
        held.destroy()
    return found


def _best(hits: list[DataFrame], k: int) -> DataFrame:
    """The k best of every anchor and slot; each task sends k at most."""
    rows = hits[0]
    for more in hits[1:]:
        rows = rows.unionByName(more)
    place = F.row_number().over(Window.partitionBy("uid", "slot").orderBy(*by_score()))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchor: str = ANCHORS,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    low: int = LOW_PERCENT,
    high: int = HIGH_PERCENT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1 for each anchor and positive.

    `vectors` needs vec_id, label and embedding; `anchor` is a condition on vec_id that is false for null. An anchor's
    positives are its `n_positives` best other rows of the same label, its negatives the `n_negatives` best rows of other labels
    with low percent <= negative score / positive score <= high percent, in whole numbers, so a negative score of a
    positive leaves an empty window. Rows without label or whole vector take no part; shorter vectors
    count as padded with zeros; an empty table has an empty result. Rows with the anchor's own id are neither
    positives nor negatives of it. Equal scores go by smaller id, rows without id last; rows of equal id and score are
    interchangeable, and each repeated anchor row is an anchor. Scores are compared exactly; those beyond 64 bits are cut
    to the range when returned.
    """
    named = vectors.where("label IS NOT NULL").select(
        *identity(),
        F.col("label").cast("long").alias("label"),
        F.coalesce(F.expr(anchor), F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("uid"),
        "embedding",
    )
    whole = whole_vectors(named, SCALE, "scaled")
    _, dims, reach = reach_of(whole)
    asked = whole.where("asks AND NOT nameless").select("uid", "id", "label", "v")
    asked, n = chunked(asked, asked.count(), dims)
    rows = whole.select("id", "nameless", "label", "v")

    nothing = F.lit(None).cast("array<struct<score: long, exact: binary>>")
    hits = _passes(
        asked.withColumn("positives", nothing), n, rows, dims, lambda held: _find_positives(held, dims, reach, n_positives), "positives"
    )
    positives = stored(_best(hits, n_positives).withColumn("at", F.col("place") - 1), "positives")

    ordered = F.sort_array(F.collect_list(F.struct("at", "score", "exact")))  # n_positives at most
    limits = positives.groupBy("uid").agg(ordered.alias("p")).select(
        "uid", F.transform("p", lambda p: F.struct(p["score"].alias("score"), p["exact"].alias("exact"))).alias("positives")
    )
    hits = _passes(
        asked.join(limits, "uid"), n, rows, dims,
        lambda held: _find_negatives(held, dims, reach, n_positives, n_negatives, low, high), "negatives",
    )

    # Scores fall from slot to slot, so slots in order are the merged list: n_positives * n_negatives rows an anchor.
    entry = F.struct("slot", "place", "first", "id", "nameless", "score")
    merged = _best(hits, n_negatives).groupBy("uid").agg(F.sort_array(F.collect_list(entry)).alias("slots"))
    fits = F.filter("slots", lambda h: (h["slot"] >= F.col("at")) & (h["first"] <= F.col("at")))
    named_positive = positives.select(
        "uid", "at", F.when(~F.col("nameless"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score")
    )
    windows = named_positive.join(merged, "uid").join(asked.select("uid", F.col("id").alias("anchor_id")), "uid")
    picked = windows.select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(fits, 1, n_negatives)).alias("place", "hit")
    )
    return picked.select(
        "anchor_id",
        "positive_id",
        (F.col("place") + 1).alias("rank"),
        F.when(~F.col("hit.nameless"), F.col("hit.id")).alias("negative_id"),
        "positive_score",
        F.col("hit.score").alias("negative_score"),
    )


def mined_negatives(vectors: DataFrame) -> DataFrame:
    """The mining of the query's contract: where vec_id is divisible by 7 the label is the next one of ten."""
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(vectors.select("vec_id", moved.alias("label"), "embedding"))
