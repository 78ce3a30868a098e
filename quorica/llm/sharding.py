"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a key of KEY_BYTES bytes: digest of the text, digest of the id, and a row number that tells equal
rows apart. Equal texts are neighbours, and no key is shared, so a hot text can be cut like any other stretch of keys.

1. Rows with their keys are written once.
2. Rounds of counting: the key space is cut at candidate boundaries, every partition adds up rows and bytes between
   them, and the sums over partitions say exactly how much lies below each boundary. A stretch is probed further if the
   end of a shard falls into it and none of its edges is within TOLERANCE of a shard's bytes, or if it holds more rows than a
   piece may. Sums also carry the least and the largest key, so a hot text is isolated within few rounds. Probes fall between
   texts as long as a stretch holds several, so a shard ends inside a group of equal texts only where that group is larger than
   the tolerance.
3. Neighbouring stretches of one shard become pieces of some PIECE_ROWS rows. The rows are exchanged once, by piece;
   the row number within the piece plus the rows of the pieces before it in its shard is the slot.

The driver holds sums and boundaries only: PROBES sums a round, or LEAST_PROBES for every stretch that is still open
(each has more than PIECE_ROWS rows, or the end of a shard), and about one boundary per PIECE_ROWS rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorica.llm.common import free_names, stored

SHARDS = 8
TOLERANCE = 0.005
PIECE_ROWS = 1 << 20
PROBES = 4096
LEAST_PROBES = 8
COUNT_ROWS = 1 << 16
KEY_BYTES = 24
TEXT_BYTES = 8
_SPACE = 1 << (8 * KEY_BYTES)
_TEXT_STEP = 1 << (8 * (KEY_BYTES - TEXT_BYTES))
_COUNTED = "gap int, rows long, bytes long, least binary, most binary"
_COUNTED_ARROW = pa.schema(
    [("gap", pa.int32()), ("rows", pa.int64()), ("bytes", pa.int64()), ("least", pa.binary()), ("most", pa.binary())]
)


@dataclass(frozen=True)
class Stretch:
    """All rows from the key `least` to the key `most`, both of which are present."""

    least: int
    most: int
    rows: int
    bytes: int


@dataclass(frozen=True)
class Piece:
    """A range of keys from `low` on that lies in one shard, and the rows of the shard before it."""

    low: int
    shard: int
    before: int


def _bytes_of(key: int) -> bytes:
    return key.to_bytes(KEY_BYTES, "big")


def _as_keys(column) -> np.ndarray:
    """A fixed-width numpy array; its order is that of unsigned bytes, as in Spark."""
    return np.array(column, f"S{KEY_BYTES}")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and sizes of some COUNT_ROWS rows at a time."""
    keys, sizes, held = [], [], 0
    for batch in batches:
        keys.append(_as_keys(batch.column(0).to_pylist()))
        sizes.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= COUNT_ROWS:
            yield np.concatenate(keys), np.concatenate(sizes)
            keys, sizes, held = [], [], 0
    if held:
        yield np.concatenate(keys), np.concatenate(sizes)


def _between(edges: list[int]):
    """Partial sums of a partition over the gaps between the edges: gap i holds keys in [edges[i], edges[i + 1])."""
    bounds = np.array([_bytes_of(e) for e in edges], f"S{KEY_BYTES}")
    gaps = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = np.zeros(gaps, np.int64), np.zeros(gaps, np.int64)
        least: dict[int, bytes] = {}
        most: dict[int, bytes] = {}
        for keys, sizes in _gathered(batches):
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            sizes = np.concatenate([[0], np.cumsum(sizes[order])])
            # Places of the edges in the ordered keys give the sums of all gaps at once.
            places = np.concatenate([np.searchsorted(keys, bounds, side="left"), [len(keys)]])
            rows += np.diff(places)
            total += np.diff(sizes[places])
            for gap in np.flatnonzero(np.diff(places)).tolist():
                first, last = keys[places[gap]], keys[places[gap + 1] - 1]
                least[gap] = min(least.get(gap, first), first)
                most[gap] = max(most.get(gap, last), last)
        held = sorted(least)
        wide = [[end[g].ljust(KEY_BYTES, b"\0") for g in held] for end in (least, most)]
        columns = [held, rows[held], total[held], *wide]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED_ARROW)], schema=_COUNTED_ARROW)

    return run


def count_between(keyed: DataFrame, edges: list[int]) -> list[Stretch]:
    """The stretches between neighbouring edges that hold rows; rows below the first edge aren't counted."""
    parts = keyed.mapInArrow(_between(edges), _COUNTED)
    sums = parts.groupBy("gap").agg(
        F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    found = [
        Stretch(int.from_bytes(r.least, "big"), int.from_bytes(r.most, "big"), r.rows, r.bytes)
        for r in sums.collect()  # one row per gap
    ]
    return sorted(found, key=lambda s: s.least)


def probes(stretch: Stretch, n: int) -> list[int]:
    """Up to n candidate boundaries inside a stretch, the first one at its least key; between texts if it has several."""
    low, span = stretch.least, stretch.most - stretch.least
    step = _TEXT_STEP if stretch.least // _TEXT_STEP != stretch.most // _TEXT_STEP else 1
    inner = {(low + span * i // n) // step * step for i in range(1, n)} | {stretch.most // step * step}
    return [low, *sorted(at for at in inner if low < at <= stretch.most)]


def refine(keyed: DataFrame, shards: int, tolerance: float, piece_rows: int, n_probes: int) -> tuple[list[Stretch], list[int]]:
    """Stretches in key order, and the place after the last stretch of each shard."""
    stretches = count_between(keyed, [0])
    total = sum(s.bytes for s in stretches)
    while True:
        upto = np.cumsum([0, *(s.bytes for s in stretches)]).tolist()
        open_places = {i for i, s in enumerate(stretches) if s.rows > piece_rows and s.least < s.most}
        for shard in range(1, shards):
            goal = total * shard / shards
            at = bisect_right(upto, goal) - 1
            if at < len(stretches) and min(goal - upto[at], upto[at + 1] - goal) > tolerance * total / shards:
                if stretches[at].least < stretches[at].most:
                    open_places.add(at)
        if not open_places:
            break
        each = max(LEAST_PROBES, n_probes // len(open_places))
        kept = [s for i, s in enumerate(stretches) if i not in open_places]
        edges: list[int] = []
        for i in sorted(open_places):
            # An edge behind each stretch ends its last gap, so that keys of others stay out of it.
            edges += [*probes(stretches[i], each), stretches[i].most + 1]
        edges = sorted({e for e in edges if e < _SPACE})
        inside = F.lit(False)
        spans = [(_bytes_of(stretches[i].least), _bytes_of(stretches[i].most)) for i in sorted(open_places)]
        if len(spans) <= shards:  # a few narrow stretches: other rows needn't leave the scan
            for low, high in spans:
                inside = inside | F.col("key").between(F.lit(low), F.lit(high))
            rows = keyed.where(inside)
        else:
            rows = keyed
        refined = count_between(rows, edges)
        probed = [stretches[i] for i in sorted(open_places)]
        starts = [s.least for s in probed]
        for s in refined:
            of = bisect_right(starts, s.least) - 1
            if of >= 0 and s.most <= probed[of].most:
                kept.append(s)
        stretches = sorted(kept, key=lambda s: s.least)
    upto = np.cumsum([0, *(s.bytes for s in stretches)])
    goals = total * np.arange(1, shards) / shards
    cuts = [int(np.abs(upto - goal).argmin()) for goal in goals]
    return stretches, [*np.maximum.accumulate(np.array(cuts, np.int64)).tolist(), len(stretches)]


def pieces(stretches: list[Stretch], cuts: list[int], piece_rows: int) -> list[Piece]:
    """Neighbouring stretches of a shard, together up to `piece_rows` rows where none alone holds more."""
    made: list[Piece] = []
    start = 0
    for shard, end in enumerate(cuts):
        before = held = 0
        for s in stretches[start:end]:
            if not before + held or held + s.rows > piece_rows:
                before, held = before + held, 0
                made.append(Piece(s.least, shard, before))
            held += s.rows
        start = max(start, end)
    return made


def _place(cut: list[Piece]):
    """A function of the key alone: piece, shard and the rows before the piece in its shard."""
    bounds = np.array([_bytes_of(p.low) for p in cut], f"S{KEY_BYTES}")
    made = pd.DataFrame({"piece": range(len(cut)), "shard": [p.shard for p in cut], "before": [p.before for p in cut]})

    @F.pandas_udf("piece int, shard int, before long")
    def place(key: pd.Series) -> pd.DataFrame:
        return made.iloc[np.searchsorted(bounds, _as_keys(key.tolist()), side="right") - 1].reset_index(drop=True)

    return place


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one for the end of the record; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _hex(number: Column) -> Column:
    return F.lpad(F.hex(number), 16, "0")


def sharded(
    docs: DataFrame,
    shards: int = SHARDS,
    text: Column | None = None,
    size: Column | None = None,
    tolerance: float = TOLERANCE,
    piece_rows: int = PIECE_ROWS,
    n_probes: int = PROBES,
) -> DataFrame:
    """(row, size, shard, slot) of every row of `docs`: shards of near-equal bytes, gapless slots from 0 in each.

    `row` holds the input columns, so their names are free; `doc_id` is one of them. `text` (default: the column text) is what
    the order follows and equal values of which stay together, as far as sizes stay equal; a null counts as
    empty. Rows of equal text are ordered by id, null as a value of its own; wholly equal rows are interchangeable. Sizes
    differ from a shard's share by some TOLERANCE of it and by half the largest row at each end; one row, however long, is
    never cut. An empty table has an empty result; with fewer rows than shards some shards stay empty.
    """
    text = F.col("text") if text is None else text
    size = text_size(text) if size is None else size
    digests = [F.xxhash64(F.coalesce(text, F.lit(""))), F.xxhash64("doc_id"), F.xxhash64(F.monotonically_increasing_id())]
    keyed = stored(
        docs.select(F.unhex(F.concat(*map(_hex, digests))).alias("key"), size.alias("size"), F.struct("*").alias("row")), "keyed"
    )
    stretches, cuts = refine(keyed.select("key", "size"), shards, tolerance, piece_rows, n_probes)
    cut = pieces(stretches, cuts, piece_rows)
    placed = keyed.withColumn("at", _place(cut)("key")).select("key", "row", "size", "at.*")
    in_order = F.row_number().over(Window.partitionBy("piece").orderBy("key"))
    return placed.withColumn("slot", F.col("before") + in_order - 1).select("row", "size", "shard", "slot")


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document; texts stay at the scan."""
    text = F.col("text")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).cast("string").alias("text"),
    )
    return sharded(narrow, shards, size=F.col("size")).select(
        "row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the documents below `path`, a folder per shard; files hold whole pieces in slot order, with the slot."""
    slot, shard = free_names(docs, "slot", "shard")
    rows = sharded(docs, shards).select("row.*", F.col("slot").alias(slot), F.col("shard").alias(shard))
    rows.write.partitionBy(shard).option("compression", "zstd").parquet(path)
