"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of at least max(6, 4 * q) words with smallest period q that cannot be extended. The words of many texts
are laid end to end as numbers, a different mark after each text, so that whole batches are searched at once:

1. Periods up to SHORT: words are compared with those q places on; stretches of equal words are the runs.
2. Longer periods, by scales K = 2 * SHORT, 4 * SHORT and so on: scale K finds the periods in (K/2, K]. Every place has the
   hash of the K words from it, built from two hashes of the scale below. Of any K/2 places in a row the one with the
   least hash is a minimizer (all, if several tie). In a run of period q in (K/2, K] the first K/2 places and those q on
   hold the same grams, as K/2 + K < 3q, hence a minimizer and its copy q places on are both selected; and a gram as long
   as the period comes again after whole periods only, so the two are neighbours among equal minimizers.
3. Neighbours at a distance in (K/2, K] seed a comparison of the words themselves, extended both ways by doubling steps.
   Equal hashes of different grams therefore cost time but add no run; to hide one, a chance equality of 64 bits must fall
   between all pairs of a run.
4. A stretch found with several periods keeps the smallest: the others are its multiples.

Scales whose runs need more words than a text has skip that text. Work is linear in the words of a text times the
logarithm of its length, and no text meets another one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorica.llm.common import free_names

SHORT = 4
LEAST_WORDS = 6
LEAST_PERIODS = 4
SLICE_BYTES = 1 << 21
_SEED = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours: running minima of blocks from both sides meet."""
    n = len(x)
    whole = -(-n // width) * width
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some `width` neighbours, in order."""
    least = window_min(grams, width)
    edge = np.zeros(width - 1, np.uint64)
    # A place holds a minimum if the largest minimum of the windows over it is its own value.
    around = np.concatenate([edge, least, edge])
    most = ~window_min(~around, width)
    return np.flatnonzero(most == grams)


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the groups of neighbouring places in an ordered array."""
    if not len(equal):
        return equal, equal
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(equal) != 1]))
    return equal[firsts], np.diff(np.concatenate([firsts, [len(equal)]]))


def _reach(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """Last place in direction `step` up to which words equal those `lag` later; `at` itself does."""
    size = 64
    last = len(words) - lag - 1
    while True:
        low, high = (at + 1, min(at + size, last)) if step > 0 else (max(at - size, 0), at - 1)
        if low > high:
            return at
        unequal = words[low : high + 1] != words[low + lag : high + lag + 1]
        if unequal.any():
            return low + int(unequal.argmax()) - 1 if step > 0 else high - int(unequal[::-1].argmax()) + 1
        at = high if step > 0 else low
        size *= 2


def _needed(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def find_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period.

    `words` holds numbers of words, texts by falling length, each followed by a mark of its own; `sizes` are the
    lengths of the texts without marks.
    """
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, period: int) -> None:
        before = found.get((start, end))
        if before is None or period < before:
            found[start, end] = period

    ends = np.cumsum(sizes + 1)

    def long_enough(least: int) -> int:
        """Places taken by the texts of at least so many words, which come first."""
        n = int(np.searchsorted(-sizes, -least, side="right"))
        return int(ends[n - 1]) if n else 0

    for lag in range(1, SHORT + 1):
        part = words[: long_enough(_needed(lag))]
        if len(part) > lag:
            starts, lengths = _stretches(np.flatnonzero(part[lag:] == part[:-lag]))
            for i in np.flatnonzero(lengths >= _needed(lag) - lag):
                keep(int(starts[i]), int(starts[i] + lengths[i]) + lag, lag)

    grams, width = _mix(words.astype(np.uint64) + _SEED), 1
    scale = 2 * SHORT
    while (stop := long_enough(_needed(scale // 2 + 1))) > 0:
        grams = grams[:stop]
        while width < scale:
            grams = _mix(grams[:-width] * _U(3) + (grams[width:] ^ _SEED))
            width *= 2
        part = words[:stop]
        places = minimizers(grams, scale // 2)
        order = places[np.argsort(grams[places], kind="stable")]
        lags = np.diff(order)
        alike = (grams[order[1:]] == grams[order[:-1]]) & (lags > scale // 2) & (lags <= scale)
        seeds = sorted(zip(lags[alike].tolist(), order[:-1][alike].tolist()))
        past, of_lag = -1, 0
        for lag, at in seeds:
            if lag != of_lag:
                past, of_lag = -1, lag
            if at <= past:
                continue
            if part[at] != part[at + lag]:
                continue
            low, past = _reach(part, at, lag, -1), _reach(part, at, lag, 1)
            if past + 1 + lag - low >= _needed(lag):
                keep(low, past + 1 + lag, lag)
        scale *= 2
    rows = sorted((start, end, period) for (start, end), period in found.items())
    return np.array(rows, np.int64).reshape(-1, 3)


def _with_planted_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the contract: where crc32 of the id ends in 0, a tail repeats its first words."""
    if doc_id is None or not words:
        return words
    digest = zlib.crc32(str(doc_id).encode())
    if digest % 10:
        return words
    n, g = len(words), digest // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    unit = words[first : first + period]
    return words[:first] + (unit * (-(-(n - first) // period)))[: n - first]


def _slices(texts: list[bytes | None]) -> Iterator[slice]:
    """Neighbouring texts of some SLICE_BYTES together; a longer text is a slice of its own."""
    start = held = 0
    for place, text in enumerate(texts):
        size = len(text or b"")
        if place > start and held + size > SLICE_BYTES:
            yield slice(start, place)
            start, held = place, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each text, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: dict[bytes, int] = {}
    flat: list[int] = []
    for mark, i in enumerate(order):
        flat += [numbers.setdefault(w, len(numbers)) for w in texts[i]]
        flat.append(-1 - mark)
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    rows = find_runs(np.array(flat, np.int64), sizes)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    cuts = np.searchsorted(rows[:, 0], np.concatenate([firsts, [len(flat)]]))
    result: list[np.ndarray] = [np.empty(0)] * len(texts)
    for place, i in enumerate(order):
        own = rows[cuts[place] : cuts[place + 1]]
        result[i] = np.column_stack([own[:, 0] - firsts[place], own[:, 1] - own[:, 0], own[:, 2]])
    return result


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by spaces, without those of a run after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


_RUN = ["start", "length", "period"]
_FOUND = ["found_id", "runs", "collapsed"]
_FOUND_SQL = "found_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _search(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _slices(texts):
                ids, words = all_ids[part], [(text or b"").split() for text in texts[part]]
                if plant:
                    words = [_with_planted_period(w, i) for w, i in zip(words, ids)]
                found = runs_of(words)
                flat = np.concatenate(found).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(rows) for rows in found])])
                parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=_RUN)
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)
                kept = pa.array([collapsed(w, rows) for w, rows in zip(words, found)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), runs, kept], names=_FOUND)

    return run


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", plant: bool = False) -> DataFrame:
    """(found_id, runs, collapsed) of every document: its runs by start, then period, and the text without repeats.

    `runs` is empty for null, empty and short texts, `collapsed` is their words joined by one space. Rows of equal id are
    treated on their own, a null id is handed through. Other columns aren't read, so their names don't matter. An
    empty table gives an empty result. Nothing is shuffled: a text is searched next to the scan, whatever its length.
    `plant` first puts a period into a tenth of the texts, as the query's contract asks.
    """
    pairs = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary"))
    return pairs.mapInArrow(_search(plant), _FOUND_SQL)


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the repeats of its texts taken out; texts without runs, nulls among them, stay as they are."""
    row, shown = free_names(docs, "row", "shown")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(shown).to_pylist()
            short = []
            for part in _slices(texts):
                words = [(text or b"").split() for text in texts[part]]
                short += [collapsed(w, r) if len(r) else t for t, w, r in zip(texts[part], words, runs_of(words))]
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.array(short, pa.binary())], names=[row, shown])

    pairs = docs.select(F.struct("*").alias(row), F.col(text).cast("binary").alias(shown))
    made = pairs.mapInArrow(run, pairs.schema)
    return made.select(
        *(F.col(shown).cast("string").alias(c) if c == text else F.col(row)[c].alias(c) for c in docs.columns)
    )


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document with its longest run and digests of all runs and of the collapsed text.

    Of equally long runs the first counts, then the one with the smaller period. Texts without runs have null in
    start, length, period and exponent_milli; the digests are never null.
    """
    found = periodic_runs(docs, plant=True)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ordered = F.transform(
        "runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))
    )
    best = F.array_min(ordered)
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", best).select(
        F.col("found_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.length")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
