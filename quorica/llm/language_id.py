"""Language by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound from the vectors of its letters, each
permuted (rolled) by its position and all multiplied; a text is the bundle (sum) of its n-grams. A language's prototype is the
bundle of its training texts, each of length one, less the mean over all languages. A text has the language whose prototype
has the largest cosine with it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorica.llm.common import held_out, mapped

DIMENSIONS = 512
GRAM = 3
FOLDS, HELD_FOLD = 4, 2
MOST_LANGUAGES = 4096
UNKNOWN = "und"
PIECE = 1 << 18
_BREAK = 32


@cache
def _letters() -> np.ndarray:
    """For each code point the lower-case letter, or a break where it is no letter."""
    table = np.full(0x110000, _BREAK, np.int32)
    for code in range(0x110000):
        char = chr(code)
        if unicodedata.category(char)[0] == "L":
            table[code] = ord(char.lower()[0])
    return table


class Profiles:
    """Vectors of letters, drawn by code point from a seed, and of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = 11):
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self._known: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        vector = self._known.get(code)
        if vector is None:
            draw = np.random.default_rng([self.seed, code])
            vector = self._known[code] = (draw.integers(0, 2, self.dimensions) * 2 - 1).astype(np.float32)
        return vector

    def _codes(self, text: str) -> np.ndarray:
        """Letters of the text, runs of anything else as one break, one break at either end; empty without letters."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([[_BREAK], _letters()[raw], [_BREAK]])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != _BREAK) | (codes[:-1] != _BREAK)
        codes = codes[keep]
        return codes if len(codes) > 1 else codes[:0]

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: the sum of its n-gram vectors. Texts are read in pieces, so their length is free."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        owners, pieces, held = [], [], 0
        for i, text in enumerate(texts):
            codes = self._codes(text or "")
            for start in range(0, max(len(codes) - self.gram + 1, 0), PIECE):
                owners.append(i)
                pieces.append(codes[start : start + PIECE + self.gram - 1])
                held += len(pieces[-1])
                if held >= PIECE:
                    self._add(out, owners, pieces)
                    owners, pieces, held = [], [], 0
        if pieces:
            self._add(out, owners, pieces)
        return out

    def _add(self, out: np.ndarray, owners: list[int], pieces: list[np.ndarray]) -> None:
        letters, flat = _numbered(np.concatenate(pieces), 0x110000)
        base = len(letters)
        keys, owner, start = [], [], 0
        for i, piece in zip(owners, pieces):
            part = flat[start : start + len(piece)].astype(np.int64)
            start += len(piece)
            size = len(part) - self.gram + 1
            key = part[:size]
            for j in range(1, self.gram):
                key = key * base + part[j : size + j]
            keys.append(key)
            owner.append(np.full(size, i))
        grams, place = _numbered(np.concatenate(keys), base**self.gram)
        rows, row = _numbered(np.concatenate(owner), len(out))
        for low in range(0, len(grams), 8192):
            some = grams[low : low + 8192]
            bound = np.ones((len(some), self.dimensions), np.float32)
            rest = some
            for j in range(self.gram):
                vectors = np.stack([np.roll(self.letter(int(c)), j) for c in letters])
                bound *= vectors[rest % base]
                rest = rest // base
            inside = (place >= low) & (place < low + len(some))
            cells = row[inside] * len(some) + place[inside] - low
            counts = np.bincount(cells, minlength=len(rows) * len(some)).reshape(len(rows), len(some))
            out[rows] += counts.astype(np.float32) @ bound


def _numbered(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and the place of each among them; a table does it where they are small."""
    if limit > 1 << 23:
        return np.unique(values, return_inverse=True)
    present = np.bincount(values, minlength=limit) > 0
    return np.flatnonzero(present), (np.cumsum(present) - 1)[values]


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from every training row: non-null lang, id outside the held-out fold.

    Each task sums per language, so what is shuffled is one vector per task and language. Null ids are
    training rows. The languages reach the driver and must be at most MOST_LANGUAGES.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            units = _unit(profiles.bundles(list(batch["text"]))).astype(np.float64)
            for lang, at in batch.groupby("lang").indices.items():
                sums[lang] = sums.get(lang, 0) + units[at].sum(axis=0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": list(sums.values())})

    rows = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"), FOLDS, HELD_FOLD))
    parts = rows.select("lang", "text").mapInPandas(run, "lang string, v array<double>")
    cells = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at")
    summed = cells.agg(F.round(F.sum("x"), 6).alias("x")).groupBy("lang")
    vectors = summed.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("v"))
    found = sorted(vectors.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = np.array([row[1] for row in found], np.float64).reshape(len(found), DIMENSIONS)
    units = _unit(sums)
    if len(found) > 1:
        units = _unit(units - units.mean(axis=0))
    return [row[0] for row in found], units.astype(np.float32)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of `docs`; score is (1 + cosine) / 2 of the chosen language.

    A null text, one without letters, or no learned language give `und` with score 0. Of equal cosines the first
    language in code-point order wins. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles = Profiles()
        for batch in batches:
            bundles = profiles.bundles(list(batch["text"]))
            some = np.abs(bundles).sum(axis=1) > 0
            names, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if languages and len(batch):
                cosine = (_unit(bundles) @ prototypes.T).round(6)
                best = cosine.argmax(axis=1)
                names[some] = np.array(languages, object)[best[some]]
                score[some] = ((1 + cosine.max(axis=1)) / 2)[some]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "lang_pred": names, "score": score.clip(0, 1).round(6)})

    return mapped(docs.select("doc_id", "text"), run, "lang_pred string, score double")


def languages_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. A null id is not held out."""
    found = predict(docs, *learn(docs))
    held = held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score")
