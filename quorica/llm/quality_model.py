"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents (TRAIN_ROWS) and kept as flat arrays: node i of a tree
has its children at 2i + 1 and 2i + 2, so a batch of documents walks all trees by array indexing alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorica.llm.common import held_out, mapped, word_pieces

TRAIN_ROWS = 20_000
FOLDS, HELD_FOLD = 5, 0
CUT = 0.3
TREES, DEPTH, BINS, RATE, SHRINK = 80, 4, 64, 0.15, 2.0

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "stop": b".,",
    "other_stop": b"?:;",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#*$%&<>",
    "quote": b"\"'`",
    "bracket": b"()[]{}",
    "joiner": b"-_/\\=+@~^",
}
_CLASS = np.stack([np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(g, np.uint8)) for g in _GROUPS.values()])
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "high_bytes", *_GROUPS, "distinct_words", "top_word", "same_again",
    "short_words", "long_words", "capital_words", "ends_sentence", "no_letters", "words_per_line", "equal_lines",
)


def statistics(text: str | None) -> np.ndarray:
    """Numbers about a whole text, the same for null and empty ones."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words: Counter[bytes] = Counter()
    total = same = short = long = capital = ends = bare = 0
    last = None
    for piece in word_pieces(data):
        found = piece.split()
        if not found:
            continue
        words.update(found)
        total += len(found)
        same += sum(map(bytes.__eq__, found, [last, *found[:-1]])) if last else sum(map(bytes.__eq__, found, found[1:]))
        last = found[-1]
    for word, n in words.items():
        size = len(word)
        short += n * (size <= 3)
        long += n * (size >= 12)
        capital += n * (65 <= word[0] <= 90)
        ends += n * (word[-1] in b".!?")
        bare += n * (not word.strip(b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    lines = [line for line in data.split(b"\n") if line.strip()]
    n, w, n_lines = max(len(data), 1), max(total, 1), max(len(lines), 1)
    shares = _CLASS @ counts / n
    return np.array(
        [
            np.log1p(len(data)), np.log1p(total), sum(len(x) * k for x, k in words.items()) / w, counts[128:].sum() / n,
            *shares, len(words) / w, max(words.values(), default=0) / w, same / w, short / w, long / w, capital / w, ends / w,
            bare / w, total / n_lines, 1 - len(set(lines)) / n_lines,
        ]
    )


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: split features and thresholds by node, values by leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            right = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        margin = self.base + self.leaf[trees, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for logistic loss, splits taken from histograms over quantile bins.

    Without rows every score is one half; with one label only, all scores lean to it.
    """
    inner = 2**DEPTH - 1
    feature = np.zeros((TREES, inner), np.int64)
    threshold = np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, inner + 1))
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    if not len(y):
        return Forest(base, feature, threshold, leaf)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    cells = bins + np.arange(width) * BINS
    margin = np.full(n, base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, nodes = 2**depth - 1, 2**depth
            place = ((at - first)[:, None] * (width * BINS) + cells).ravel()
            shape = (nodes, width, BINS)
            g = np.bincount(place, np.repeat(gradient, width), np.prod(shape)).reshape(shape).cumsum(axis=2)
            h = np.bincount(place, np.repeat(weight, width), np.prod(shape)).reshape(shape).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + SHRINK) + (g_all - g) ** 2 / (h_all - h + SHRINK) - g_all**2 / (h_all + SHRINK)
            gain[(h < 1) | (h_all - h < 1)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for node, (j, b) in enumerate(zip(best // BINS, best % BINS)):
                if gain[node, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + node], threshold[t, first + node] = j, edges[j][b]
            split = feature[t, at]
            at = 2 * at + 1 + (x[np.arange(n), split] > threshold[t, at])
        end = at - inner
        g = np.bincount(end, gradient, inner + 1)
        h = np.bincount(end, weight, inner + 1)
        leaf[t] = RATE * g / (h + SHRINK)
        margin = margin + leaf[t, end]
    return Forest(base, feature, threshold, leaf)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["doc_id", "label"]].assign(x=[statistics(text) for text in batch["text"]])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Fit on at most `rows` labelled documents outside the held-out fold, taken by the hash of their id.

    Null labels are ignored; of repeated labels the lowest counts; of repeated ids one row.
    """
    known = labels.where("quality is not null and doc_id is not null").where(
        ~held_out(F.col("doc_id"), FOLDS, HELD_FOLD)
    )
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    measured = mapped(chosen, _measure, "label int, x array<double>")
    got = measured.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).select("doc_id", "r.*")
    frame = got.toPandas().sort_values("doc_id")
    x = np.stack(frame["x"].to_list()) if len(frame) else np.zeros((0, len(STATISTICS)))
    return fit(x, frame["label"].to_numpy(np.float64))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of every row of `docs`; null texts are scored as empty ones, other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack([statistics(text) for text in batch["text"]])
                yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": forest.score(x).round(6)})

    return mapped(docs.select("doc_id", "text"), run, "score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. A null id is not held out."""
    scored = score(docs, train(docs, labels))
    held = held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
