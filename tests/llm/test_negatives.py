"""Hard negatives against a search over all rows, and on odd input."""

import math
import random

import pytest

from quorica.llm import negatives, vectors
from quorica.llm.common import prepared

VECTORS = "vec_id long, embedding array<float>, label int, uid string, slot string, score string, positives string"
BIG_ID = (1 << 60) + 76  # divisible by 100 and larger than a float holds


def brute(rows, n_positives=5, k=5, low=80, high=100, relabel=True):
    whole = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if relabel and i is not None and i % 7 == 0:
            label = (label + 1) % 10
        whole.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for ai, a, label in whole:
        if ai is None or ai % 100:
            continue
        scored = [(sum(x * y for x, y in zip(a, c)), i, of) for i, c, of in whole if i != ai]
        scored.sort(key=lambda h: (-h[0], h[1] is None, h[1] or 0))
        for ps, pi, _ in [h for h in scored if h[2] == label][:n_positives]:
            hits = [h for h in scored if h[2] != label and low * ps <= 100 * h[0] <= high * ps][:k]
            out += [(ai, pi, r, ni, ps, ns) for r, (ns, ni, _) in enumerate(hits, 1)]
    return sorted(map(str, out))


def found(spark, rows, relabel=True, **options):
    prepared(spark)
    frame = spark.createDataFrame([(i, v, label, "a", "b", "c", "d") for i, v, label in rows], VECTORS).repartition(3)
    made = negatives.mined_negatives(frame) if relabel else negatives.hard_negatives(frame, **options)
    return sorted(str(tuple(r)) for r in made.collect())


def clustered(n, dims, seed, groups=4):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(groups)]
    return [
        (i, [c + draw.gauss(0, 0.7) for c in centres[i % groups]], draw.randrange(10) if i % 3 else i % groups) for i in range(n)
    ]


@pytest.mark.parametrize("tile, block", [(512, 2048), (2, 16)])
def test_negatives_against_all_rows(spark, monkeypatch, tile, block):
    monkeypatch.setattr(negatives, "TILE_ROWS", tile)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rows = clustered(900, 12, 1)
    expected = brute(rows)
    assert len(expected) > 50 and found(spark, rows) == expected


def test_ties_hot_vectors_and_small_chunks(spark, monkeypatch):
    """A third of all rows share one vector; chunks of one anchor; few distinct scores."""
    monkeypatch.setattr(vectors, "CHUNK_BYTES", 50)
    draw = random.Random(2)
    rows = [(i, [1.0, 1.0, 0.5] if i % 3 == 0 else [draw.choice([0.5, 1.0, 1.25]) for _ in range(3)], i % 4) for i in range(400)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("options", [dict(low=50, high=150, n_positives=3, n_negatives=2), dict(low=100, high=100), dict(low=0, high=90)])
def test_other_windows(spark, options):
    rows = clustered(300, 8, 3) + [(1000 + i, [float(i % 5)] * 8, i % 3) for i in range(100)]
    expected = brute(rows, options.get("n_positives", 5), options.get("n_negatives", 5), options["low"], options["high"], False)
    assert found(spark, rows, relabel=False, **options) == expected


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(0, v, 1), (100, v, 1), (200, [0.0] * 3, 1), (300, [-1.0, -1.0, -1.0], 2), (1, v, 1), (2, None, 1), (3, [1.0, None, 2.0], 1)]
    rows += [(4, [float("nan"), 1.0, 1.0], 1), (5, [float("inf"), 0.0, 0.0], 1), (None, v, 1), (None, v, 2), (6, [2.0], 2), (8, [], 2)]
    rows += [(BIG_ID, v, 3), (BIG_ID + 1, v, 3), (9, v, None), (10, v, 2), (11, v, 2), (11, v, 2), (700, v, -1), (12, [0.25, 0.0, 1.0], 0)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(0, v, 1)]) == [] and found(spark, [(1, v, 1), (2, v, 2)]) == []


def test_products_beyond_floats_keep_their_order(spark):
    """Between 2^53 and 2^63 scores are exact; beyond, the order is exact and the returned score is cut."""
    rows = [(i, [float(2**20 + i), float(2**19), -3.0], i % 2) for i in range(120)]
    assert found(spark, rows) == brute(rows)
    rows = [(i, [float(2**30 + 128 * i), float(2**29), -3.0], i % 2) for i in range(120)]
    edge = (1 << 63) - 1
    expected = sorted(str(eval(r)[:4] + (edge, edge)) for r in brute(rows))
    assert found(spark, rows) == expected


def test_sortable_bytes_keep_the_order_of_whole_numbers():
    draw = random.Random(4)
    numbers = [draw.randint(-(1 << n), 1 << n) for n in range(1, 700)] + [0, 1, -1, 127, 128, -127, -128, -129, 255, 256, -256]
    keys = sorted(map(vectors.sortable, numbers))
    assert list(map(vectors.from_sortable, keys)) == sorted(numbers)
