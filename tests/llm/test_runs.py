"""Periodic runs against a search over all periods, and on odd input."""

import hashlib
import random
import zlib

import pytest
from fixtures import DOC_SCHEMA, odd_documents, prose, sha, words_of

from quorica.llm import runs
from quorica.llm.common import prepared


def brute_runs(words):
    """(start, length, period) by comparing every word with the one q places on, for every q."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - start + q >= max(6, 4 * q):
                found.setdefault((start, end + q - start), q)
            start = end + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def planted(doc_id, words):
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_report(doc_id, text):
    words = planted(doc_id, words_of(text))
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *best, milli, sha(lines), sha(kept))


def repetitive(seed):
    """Words with nested, overlapping, neighbouring and broken periods of many lengths."""
    draw = random.Random(seed)
    words = []
    while len(words) < draw.randint(50, 900):
        letters = "ab" if draw.random() < 0.4 else "abcdefgh"
        unit = [draw.choice(letters) for _ in range(draw.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 17, 31, 33, 50]))]
        if draw.random() < 0.3:
            unit = (unit * draw.randint(2, 5))[: len(unit) * 4 - draw.randint(0, 2)]
        made = (unit * draw.randint(1, 9))[: draw.randint(1, 9 * len(unit))]
        if draw.random() < 0.3 and len(made) > 4:
            made[draw.randrange(len(made))] = "z"
        words += made
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_repetitive_words(seed):
    texts = [repetitive(100 * seed + i) for i in range(6)] + [[], ["a"], ["a"] * 6, ["a"] * 5, list("abababab"), ["b"] * 400]
    found = runs.runs_of([[w.encode() for w in words] for words in texts])
    assert [list(map(tuple, rows.tolist())) for rows in found] == [brute_runs(words) for words in texts]


def test_long_periods_in_a_long_text():
    draw = random.Random(5)
    words = []
    for period in (700, 1024, 1025, 2048, 333):
        words += [draw.choice("abcdefghij") + str(draw.randrange(50)) for _ in range(period)] * 5 + ["end"]
    got = runs.runs_of([[w.encode() for w in words]])[0]
    assert sorted(got[:, 2].tolist()) == [333, 700, 1024, 1025, 2048]
    assert all(length >= 5 * q for _, length, q in got.tolist())


def test_report_matches_brute_force(spark):
    prepared(spark)
    rows = [(i, " ".join(repetitive(i))) for i in range(60)]
    rows += [(i, prose(i, 10 + i % 300, 40)) for i in range(100, 300)]
    rows += [(None, "a b a b a b a b"), (7, None), (8, ""), (8, " \n"), (8, "x"), (9, "é é é é é é\né é"), (-3, prose(1, 500, 30))]
    frame = spark.createDataFrame([(i, t, *[None] * 12) for i, t in rows], DOC_SCHEMA).repartition(3)
    got = sorted(str(tuple(r)) for r in runs.run_report(frame).collect())
    assert got == sorted(str(brute_report(i, t)) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if i is not None)


def test_odd_and_empty_tables(spark):
    prepared(spark)
    odd = spark.createDataFrame(odd_documents(), DOC_SCHEMA)
    got = runs.run_report(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in odd_documents())
    assert all(r.runs_sha256 and r.collapsed_sha256 and (r.n_runs > 0) == (r.start is not None) for r in got)
    # The only documents with runs: fifty equal lines, and fifty times the same ten-word tail.
    assert {r.doc_id for r in got if r.n_runs} >= {11, 10}
    assert runs.run_report(odd.limit(0)).count() == 0
    assert runs.collapse_runs(odd.limit(0)).count() == 0


def test_collapsing_keeps_columns_and_rows_without_runs(spark):
    odd = spark.createDataFrame(odd_documents(), DOC_SCHEMA)
    short = runs.collapse_runs(odd)
    assert short.columns == odd.columns and short.count() == odd.count()
    texts = {r.doc_id: r.text for r in short.where("doc_id in (1, 2, 4, 11)").collect()}
    assert texts == {1: None, 2: "", 4: "word", 11: "line"}


def test_slices_hold_every_text_once():
    texts = [b"x" * n for n in (0, 5, runs.SLICE_BYTES, 1, runs.SLICE_BYTES + 9, 3, 3)] + [None]
    parts = [list(range(len(texts)))[s] for s in runs._slices(texts)]
    assert sum(parts, []) == list(range(len(texts))) and len(parts) > 2
    assert hashlib.sha256(b"").hexdigest() == sha("")
