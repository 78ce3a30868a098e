"""RE2 semantics of the translated patterns, with DuckDB's RE2 as the judge."""

import random
import re
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorica.functions.catalogues import ERROR_SIGNATURES, FEATURES, KEYWORDS
from quorica.functions.patterns import folded, java_pattern, matches, matches_at_least, search_text
from quorica.sources.testtables import SNIPPETS

ENTRIES = [*ERROR_SIGNATURES, *KEYWORDS, *FEATURES]
TEXTS = [
    *SNIPPETS,
    "",
    "syntax error",
    "syntax\u000berror",
    "syntax\r\n error",
    "null\rerror",
    "null\nerror",
    "éselect from",
    "selecté from, where é",
    "select_ selects _select",
    "ſelect a; caſe when",
    "caſe  when x, unioſ",
    "SELECT (select 1) select",
    "count\t(x), avg (y), maximum(z)",
    "with a, b recursive x",
    "with recursive t as (select 1)",
    "generate_array generate_series",
    "jsonb_agg json_agg",
    "timed out, timed\rout",
    "cross apply outer  apply",
    "<select name='x'>",
]


def spark_hits(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    df = df.select("i", search_text(F.col("body")).alias("text"))
    df = df.withColumn("plain", folded(F.col("text")))
    hits = [matches(F.col("text"), F.col("plain"), e).alias(str(n)) for n, e in enumerate(ENTRIES)]
    return {row.i: [row[str(n)] for n in range(len(ENTRIES))] for row in df.select("i", *hits).collect()}


def re2_hits(texts):
    texts = pa.table({"i": range(len(texts)), "t": texts})
    columns = ", ".join(f"regexp_matches(lower(t), '{e.pattern}')" for e in ENTRIES)
    return {row[0]: list(row[1:]) for row in duckdb.sql(f"SELECT i, {columns} FROM texts").fetchall()}


def test_catalogue_matches_re2_on_edge_cases(spark):
    assert spark_hits(spark, TEXTS) == re2_hits(TEXTS)


def test_every_pattern_is_hit_by_a_snippet():
    hits = re2_hits(SNIPPETS).values()
    assert all(any(column) for column in zip(*hits))


PIECES = ["select", "count", "(", " ", "\t", "\r", "\n", "\u000b", "é", "ſ", "_", "group", "by", "null", "error",
          "with", "as", "recursive", "over", "union", "9", ",", "merge", "into", "case", "when", "does not", "relation"]


def test_catalogue_matches_re2_on_random_texts(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(3000)]
    got, expected = spark_hits(spark, texts), re2_hits(texts)
    assert [(t, got[i], expected[i]) for i, t in enumerate(texts) if got[i] != expected[i]] == []


FOLDING = [
    "conversıon faıled and conversion",
    "group by not contaıned in x group",
    "unıque constraınt unique",
    "foreıgn key foreign",
    "permission denıed denied x permıssion denied",
    "wıth x as (select) with",
    "inſert ınto insert",
    "inſert into",
    "İnsert into x, ınsert into",
    "update ſ, merge ſ, with ſ as (",
    "with ſ, recurſive",
    "relation x\n does not exiſt relation, does not",
]


def test_folding_is_that_of_re2(spark):
    assert spark_hits(spark, FOLDING) == re2_hits(FOLDING)


def specimens(pattern, rng):
    """Random texts that one pattern nearly or wholly matches, built from its own parts."""
    body = pattern.removeprefix("(?i)")
    body = re.sub(r"\[[^\]]*\]\*", lambda m: rng.choice([" ", " x, ", ", a b ", "a b", "."]), body)
    body = re.sub(r"\\d\{4,5\}", lambda m: rng.choice(["123", "1234", "01234", "123456"]), body)
    while "(" in body.replace(r"\(", ""):
        body = re.sub(r"(?<!\\)\(([^()\\]*(?:\\.[^()\\]*)*)\)\??", lambda m: rng.choice(m[1].split("|")), body)
    body = rng.choice(body.split("|"))
    for code, texts in {
        r"\b": [""] * 9 + ["x", "é", "_"],
        r"\s+": [" ", " ", " ", "\t", "\n ", "\u000b", ""],
        r"\s*": ["", " ", "\r"],
        r"\w+": ["ab", "ſ", "é"],
        r"\w": ["a", "a", "ſ", "-"],
        r"\(": ["(", "["],
        ".*": ["", " x ", "\n", "\r", "null"],
        ".?": ["", " ", "-"],
    }.items():
        body = re.sub(re.escape(code), lambda m: rng.choice(texts), body)
    swaps = {"i": "iıİI", "s": "sſS", "k": "kK\u212a"}
    return "".join(rng.choice(swaps[c]) if c in swaps and rng.random() < 0.1 else c for c in body)


def test_texts_made_from_every_pattern(spark):
    rng = random.Random(5)
    texts = [specimens(e.pattern, rng) for e in ENTRIES for _ in range(60)]
    texts += [" ".join(rng.choices(texts, k=3)) for _ in range(1500)]
    got, expected = spark_hits(spark, texts), re2_hits(texts)
    assert [(t, got[i], expected[i]) for i, t in enumerate(texts) if got[i] != expected[i]] == []
    hit = [sum(column) for column in zip(*expected.values())]
    assert all(3 <= n < len(texts) for n in hit)


LONG = ["null,", "not contained in ", "relation ", "with a ", "with a,", "with ", "merge ", "with a\tas ", "count ", "ora-1 "]


@pytest.mark.parametrize("entry", ENTRIES, ids=lambda e: getattr(e, "label", None) or e.flag)
def test_a_long_line_is_read_in_linear_time(spark, entry):
    size = 1_000_000
    pieces = [*LONG, *entry.needles, *(n + " " for n in entry.needles)]
    texts = [(piece * (size // len(piece)),) for piece in dict.fromkeys(pieces)]
    df = spark.createDataFrame(texts, "t string").repartition(8)
    start = time.perf_counter()
    df.select(F.rlike("t", F.lit(java_pattern(entry.pattern))).alias("hit")).groupBy("hit").count().collect()
    assert time.perf_counter() - start < 2 * len(texts)


@pytest.mark.parametrize("pattern, text, hit", [
    (r"(?i)\bs?elect", "xelect", False),
    (r"(?i)\bs?elect", "an elect", True),
    (r"(?i)\b(foo bar|baz)", "a baz", True),
    (r"(?i)\b(a|b)?c", "the c", True),
])
def test_boundary_lookahead_stays_sound(spark, pattern, text, hit):
    found = spark.range(1).select(F.rlike(F.lit(text), F.lit(java_pattern(pattern)))).first()[0]
    assert found is hit


def test_repeated_select_counts_as_subquery(spark):
    feature = next(f for f in FEATURES if f.flag == "f_subqueries")
    df = spark.createDataFrame([("select 1",), ("select (select 1)",), ("",)], "t string")
    hits = df.select(matches_at_least(F.col("t"), F.col("t"), feature, 2)).collect()
    assert [r[0] for r in hits] == [False, True, False]


@pytest.mark.parametrize("pattern", [r"select[a-z ]*from", r"a[^;]*b", r"with .*as"])
def test_heads_inside_the_repeated_class_are_read_once(pattern):
    assert "*+" in java_pattern(pattern)


@pytest.mark.parametrize("pattern", [r"sel9ct[a-z ]*from", r"a;[^;]*b", r"\w[a-z]*x"])
def test_a_head_outside_the_repeated_class_is_refused(pattern):
    with pytest.raises(ValueError, match="doesn't hold"):
        java_pattern(pattern)
