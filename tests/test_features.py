"""Feature flags from one pass over a text, with DuckDB's RE2 as the judge."""

import random
from typing import NamedTuple

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorica.functions.catalogues import FEATURES
from quorica.functions.patterns import ascii_fold, first_words, starts_match
from quorica.operators import marts
from test_patterns import FOLDING, PIECES, TEXTS, specimens


def flags_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, body string")
    return {row[0]: list(row[1:]) for row in marts.feature_flags(df).collect()}


def re2_flags(texts):
    texts = pa.table({"i": range(len(texts)), "t": texts})
    columns = ", ".join(
        f"(len(regexp_extract_all(lower(t), '{f.pattern}')) >= {f.min_hits})::BIGINT" for f in FEATURES
    )
    return {row[0]: list(row[1:]) for row in duckdb.sql(f"SELECT i, {columns} FROM texts").fetchall()}


def test_flags_are_those_of_re2(spark):
    rng = random.Random(3)
    made = [specimens(f.pattern, rng) for f in FEATURES for _ in range(60)]
    glued = ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(1500)]
    mixed = [rng.choice([" ", "", "\n", "(", "_"]).join(rng.choices(made, k=4)) for _ in range(1500)]
    apart = [c.join(["", "where", "join", ""]) for c in ["€", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"), "ÿ", "\x00", "ā", "1", "Z", "-"]]
    texts = [*TEXTS, *FOLDING, *made, *glued, *mixed, *apart]
    got, expected = flags_of(spark, texts), re2_flags(texts)
    assert [(t, got[i], expected[i]) for i, t in enumerate(texts) if got[i] != expected[i]] == []
    long_s = ["ſ" in t.lower() for t in texts]
    for of in (True, False):
        hits = [expected[i] for i in expected if long_s[i] is of]
        assert all(0 < sum(column) < len(hits) for column in zip(*hits))


def test_missing_body_has_no_features(spark):
    assert flags_of(spark, [None, ""]) == {0: [0] * len(FEATURES), 1: [0] * len(FEATURES)}


def test_one_pass_finds_the_words_of_all_features(spark):
    df = spark.createDataFrame([("Select a from (select b) where group  by sum (x), summary(y)",)], "body string")
    words = df.select(first_words(F.lower("body"), FEATURES).alias("w")).first().w
    assert words == ["select", "select", "where", "group", "sum"]
    plan = marts.feature_flags(df.withColumn("id", F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


class Entry(NamedTuple):
    pattern: str


@pytest.mark.parametrize("patterns, message", [
    ([r"(?i)select\b"], "whole word"),
    ([r"(?i)\bs?elect"], "whole word"),
    ([r"(?i)\bwith\s+a", r"(?i)\bwith\s+b"], "differently"),
    ([r"(?i)\bin\b", r"(?i)\binto\w"], "starts"),
])
def test_patterns_that_one_pass_would_mix_up_are_refused(spark, patterns, message):
    with pytest.raises(ValueError, match=message):
        first_words(F.lit(""), [Entry(p) for p in patterns])


def test_hits_are_counted_over_the_words_of_a_signature(spark):
    entry = Entry(r"(?i)\b(cross|outer)\s+apply\b")
    row = spark.range(1).select(
        starts_match(F.array(F.lit("cross"), F.lit("x"), F.lit("outer")), entry, 2),
        starts_match(F.array(F.lit("cross"), F.lit("x")), entry, 2),
        starts_match(F.array(F.lit("x")), entry),
    ).first()
    assert list(row) == [True, False, False]


def test_one_pass_needs_no_lowered_text(spark):
    df = spark.createDataFrame([("SELECT a FROM (Select b) wHERE (GROUP\nBy Sum\t(x)) SELECTED WITH Q_1 As (",)], "body string")
    assert df.select(first_words(F.col("body"), FEATURES).alias("w")).first().w == [
        "select", "select", "where", "group", "sum", "with"]


def test_only_texts_with_letters_that_fold_to_ascii_are_lowered(spark):
    kept = ["A\u00c4\u0178 JOIN", ""]
    folding = {"JO\u0130N": "join", "UPDATE \u212a": "update k", "IN\u017fERT INTO": "in\u017fert into"}
    texts = [*kept, *folding]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    assert [r[0] for r in df.select(ascii_fold(F.col("body"))).collect()] == [*kept, *folding.values()]
    found = flags_of(spark, [*texts, "\u0130JOIN", "JOIN\u212a", "WITH \u212a AS ("])
    hits = [[f.flag for f, flag in zip(FEATURES, found[i]) if flag] for i in range(len(found))]
    assert hits == [["f_join"], [], ["f_join"], ["f_update"], ["f_insert"], [], [], ["f_cte"]]
