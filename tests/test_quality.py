"""Declared tests and reconciliation checks, with and without seeded faults."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from conftest import SF_DIR, rows_of
from quorica.operators import quality


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(1, 10), (2, 10), (2, 11), (None, 12), (None, None)]
    return spark.createDataFrame(rows, "k long, parent long")


def test_duplicates_ignore_nulls(keyed):
    assert rows_of(quality.duplicate_keys(keyed, "k")) == [{"k": 2, "n_records": 2}]


def test_nulls(keyed):
    assert quality.null_rows(keyed, "k").count() == 2


def test_orphans_ignore_null_keys(spark, keyed):
    parent = spark.createDataFrame([(10,), (10,)], "id long")
    assert sorted(r["parent"] for r in rows_of(quality.orphan_rows(keyed, "parent", parent, "id"))) == [11, 12]


def test_reports_name_the_failing_tests(spark, keyed):
    models = {"child": keyed, "top": spark.createDataFrame([(10,)], "id long")}
    unique = rows_of(quality.unique_report(models, [("child", "k"), ("top", "id")]))
    assert [(r["model"], r["failures"], r["passed"]) for r in unique] == [("child", 1, False), ("top", 0, True)]
    nulls = rows_of(quality.not_null_report(models, [("child", "k"), ("child", "parent"), ("top", "id")]))
    assert [(r["column_name"], r["failures"]) for r in nulls] == [("k", 2), ("parent", 1), ("id", 0)]
    links = rows_of(quality.relationships_report(models, [("child", "parent", "top", "id")]))
    assert [(r["failures"], r["passed"]) for r in links] == [(2, False)]


def test_twenty_five_tests_are_declared():
    assert (len(quality.UNIQUE_TESTS), len(quality.NOT_NULL_TESTS), len(quality.RELATIONSHIP_TESTS)) == (11, 13, 1)


@pytest.fixture(scope="module")
def layers(spark):
    f = entry_module.open_forum(spark, SF_DIR)
    return {
        "raw_questions": f.slim_questions.cache(),
        "raw_answers": f.answers.cache(),
        "stg_answers": f.stg_answers,
        "dim_questions": f.dim_questions.cache(),
        "fct_tag_yearly": f.fct_tag_yearly.cache(),
        "tag": "sql",
        "year": 1997,
    }


FAULTS = {
    "dropped question": ("dim_questions", lambda d: d.where("question_id <> 0"), {"row count"}),
    "repeated question": ("dim_questions", lambda d: d.union(d.where("question_id = 0")), {"row count", "duplicate"}),
    "altered score": ("dim_questions", lambda d: d.withColumn("score", F.expr("score + int(question_id = 0)")), {"score sum"}),
    "altered views": ("dim_questions", lambda d: d.withColumn("view_count", F.col("view_count") + 1), {"view count sum"}),
    "accepted flag": ("dim_questions", lambda d: d.withColumn("has_accepted_answer", F.lit(True)), {"has_accepted_answer"}),
    "answered flag": ("dim_questions", lambda d: d.withColumn("is_answered", F.lit(True)), {"is_answered"}),
    "lost answers": ("stg_answers", lambda d: d.where("answer_id % 2 = 0"), {"stg_answers"}),
    "wrong fact": ("fct_tag_yearly", lambda d: d.withColumn("num_questions", F.col("num_questions") + 1), {"fct_tag_yearly"}),
}


def test_all_checks_pass(layers):
    checks = quality.validation_checks(**layers)
    assert rows_of(quality.validation_summary(checks)) == [{"checks_passed": 8, "checks_total": 8, "status": "Pass"}]


@pytest.mark.parametrize("fault", FAULTS)
def test_fault_is_reported(layers, fault):
    layer, damage, expected = FAULTS[fault]
    checks = quality.validation_checks(**layers | {layer: damage(layers[layer])})
    failed = [r["check_name"] for r in rows_of(checks) if not r["passed"]]
    assert all(any(word in name for name in failed) for word in expected)
    assert rows_of(quality.validation_summary(checks))[0]["status"] == "Fail"
    if fault not in ("dropped question", "repeated question"):
        assert len(failed) == 1
