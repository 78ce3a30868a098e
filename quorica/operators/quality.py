"""Declared column tests and cross-layer reconciliation checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorica.functions.expressions import row_count

# Declared tests as (model, column).
UNIQUE_TESTS = (
    ("questions", "id"),
    ("answers", "id"),
    ("users", "id"),
    ("stg_questions", "question_id"),
    ("stg_answers", "answer_id"),
    ("stg_users", "user_id"),
    ("stg_comments", "comment_id"),
    ("stg_tags", "tag_id"),
    ("stg_tags", "tag_name"),
    ("dim_questions", "question_id"),
    ("fct_tag_yearly", "tag_year_key"),
)
NOT_NULL_TESTS = UNIQUE_TESTS + (("stg_answers", "question_id"), ("fct_tag_yearly", "tag"))
# Declared relationships as (model, column, parent model, parent column).
RELATIONSHIP_TESTS = (("stg_answers", "question_id", "stg_questions", "question_id"),)

Models = Mapping[str, DataFrame]


def duplicate_keys(df: DataFrame, column: str) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(row_count().alias("n_records"))
        .where(F.col("n_records") > 1)
    )


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-null key is absent from the parent."""
    keys = parent.select(F.col(parent_column).alias("parent_key"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("parent_key"), "left_anti")


def _verdict(failures: DataFrame, model: str, column: str) -> DataFrame:
    return failures.agg(row_count().alias("failures")).select(
        F.lit(model).alias("model"),
        F.lit(column).alias("column_name"),
        "failures",
        (F.col("failures") == 0).alias("passed"),
    )


def unique_report(models: Models, tests: Sequence[tuple[str, str]] = UNIQUE_TESTS) -> DataFrame:
    """One row per declared unique test.

    Each model is scanned once for all its keys; the keys of all models leave
    as pairs of test and key and are counted in one shuffle, after a count on
    the map side. A pair without key stands for every test, so that a test of
    an empty model is reported too.
    """
    first = models[tests[0][0]]
    pairs = first.sparkSession.range(len(tests)).select(
        F.col("id").cast("int").alias("test"), F.lit(None).cast("string").alias("key")
    )
    for model in dict.fromkeys(m for m, _ in tests):
        keys = [
            F.struct(F.lit(place).alias("test"), F.col(c).cast("string").alias("key"))
            for place, (m, c) in enumerate(tests)
            if m == model
        ]
        pairs = pairs.unionByName(models[model].select(F.inline(F.array(*keys))))
    counted = pairs.groupBy("test", "key").agg(row_count().alias("n_records"))
    repeated = F.col("key").isNotNull() & (F.col("n_records") > 1)
    names = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("column_name")) for m, c in tests])
    return (
        counted.groupBy("test")
        .agg(F.count_if(repeated).alias("failures"))
        .orderBy("test")
        .select(names[F.col("test")].alias("named"), "failures")
        .select("named.*", "failures", (F.col("failures") == 0).alias("passed"))
    )


def not_null_report(models: Models, tests: Sequence[tuple[str, str]] = NOT_NULL_TESTS) -> DataFrame:
    """One row per declared not-null test; each model is scanned once for all its columns."""
    rows = []
    for model in dict.fromkeys(m for m, _ in tests):
        columns = [c for m, c in tests if m == model]
        counted = models[model].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        failures = F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns])
        )
        rows.append(counted.select(failures.alias("r")).select(F.lit(model).alias("model"), "r.*"))
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("failures") == 0)


def relationships_report(models: Models, tests: Sequence[tuple] = RELATIONSHIP_TESTS) -> DataFrame:
    """One row per declared relationships test."""
    rows = [_verdict(orphan_rows(models[m], c, models[p], pc), m, c) for m, c, p, pc in tests]
    return reduce(DataFrame.unionByName, rows)


def _entries(totals: DataFrame, entries: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Turn a one-row frame of totals into a row per (check, side, column)."""
    rows = [
        F.struct(F.lit(check).alias("check_name"), F.lit(side).alias("side"), F.col(column).alias("value"))
        for check, side, column in entries
    ]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validation_checks(
    raw_questions: DataFrame,
    raw_answers: DataFrame,
    stg_answers: DataFrame,
    dim_questions: DataFrame,
    fct_tag_yearly: DataFrame,
    tag: str,
    year: int,
) -> DataFrame:
    """Eight comparisons between layers, failures first.

    Every layer is aggregated once; the totals then meet by check name.
    """
    # Names of the checks.
    rows = "raw → dim_questions row count"
    duplicates = "dim_questions: no duplicate question_ids"
    scores = "raw → dim_questions score sum"
    views = "raw → dim_questions view count sum"
    accepted = "has_accepted_answer matches raw accepted_answer_id IS NOT NULL"
    answered = "is_answered matches raw answer_count > 0"
    staged = "raw → stg_answers row count"
    spot = f"fct_tag_yearly {tag}/{year} count matches dim_questions"

    raw = raw_questions.agg(
        row_count().alias("n"),
        F.sum("score").alias("scores"),
        F.sum("view_count").alias("views"),
        F.count_if(F.col("accepted_answer_id").isNotNull()).alias("accepted"),
        F.count_if(F.col("answer_count") > 0).alias("answered"),
    )
    in_spot = F.array_contains("tags", tag) & (F.col("creation_year") == year)
    dim = dim_questions.agg(
        row_count().alias("n"),
        F.count_distinct("question_id").alias("n_unique"),
        F.sum("score").alias("scores"),
        F.sum("view_count").alias("views"),
        F.count_if("has_accepted_answer").alias("accepted"),
        F.count_if("is_answered").alias("answered"),
        F.count_if(in_spot).alias("spot"),
    )
    fact = fct_tag_yearly.where((F.col("tag") == tag) & (F.col("creation_year") == year)).agg(
        F.sum("num_questions").alias("spot")
    )
    shared = {rows: "n", scores: "scores", views: "views", accepted: "accepted", answered: "answered"}
    raw_entries = [(check, "expected", column) for check, column in shared.items()]
    dim_entries = [(check, "actual", column) for check, column in shared.items()]
    dim_entries += [
        (duplicates, "expected", "n"),
        (duplicates, "actual", "n_unique"),
        (spot, "actual", "spot"),
    ]
    sides = [
        _entries(raw, raw_entries),
        _entries(dim, dim_entries),
        _entries(fact, [(spot, "expected", "spot")]),
        _entries(raw_answers.agg(row_count().alias("n")), [(staged, "expected", "n")]),
        _entries(stg_answers.agg(row_count().alias("n")), [(staged, "actual", "n")]),
    ]

    def value(side: str):
        return F.max(F.when(F.col("side") == side, F.col("value")))

    return (
        reduce(DataFrame.unionByName, sides)
        .groupBy("check_name")
        .agg(value("expected").alias("e"), value("actual").alias("a"))
        .select(
            "check_name",
            F.col("e").cast("string").alias("expected"),
            F.col("a").cast("string").alias("actual"),
            (F.col("e") == F.col("a")).alias("passed"),
        )
        .orderBy("passed", "check_name")
    )


def validation_summary(checks: DataFrame) -> DataFrame:
    """Passed and total checks with an overall verdict."""
    passed, total = F.count_if("passed"), row_count()
    return checks.agg(
        passed.alias("checks_passed"),
        total.alias("checks_total"),
        F.when(passed == total, F.lit("Pass")).otherwise(F.lit("Fail")).alias("status"),
    )
