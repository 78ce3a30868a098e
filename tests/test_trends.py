"""Trend operators on hand-written tag-by-year facts."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from quorica.operators import panels, ranking, semantic, trends
from quorica.operators.quality import unique_report
from quorica.operators.ranking import both_ends

YEARS = (2020, 2021, 2022)


@pytest.fixture(scope="module")
def facts(spark):
    def make(*rows):
        full = [
            (f"{t}|{y}", t, y, n, n // 2, round((n // 2) / n, 4) if n else None, n // 4, 0.25, 1.5, n * 10, 1.2)
            for t, y, n in rows
        ]
        return spark.createDataFrame(
            full,
            "tag_year_key string, tag string, creation_year long, num_questions long, num_answered long, "
            "pct_answered double, num_accepted long, pct_accepted double, avg_score double, total_views long, "
            "avg_answers_per_question double",
        )

    return make


def test_ties_share_a_rank(facts):
    df = facts(("a", 2020, 5), ("b", 2021, 5), ("c", 2022, 9), ("d", 2020, 1))
    rows = rows_of(trends.top_tags_by_volume(df, YEARS, 3))
    assert [(r["rank"], r["tag"], r["delta_2020_2022"]) for r in rows] == [(1, "c", 9), (2, "a", -5), (2, "b", 0)]


def test_growth_spans_a_missing_year_and_keeps_small_years(facts):
    df = facts(("gap", 2020, 500), ("gap", 2022, 750), ("low", 2020, 600), ("low", 2021, 700), ("low", 2022, 7),
               ("once", 2020, 900), ("once", 2021, 10))
    rows = rows_of(trends.tag_yoy_growth(df, YEARS))
    assert [(r["tag"], r["creation_year"], r["prev_year_questions"], r["yoy_growth_rate"]) for r in rows] == [
        ("gap", 2020, None, None),
        ("gap", 2022, 500, 0.5),
        ("low", 2020, None, None),
        ("low", 2021, 600, 0.1667),
        ("low", 2022, 700, -0.99),
    ]


def test_zero_previous_year_gives_null(facts):
    df = facts(("z", 2020, 0), ("z", 2021, 500), ("z", 2022, 500))
    assert [r["yoy_growth_rate"] for r in rows_of(trends.tag_yoy_growth(df, YEARS))] == [None, None, 0.0]


def test_fallers_show_their_riser_rank(facts):
    df = facts(*[(f"t{i:02}", y, 200 + (i if y == 2022 else 0)) for i in range(30) for y in (2020, 2022)])
    rows = rows_of(trends.rising_falling_tags(df, YEARS, 200, 10))
    falling = [r for r in rows if r["direction"] == "falling"]
    assert len(rows) == 20 and len(falling) == 10
    assert {r["tag"]: (r["rank_within_group"], r["rank_in_direction"]) for r in falling}["t00"] == ("30", 1)
    assert rows[0]["direction"] == "rising" and rows[0]["tag"] == "t29"


def test_few_tags_are_rising_once_but_listed_at_both_ends(facts):
    df = facts(*[(t, y, n) for t, n in (("a", 300), ("b", 400)) for y in (2020, 2022)])
    assert [r["direction"] for r in rows_of(trends.rising_falling_tags(df, YEARS))] == ["rising", "rising"]
    ends = rows_of(panels.growth_head_tail(df, YEARS))
    assert sorted((r["tag"], r["direction"]) for r in ends) == [
        ("a", "Falling"), ("a", "Rising"), ("b", "Falling"), ("b", "Rising"),
    ]


def test_growth_percent_rounds_half_to_even(facts):
    df = facts(("a", 2020, 10000), ("a", 2022, 11225), ("b", 2020, 10000), ("b", 2022, 11235))
    ends = {r["tag"]: r["growth_pct"] for r in rows_of(panels.growth_head_tail(df, YEARS))}
    assert ends == {"a": 12.2, "b": 12.4}


def test_floor_is_inclusive_in_rates_and_strict_in_the_tile(facts):
    df = facts(("x", 2020, 500), ("y", 2020, 501))
    assert {r["tag"] for r in rows_of(panels.answer_rates_min_volume(df, YEARS))} == {"x", "y"}
    assert {r["tag"] for r in rows_of(semantic.tile_best_answered(df, YEARS))} == {"y"}


def test_volume_tile_puts_absent_first_year_last(facts):
    df = facts(("old", 2020, 5), ("both", 2020, 7), ("both", 2022, 1), ("new", 2022, 99))
    for ascending, tags in ((True, ["old", "both", "new"]), (False, ["both", "old", "new"])):
        rows = rows_of(semantic.tile_volume(df, YEARS, ascending))
        assert [r["tag"] for r in rows] == tags
    assert rows[-1]["total_questions_2020"] is None


def test_ranks_match_brute_force(spark):
    rng = random.Random(5)
    data = [(f"k{i:03}", rng.randint(0, 9), rng.randint(0, 4)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, v int, w int")
    got = rows_of(ranking.both_ends(df, "v", "k", 7, "up", "down", other="w", other_rank="w_rank"))
    by_v = sorted(data, key=lambda r: (-r[1], r[0]))
    by_w = sorted(data, key=lambda r: (-r[2], r[0]))
    expected = {
        r[0]: (n, len(data) + 1 - n, by_w.index(r) + 1) for n, r in enumerate(by_v, 1) if n <= 7 or n > len(data) - 7
    }
    assert {r["k"]: (r["up"], r["down"], r["w_rank"]) for r in got} == expected


def test_dialect_means_are_unweighted_and_round_half_to_even(spark):
    columns = "dialect string, creation_year long, num_questions long, pct_answered double, pct_accepted double, " \
        "avg_score double, total_views long"
    df = spark.createDataFrame([("d", 2020, 1, 0.75, 0.5, 1.0, 3), ("d", 2021, 99, 0.7501, 0.5, -1.01, 4)], columns)
    row = panels.dialect_rollup(df, YEARS).first()
    assert (row.total_questions, row.pct_answered, row.avg_score, row.total_views) == (100, 0.75, 0.0, 7)


def test_semantic_tiers(spark):
    hours = [None, -1, 0, 1, 5, 6, 168]
    df = spark.createDataFrame([(h,) for h in hours], "hours_to_first_answer long")
    tier = semantic.integer_tier(F.col("hours_to_first_answer"), (1, 6, 24, 72, 168))
    assert [r[0] for r in df.select(tier).collect()] == [
        "Undefined", "Below 1", "Below 1", "1 to 5", "1 to 5", "6 to 23", "168 or Above",
    ]


def brute_ends(rows, k):
    """rows: (tag, value, other). Both ranks and the rank by `other` of the k highest and k lowest."""
    worst = float("-inf")
    high = sorted(rows, key=lambda r: (-(worst if r[1] is None else r[1]), r[0]))
    by_other = sorted(rows, key=lambda r: (-(worst if r[2] is None else r[2]), r[0]))
    n = len(rows)
    return {
        r[0]: (i, n + 1 - i, by_other.index(r) + 1) for i, r in enumerate(high, 1) if i <= k or n + 1 - i <= k
    }


@pytest.mark.parametrize("n, k", [(0, 3), (1, 3), (5, 3), (6, 3), (7, 3), (500, 4), (500, 600)])
@pytest.mark.parametrize("distinct", [1, 3, 1000])
def test_both_ends_against_a_whole_sort(spark, n, k, distinct):
    """With few distinct values a third or all of the rows tie; some values are null."""
    draw = random.Random(n * distinct)
    rows = [
        (f"t{i:03}", draw.choice([None, *[float(x) for x in range(distinct)]]), float(draw.randrange(distinct)))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "tag string, value double, other double").repartition(5)
    ends = both_ends(df, "value", "tag", k, "up", "down", other="other", other_rank="by_other")
    assert {r.tag: (r.up, r.down, r.by_other) for r in ends.collect()} == brute_ends(rows, k)
    plain = both_ends(df, "value", "tag", k, "up", "down")
    assert plain.columns == ["tag", "value", "other", "up", "down"]
    assert {r.tag: (r.up, r.down) for r in plain.collect()} == {t: r[:2] for t, r in brute_ends(rows, k).items()}


def test_unique_report_counts_repeated_keys_of_every_model(spark):
    models = {
        "a": spark.createDataFrame([(1, "x"), (1, "y"), (None, "y"), (None, "y"), (2, None)], "id long, name string"),
        "b": spark.createDataFrame([], "id long"),
    }
    tests = [("a", "id"), ("b", "id"), ("a", "name")]
    got = {(r.model, r.column_name): (r.failures, r.passed) for r in unique_report(models, tests).collect()}
    assert got == {("a", "id"): (1, False), ("b", "id"): (0, True), ("a", "name"): (1, False)}
