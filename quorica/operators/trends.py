"""Trend analyses over the tag-by-year facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorica.functions.expressions import mean, ratio, sum_where
from quorica.operators.ranking import both_ends, top_rows

Years = Sequence[int]


def top_tags_by_volume(facts: DataFrame, years: Years, limit: int = 20) -> DataFrame:
    """Largest tags with a column per year and the change from first to last year."""
    first, last = years[0], years[-1]
    year, n = F.col("creation_year"), F.col("num_questions")
    totals = (
        facts.where(year.between(first, last))
        .groupBy("tag")
        .agg(
            F.sum(n).alias("total_questions"),
            F.sum("total_views").alias("total_views"),
            *[sum_where(year == y, n).alias(f"q_{y}") for y in years],
        )
    )
    ranked = top_rows(totals, [F.desc("total_questions"), F.asc("tag")], limit, "row")
    tied = F.rank().over(Window.orderBy(F.desc("total_questions")))
    return ranked.select(
        tied.cast("long").alias("rank"),
        "tag",
        "total_questions",
        "total_views",
        *[f"q_{y}" for y in years],
        (F.col(f"q_{last}") - F.col(f"q_{first}")).alias(f"delta_{first}_{last}"),
    ).orderBy(F.desc("total_questions"), "tag")


def tag_yoy_growth(facts: DataFrame, years: Years, floor: int = 500) -> DataFrame:
    """Growth against the previous year present, for tags above the floor in two years.

    The floor test is a window over the same partition as ``lag``, which saves
    the semi join: one shuffle by tag serves both.
    """
    by_tag = Window.partitionBy("tag")
    n, previous = F.col("num_questions"), F.col("prev_year_questions")
    return (
        facts.where(F.col("creation_year").between(years[0], years[-1]))
        .withColumn("prev_year_questions", F.lag(n).over(by_tag.orderBy("creation_year")))
        .withColumn("years_above_floor", F.count_if(n >= floor).over(by_tag))
        .where(F.col("years_above_floor") >= 2)
        .select(
            "tag",
            "creation_year",
            "num_questions",
            "prev_year_questions",
            ratio(n - previous, previous).alias("yoy_growth_rate"),
            F.round("pct_answered", 4).alias("pct_answered"),
            F.round("avg_score", 2).alias("avg_score"),
        )
        .orderBy("tag", "creation_year")
    )


def year_pair(facts: DataFrame, first: int, last: int, floor: int = 200) -> DataFrame:
    """Tags above the floor in both years, with their growth.

    A fact has one row per tag and year, so one grouped pass replaces a self join.
    """
    year = F.col("creation_year")

    def at(y: int, column: str):
        return F.max(F.when(year == y, F.col(column)))

    before, after = F.col(f"q_{first}"), F.col(f"q_{last}")
    return (
        facts.where(year.isin(first, last))
        .groupBy("tag")
        .agg(
            at(first, "num_questions").alias(f"q_{first}"),
            at(last, "num_questions").alias(f"q_{last}"),
            at(first, "pct_answered").alias(f"pct_answered_{first}"),
            at(last, "pct_answered").alias(f"pct_answered_{last}"),
        )
        .where((before >= floor) & (after >= floor))
        .select(
            "tag",
            before,
            after,
            (after - before).alias("abs_change"),
            ratio(after - before, before).alias("growth_rate"),
            f"pct_answered_{first}",
            f"pct_answered_{last}",
        )
    )


def rising_falling_tags(facts: DataFrame, years: Years, floor: int = 200, limit: int = 10) -> DataFrame:
    """Fastest risers and fallers between the first and last year.

    ``rank_within_group`` counts from the fastest riser for fallers too, as
    published; ``rank_in_direction`` counts from the respective end.
    """
    first, last = years[0], years[-1]
    rising = F.col("riser_rank") <= limit
    ends = both_ends(year_pair(facts, first, last, floor), "growth_rate", "tag", limit, "riser_rank", "faller_rank")
    return ends.select(
        F.when(rising, F.lit("rising")).otherwise(F.lit("falling")).alias("direction"),
        F.col("riser_rank").cast("string").alias("rank_within_group"),
        F.when(rising, F.col("riser_rank")).otherwise(F.col("faller_rank")).alias("rank_in_direction"),
        "tag",
        f"q_{first}",
        f"q_{last}",
        "abs_change",
        "growth_rate",
        f"pct_answered_{first}",
        f"pct_answered_{last}",
    ).orderBy(F.desc("direction"), F.desc("growth_rate"), "tag")


def answer_rates(facts: DataFrame, years: Years, floor: int = 500) -> DataFrame:
    """Answer and acceptance rates of tags above the floor; yearly averages count equally."""
    asked = F.sum("num_questions")
    return (
        facts.where(F.col("creation_year").isin(*years))
        .groupBy("tag")
        .agg(
            asked.alias("total_questions"),
            F.sum("num_answered").alias("total_answered"),
            F.sum("num_accepted").alias("total_accepted"),
            ratio(F.sum("num_answered"), asked).alias("pct_answered"),
            ratio(F.sum("num_accepted"), asked).alias("pct_accepted"),
            mean(F.col("avg_score")).alias("avg_score"),
            mean(F.col("avg_answers_per_question")).alias("avg_answers_per_q"),
        )
        .where(F.col("total_questions") >= floor)
    )


def answer_rate_by_tag(facts: DataFrame, years: Years, floor: int = 500, limit: int = 15) -> DataFrame:
    """Best and worst answered tags, with their ranks by answer and acceptance rate."""
    rates = answer_rates(facts, range(years[0], years[-1] + 1), floor)
    ends = both_ends(
        rates, "pct_answered", "tag", limit, "best_answered_rank", "worst_answered_rank",
        other="pct_accepted", other_rank="best_accepted_rank",
    )
    best = F.col("best_answered_rank") <= limit
    return ends.select(
        F.when(best, F.lit("highest answer rate")).otherwise(F.lit("lowest answer rate")).alias("cohort"),
        "tag",
        "total_questions",
        "pct_answered",
        "pct_accepted",
        "avg_score",
        "avg_answers_per_q",
        "best_answered_rank",
        "worst_answered_rank",
        "best_accepted_rank",
    ).orderBy("cohort", F.desc("pct_answered"), "tag")


def dialect_frequency(dialects: DataFrame) -> DataFrame:
    """The dialect mart, largest dialect first.

    The window partitions by dialect; the mart has one row per dialect and year.
    """
    total = F.sum("num_questions").over(Window.partitionBy("dialect"))
    return (
        dialects.withColumn("dialect_total", total)
        .orderBy(F.desc("dialect_total"), "dialect", "creation_year")
        .drop("dialect_total")
    )
