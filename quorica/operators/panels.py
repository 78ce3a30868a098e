"""Parametrised dashboard queries, including the steps a dashboard does after loading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorica.functions.catalogues import (
    ANSWER_TIME_TIERS,
    FEATURE_LABELS,
    FEATURES,
    LAST_ANSWER_TIME_TIER,
    PRACTICE_LABELS,
)
from quorica.functions.expressions import first_below, mean, month_of, row_count, share
from quorica.operators.ranking import both_ends
from quorica.operators.trends import answer_rates, year_pair

Years = Sequence[int]


def in_years(years: Years) -> Column:
    return F.col("creation_year").isin(*years)


def questions_of_years(questions: DataFrame, years: Years) -> DataFrame:
    """Questions of the given years.

    A stored mart is partitioned by month; the same bound on that column lets
    Spark skip the folders of other years.
    """
    rows = questions.where(in_years(years))
    if "creation_month" in questions.columns:
        first, last = (F.make_date(F.lit(y), F.lit(m), F.lit(1)) for y, m in ((min(years), 1), (max(years), 12)))
        rows = rows.where(F.col("creation_month").between(first, last))
    return rows


def kpis(questions: DataFrame, years: Years) -> DataFrame:
    """Headline figures; a question counts once however many tags it has."""
    return questions_of_years(questions, years).agg(
        row_count().alias("total_questions"),
        share(F.col("is_answered")).alias("pct_answered"),
        share(F.col("has_accepted_answer")).alias("pct_accepted"),
        F.sum("view_count").alias("total_views"),
    )


def top_n_tags(facts: DataFrame, years: Years, n: int) -> DataFrame:
    """The n largest tags over the years: n rows at most."""
    totals = facts.where(in_years(years)).groupBy("tag").agg(F.sum("num_questions").alias("total"))
    return totals.orderBy(F.desc("total"), "tag").limit(n)


def top_n_tag_trend(facts: DataFrame, years: Years, n: int = 10) -> DataFrame:
    """Yearly volume of the n largest tags; the broadcast side has n rows."""
    top = F.broadcast(top_n_tags(facts, years, n).select("tag"))
    return (
        facts.where(in_years(years))
        .join(top, "tag")
        .select("tag", "creation_year", "num_questions")
        .orderBy("tag", "creation_year")
    )


def monthly_volume(questions: DataFrame, years: Years) -> DataFrame:
    return (
        questions_of_years(questions, years)
        .groupBy(month_of(F.col("creation_date")).alias("month"))
        .agg(row_count().alias("num_questions"), share(F.col("has_accepted_answer")).alias("pct_accepted"))
        .orderBy("month")
    )


def _growth(facts: DataFrame, years: Years, floor: int) -> DataFrame:
    first, last = years[0], years[-1]
    return year_pair(facts, first, last, floor).select("tag", f"q_{first}", f"q_{last}", "growth_rate")


def tag_growth(facts: DataFrame, years: Years, floor: int = 200) -> DataFrame:
    """Growth of every tag above the floor in the first and last year."""
    return _growth(facts, years, floor).orderBy(F.desc("growth_rate"), "tag")


def _head_and_tail(df: DataFrame, value: str, k: int, label: str, head: str, tail: str) -> DataFrame:
    """The k highest and the k lowest rows; with fewer than 2k rows some appear twice."""
    ends = both_ends(df, value, "tag", k, "from_top", "from_bottom")
    sides = F.array(F.when(F.col("from_top") <= k, head), F.when(F.col("from_bottom") <= k, tail))
    return ends.withColumn(label, F.explode(F.array_compact(sides))).drop("from_top", "from_bottom")


def growth_head_tail(facts: DataFrame, years: Years, floor: int = 200, k: int = 10) -> DataFrame:
    """Both ends of the growth list, in percent rounded half to even."""
    percent = F.bround(F.col("growth_rate").cast("decimal(18,4)") * 100, 1).cast("double")
    return (
        _head_and_tail(_growth(facts, years, floor), "growth_rate", k, "direction", "Rising", "Falling")
        .withColumn("growth_pct", percent)
        .orderBy("growth_rate", "tag", "direction")
    )


def _rates(facts: DataFrame, years: Years, floor: int) -> DataFrame:
    return answer_rates(facts, years, floor).select("tag", "total_questions", "pct_answered", "pct_accepted", "avg_score")


def answer_rates_min_volume(facts: DataFrame, years: Years, floor: int = 500) -> DataFrame:
    return _rates(facts, years, floor).orderBy(F.desc("pct_answered"), "tag")


def answer_rate_extremes(facts: DataFrame, years: Years, floor: int = 500, k: int = 15) -> DataFrame:
    return _head_and_tail(_rates(facts, years, floor), "pct_answered", k, "side", "best", "worst").orderBy(
        "side", F.desc("pct_answered"), "tag"
    )


def time_to_answer_tiers(questions: DataFrame, years: Years) -> DataFrame:
    """Answered questions by time to the first answer; an early answer counts as under an hour."""
    hours = F.col("hours_to_first_answer")
    return (
        questions_of_years(questions, years)
        .where(F.col("is_answered") & hours.isNotNull())
        .groupBy(first_below(hours, ANSWER_TIME_TIERS, LAST_ANSWER_TIME_TIER).alias("tier"))
        .agg(row_count().alias("num_questions"))
        .withColumn("label", F.substr("tier", F.lit(4)))
        .orderBy("tier")
    )


def dialect_table(dialects: DataFrame) -> DataFrame:
    return dialects.select(
        "dialect",
        "creation_year",
        "num_questions",
        "pct_answered",
        "pct_accepted",
        "avg_score",
        "total_views",
        "avg_views",
    ).orderBy("dialect", "creation_year")


def dialect_rollup(dialects: DataFrame, years: Years) -> DataFrame:
    """Dialects over the years; yearly shares count equally and round half to even."""

    def even_mean(column: str, digits: int) -> Column:
        exact = F.avg(F.col(column).cast("decimal(18,4)"))
        return F.bround(exact, digits).cast("double").alias(column)

    return (
        dialects.where(in_years(years))
        .groupBy("dialect")
        .agg(
            F.sum("num_questions").alias("total_questions"),
            even_mean("pct_answered", 4),
            even_mean("pct_accepted", 4),
            even_mean("avg_score", 2),
            F.sum("total_views").alias("total_views"),
        )
        .orderBy(F.desc("total_questions"), "dialect")
    )


def complexity_by_tier(complexity: DataFrame, years: Years) -> DataFrame:
    """Tier labels start with their rank, so ordering by label keeps tier order."""
    return (
        complexity.where(in_years(years))
        .groupBy("complexity_tier")
        .agg(
            row_count().alias("num_questions"),
            share(F.col("is_answered")).alias("pct_answered"),
            share(F.col("has_accepted_answer")).alias("pct_accepted"),
            mean(F.col("score")).alias("avg_score"),
            mean(F.col("complexity_score"), 1).alias("avg_complexity_score"),
            F.sum("view_count").alias("total_views"),
        )
        .orderBy("complexity_tier")
    )


def feature_presence_wide(complexity: DataFrame, years: Years | None = None) -> DataFrame:
    """Percentage of questions with each feature; all years unless some are given."""
    rows = complexity if years is None else complexity.where(in_years(years))

    def percent(flag: str) -> Column:
        part = F.try_divide(F.sum(flag).cast("double"), row_count().cast("double"))
        return F.round(part * 100, 1).alias(f"{flag.removeprefix('f_')}_pct")

    return rows.agg(*map(percent, FEATURE_LABELS))


def feature_presence_long(complexity: DataFrame, years: Years | None = None) -> DataFrame:
    """One row per feature with its label and level."""
    levels = {f.flag: f.level for f in FEATURES}
    rows = [
        F.struct(
            F.lit(label).alias("feature"),
            F.col(f"{flag.removeprefix('f_')}_pct").alias("pct"),
            F.lit(levels[flag]).alias("level"),
        )
        for flag, label in FEATURE_LABELS.items()
    ]
    return (
        feature_presence_wide(complexity, years)
        .select(F.explode(F.array(*rows)).alias("r"))
        .select("r.*")
        .orderBy("pct", "feature")
    )


def _practice_picks(complexity: DataFrame, tier: str) -> DataFrame:
    return complexity.where((F.col("complexity_tier") == tier) & (F.col("complexity_score") > 0)).select(
        "question_id", "complexity_score", "complexity_tier", *PRACTICE_LABELS
    )


def _practice_rows(questions: DataFrame, picked: DataFrame) -> DataFrame:
    facts = questions.select("question_id", "title", "score", "view_count", "tags")
    return facts.join(picked, "question_id").select(
        "question_id",
        "title",
        "score",
        "view_count",
        F.array_join("tags", ", ").alias("tags_str"),
        "complexity_score",
        "complexity_tier",
        *PRACTICE_LABELS,
    )


def practice_candidates(questions: DataFrame, complexity: DataFrame, tier: str) -> DataFrame:
    """Questions of one tier with their tags as text and the practice flags."""
    return _practice_rows(questions, _practice_picks(complexity, tier))


def practice_pool(questions: DataFrame, complexity: DataFrame, tier: str, seed: int, n: int = 50) -> DataFrame:
    """A random sample of the candidates.

    The random order is a digest of seed and id, so a retried task or another
    partitioning draws the same sample; another seed draws another one. The n
    smallest digests are taken before the join, which n rows reach: both marts
    have one row for each selected question, so the join drops none of them.
    The rebalance shuffles the joined rows, few as they are: the sort's two runs
    read those, and the join with all questions is run once.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("question_id").cast("string")))
    picked = _practice_picks(complexity, tier).orderBy(draw, "question_id").limit(n)
    rows = _practice_rows(questions, F.broadcast(picked))
    return rows.hint("rebalance", "question_id").orderBy(draw, "question_id")


def active_features(complexity: DataFrame) -> DataFrame:
    """Comma list of the labels of the practice flags that are set."""
    labels = [F.when(F.col(flag) != 0, F.lit(label)) for flag, label in PRACTICE_LABELS.items()]
    return complexity.select("question_id", F.concat_ws(", ", *labels).alias("features"))
