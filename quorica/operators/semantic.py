"""Named dimensions and measures over the two core marts, and the dashboard tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorica.functions.catalogues import (
    ANSWER_HOURS_BOUNDS,
    LINK_ROOT,
    PCT_ANSWERED_BOUNDS,
    REPUTATION_BOUNDS,
)
from quorica.functions.expressions import integer_tier, month_of, row_count
from quorica.operators.panels import in_years
from quorica.operators.ranking import top_rows

Years = Sequence[int]


def _yes_share(flag: str) -> Column:
    return F.avg(F.when(F.col(flag), 1.0).otherwise(0.0))


def fact_dimensions() -> dict[str, Column]:
    return {
        "tag": F.col("tag"),
        "creation_year": F.col("creation_year"),
        "pct_answered_tier": integer_tier(F.col("pct_answered") * 100, PCT_ANSWERED_BOUNDS),
        "tag_link": F.concat(F.lit(f"{LINK_ROOT}tagged/"), F.url_encode("tag")),
    }


def fact_measures() -> dict[str, Column]:
    """Averages weigh every tag-year row alike."""
    return {
        "total_questions": F.sum("num_questions"),
        "total_answered": F.sum("num_answered"),
        "total_accepted": F.sum("num_accepted"),
        "pct_answered": F.avg("pct_answered"),
        "pct_accepted": F.avg("pct_accepted"),
        "avg_score": F.avg("avg_score"),
        "total_views": F.sum("total_views"),
        "avg_answers_per_question": F.avg("avg_answers_per_question"),
        "count_tag_year_rows": row_count(),
    }


def question_dimensions() -> dict[str, Column]:
    day = F.to_date("creation_date")
    plain = [
        "question_id",
        "title",
        "creation_year",
        "score",
        "view_count",
        "answer_count",
        "comment_count",
        "is_answered",
        "has_accepted_answer",
        "hours_to_first_answer",
        "owner_user_id",
        "owner_display_name",
        "owner_reputation",
    ]
    return {name: F.col(name) for name in plain} | {
        "creation_raw": F.col("creation_date"),
        "creation_date": day,
        "creation_month": month_of(F.col("creation_date")),
        "creation_quarter": F.trunc(day, "quarter"),
        "creation_calendar_year": F.trunc(day, "year"),
        "time_to_answer_tier": integer_tier(F.col("hours_to_first_answer"), ANSWER_HOURS_BOUNDS),
        "reputation_tier": integer_tier(F.col("owner_reputation"), REPUTATION_BOUNDS),
        "question_link": F.concat(F.lit(LINK_ROOT), F.col("question_id").cast("string")),
    }


def question_measures() -> dict[str, Column]:
    """The median keeps a count per distinct hour, so its state grows with the time span, not the rows."""
    return {
        "count": row_count(),
        "pct_answered": _yes_share("is_answered"),
        "pct_accepted": _yes_share("has_accepted_answer"),
        "avg_score": F.avg("score"),
        "total_views": F.sum("view_count"),
        "median_hours_to_answer": F.percentile("hours_to_first_answer", 0.5),
        "avg_owner_reputation": F.avg("owner_reputation"),
    }


def explore(
    mart: DataFrame,
    dimensions: dict[str, Column],
    measures: dict[str, Column],
    where: Column | None = None,
    having: Column | None = None,
    sorts: Sequence[Column | str] = (),
    limit: int | None = None,
    pivot: tuple[str, Sequence] | None = None,
) -> DataFrame:
    """Group a mart by named dimensions and compute named measures.

    ``pivot`` names one of the dimensions and the values that become columns.
    """
    rows = mart if where is None else mart.where(where)
    keys = [d.alias(name) for name, d in dimensions.items() if not pivot or name != pivot[0]]
    grouped = rows.groupBy(*keys)
    if pivot:
        grouped = grouped.pivot(pivot[0], list(pivot[1]))
    result = grouped.agg(*[m.alias(name) for name, m in measures.items()])
    if having is not None:
        result = result.where(having)
    if sorts:
        result = result.orderBy(*sorts)
    return result if limit is None else result.limit(limit)


def pick(registry: dict[str, Column], *names: str) -> dict[str, Column]:
    return {name: registry[name] for name in names}


def _explore_facts(facts: DataFrame, dims: Sequence[str], measures: Sequence[str], **options) -> DataFrame:
    return explore(facts, pick(fact_dimensions(), *dims), pick(fact_measures(), *measures), **options)


def _explore_questions(questions: DataFrame, dims: Sequence[str], measures: Sequence[str], **options) -> DataFrame:
    return explore(questions, pick(question_dimensions(), *dims), pick(question_measures(), *measures), **options)


def facts_by(facts: DataFrame, *dims: str) -> DataFrame:
    """All tag-fact measures by the given dimensions."""
    return _explore_facts(facts, dims, list(fact_measures()))


def questions_by(questions: DataFrame, *dims: str, measures: Sequence[str] | None = None) -> DataFrame:
    """All question measures, or the named ones, by the given dimensions."""
    return _explore_questions(questions, dims, measures or list(question_measures()))


def tile_kpis(facts: DataFrame, years: Years) -> DataFrame:
    """Headline tiles over tag facts: a question counts once per tag."""
    names = ["total_questions", "pct_answered", "pct_accepted", "total_views"]
    return _explore_facts(facts, [], names, where=in_years(years))


def tile_tag_volume_pivot(facts: DataFrame, years: Years, columns: int = 10) -> DataFrame:
    """Years as rows, the largest tags as columns, sorted by the first of them, highest first.

    Which tags are the largest is only known when the query runs, so columns are slots: ``tag_1`` names the
    largest tag in every row and ``total_questions_1`` holds its questions of the year, null without any.
    One pass over the facts gives a row per tag with its years as columns; ``columns`` rows of these go on.
    """
    year, n = F.col("creation_year"), F.col("num_questions")
    per_tag = (
        facts.where(in_years(years))
        .groupBy("tag")
        .agg(F.sum(n).alias("total"), *[F.sum(F.when(year == y, n)).alias(f"q_{y}") for y in years])
    )
    largest = top_rows(per_tag, [F.desc("total"), F.asc("tag")], columns, "slot")
    slots = range(1, columns + 1)
    names = {f"tag_{i}": F.max(F.when(F.col("slot") == i, F.col("tag"))).over(Window.partitionBy()) for i in slots}
    entries = F.array(*[F.struct(F.lit(y).alias("creation_year"), F.col(f"q_{y}").alias("n")) for y in years])
    cells = largest.withColumns(names).select("slot", *names, F.inline(entries)).where("n IS NOT NULL")
    wide = cells.groupBy("creation_year").agg(
        *[
            F.max(made).alias(name)
            for i in slots
            for name, made in (
                (f"tag_{i}", F.col(f"tag_{i}")),
                (f"total_questions_{i}", F.when(F.col("slot") == i, F.col("n"))),
            )
        ]
    )
    return wide.orderBy(F.desc_nulls_last("total_questions_1"), "creation_year")


def tile_best_answered(facts: DataFrame, years: Years, above: int = 500, limit: int = 15) -> DataFrame:
    return _explore_facts(
        facts,
        ["tag"],
        ["pct_answered", "total_questions"],
        where=in_years(years),
        having=F.col("total_questions") > above,
        sorts=[F.desc("pct_answered"), F.asc("tag")],
        limit=limit,
    )


def tile_volume(facts: DataFrame, years: Years, ascending: bool, limit: int = 10) -> DataFrame:
    """Volume of the first and last year by tag, sorted by the first; absent tags come last."""
    first, last = years[0], years[-1]
    order = F.asc_nulls_last(str(first)) if ascending else F.desc_nulls_last(str(first))
    return _explore_facts(
        facts,
        ["tag", "creation_year"],
        ["total_questions"],
        where=in_years([first, last]),
        pivot=("creation_year", [first, last]),
        sorts=[order, F.asc("tag")],
        limit=limit,
    ).withColumnsRenamed({str(y): f"total_questions_{y}" for y in (first, last)})


def tile_monthly(questions: DataFrame, limit: int | None = None) -> DataFrame:
    return _explore_questions(questions, ["creation_month"], ["count"], sorts=["creation_month"], limit=limit)


def tile_time_to_answer(questions: DataFrame) -> DataFrame:
    return _explore_questions(
        questions, ["time_to_answer_tier"], ["count"], where=F.col("is_answered"), sorts=["time_to_answer_tier"]
    )


def tile_reputation(questions: DataFrame) -> DataFrame:
    return _explore_questions(
        questions, ["reputation_tier"], ["count"], sorts=[F.desc("count"), F.asc("reputation_tier")]
    )


def time_to_answer_tier_all(questions: DataFrame) -> DataFrame:
    """Every question by answer-time tier; questions without an answer are ``Undefined``."""
    return _explore_questions(questions, ["time_to_answer_tier"], ["count"], sorts=["time_to_answer_tier"])


def pct_answered_tier(facts: DataFrame) -> DataFrame:
    return _explore_facts(
        facts, ["pct_answered_tier"], ["count_tag_year_rows", "total_questions"], sorts=["pct_answered_tier"]
    )


def creation_timeframes(questions: DataFrame) -> DataFrame:
    frames = ["creation_date", "creation_month", "creation_quarter", "creation_calendar_year"]
    return _explore_questions(questions, frames, ["count"])


def creation_raw(questions: DataFrame) -> DataFrame:
    """Questions by the unshortened time of their creation."""
    return _explore_questions(questions, ["creation_raw"], ["count"])


def question_links(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", question_dimensions()["question_link"].alias("question_link"))


def tag_links(facts: DataFrame) -> DataFrame:
    return facts.select("tag", fact_dimensions()["tag_link"].alias("tag_link")).distinct()
