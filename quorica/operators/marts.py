"""Core marts: question grain, tag by year, dialect by year, complexity."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorica.functions.catalogues import (
    COMPLEXITY_TIERS,
    DIALECT_TAGS,
    FEATURES,
    TOP_COMPLEXITY_TIER,
)
from quorica.functions.expressions import first_below, mean, row_count, share
from quorica.functions.patterns import (
    LONG_S,
    ascii_fold,
    first_words,
    folded,
    matches,
    matches_at_least,
    starts_match,
)

FLAGS = [f.flag for f in FEATURES]
# The ad-hoc scoring query lists every flag but the data-definition ones.
SHOWCASE_FLAGS = [f.flag for f in FEATURES if f.level != "DML / DDL"]

_QUESTION_FACTS = ["question_id", "creation_year", "score", "view_count", "is_answered", "has_accepted_answer"]


def first_answer(answers: DataFrame) -> DataFrame:
    """Earliest answer time of each question, from staged answers."""
    return answers.groupBy("question_id").agg(F.min("creation_date").alias("first_answer_at"))


def dim_questions(questions: DataFrame, users: DataFrame, answers: DataFrame) -> DataFrame:
    """One enriched row per staged question."""
    authors = users.select(
        F.col("user_id"),
        F.col("display_name").alias("owner_display_name"),
        F.col("reputation").alias("owner_reputation"),
    )
    hours = F.timestamp_diff("HOUR", F.col("creation_date"), F.col("first_answer_at"))
    return (
        questions.join(first_answer(answers), "question_id", "left")
        .join(authors, F.col("owner_user_id") == F.col("user_id"), "left")
        .select(
            "question_id",
            "title",
            "owner_user_id",
            "owner_display_name",
            "owner_reputation",
            "creation_date",
            F.year("creation_date").cast("long").alias("creation_year"),
            "score",
            "view_count",
            "answer_count",
            "comment_count",
            "favorite_count",
            (F.col("answer_count") > 0).alias("is_answered"),
            "has_accepted_answer",
            "first_answer_at",
            hours.alias("hours_to_first_answer"),
            "tags",
        )
    )


def tag_explode(questions: DataFrame) -> DataFrame:
    """One row per question and tag, without empty tags."""
    return questions.select(
        F.explode("tags").alias("tag"), *_QUESTION_FACTS, "answer_count"
    ).where(F.col("tag") != "")


def fct_tag_yearly(questions: DataFrame) -> DataFrame:
    """Counts, shares and averages by tag and year."""
    return (
        tag_explode(questions)
        .groupBy("tag", "creation_year")
        .agg(
            row_count().alias("num_questions"),
            F.count_if("is_answered").alias("num_answered"),
            share(F.col("is_answered")).alias("pct_answered"),
            F.count_if("has_accepted_answer").alias("num_accepted"),
            share(F.col("has_accepted_answer")).alias("pct_accepted"),
            mean(F.col("score")).alias("avg_score"),
            F.percentile_approx("score", 0.5, 10000).alias("median_score"),
            F.sum("view_count").alias("total_views"),
            mean(F.col("answer_count")).alias("avg_answers_per_question"),
        )
        .select(F.concat("tag", F.lit("|"), F.col("creation_year").cast("string")).alias("tag_year_key"), "*")
    )


def question_dialects(questions: DataFrame) -> DataFrame:
    """One row per question and dialect family.

    A question's dialects depend on its own tags only, so there is nothing to join or to shuffle.
    """

    def named(dialect: str, tags: list[str]) -> Column:
        return F.when(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(dialect))

    dialects = F.array_compact(F.array(*(named(*entry) for entry in DIALECT_TAGS.items())))
    return questions.select(F.explode(dialects).alias("dialect"), *_QUESTION_FACTS)


def dialect_mart(questions: DataFrame) -> DataFrame:
    """Counts, shares and averages by dialect family and year."""
    return (
        question_dialects(questions)
        .groupBy("dialect", "creation_year")
        .agg(
            row_count().alias("num_questions"),
            F.count_if("is_answered").alias("num_answered"),
            share(F.col("is_answered")).alias("pct_answered"),
            F.count_if("has_accepted_answer").alias("num_accepted"),
            share(F.col("has_accepted_answer")).alias("pct_accepted"),
            mean(F.col("score")).alias("avg_score"),
            F.sum("view_count").alias("total_views"),
            mean(F.col("view_count"), 0).alias("avg_views"),
        )
    )


def feature_flags(questions: DataFrame, *kept: Column) -> DataFrame:
    """The 22 feature flags of each raw question, 0 or 1, after any columns to keep.

    ``inline`` makes the flags outputs of a generator. Filters and scores above
    it refer to finished values; through a projection Catalyst would copy the
    regexes into each of them and search every body again.

    One pass finds the first words of all features, in any case. A text with a long s, whose word boundaries are
    others, is searched feature by feature; only there is the folded text needed.
    """
    text, plain, words = F.col("text"), F.col("plain"), F.col("words")

    def flag(feature) -> Column:
        if feature.min_hits > 1:
            searched = matches_at_least(text, plain, feature, feature.min_hits)
        else:
            searched = matches(text, plain, feature)
        hit = F.when(plain.isNull(), starts_match(words, feature, feature.min_hits)).otherwise(searched)
        return hit.cast("long").alias(feature.flag)

    return (
        questions.select(F.col("id").alias("question_id"), *kept, F.coalesce("body", F.lit("")).alias("text"))
        .withColumn("text", ascii_fold(text))
        .withColumn("plain", F.when(F.contains(text, F.lit(LONG_S)), folded(text)))
        .withColumn("words", F.when(plain.isNull(), first_words(text, FEATURES)))
        .select("*", F.inline(F.array(F.struct(*map(flag, FEATURES)))))
        .drop("text", "plain", "words")
    )


def complexity_score() -> Column:
    return reduce(add, [F.col(f.flag) * f.weight for f in FEATURES])


def complexity_tier(score: Column) -> Column:
    return first_below(score, COMPLEXITY_TIERS, TOP_COMPLEXITY_TIER, inclusive=True)


def complexity_mart(raw_questions: DataFrame) -> DataFrame:
    """Facts, score and tier per raw question; facts and flags come from one pass without a join."""
    facts = (
        F.year("creation_date").cast("long").alias("creation_year"),
        F.col("score"),
        F.col("view_count"),
        (F.col("answer_count") > 0).alias("is_answered"),
        F.col("accepted_answer_id").isNotNull().alias("has_accepted_answer"),
    )
    scored = feature_flags(raw_questions, *facts).withColumn("complexity_score", complexity_score())
    return scored.select(
        *_QUESTION_FACTS,
        "complexity_score",
        complexity_tier(F.col("complexity_score")).alias("complexity_tier"),
        *FLAGS,
    )
