"""Regex text mining over question and answer bodies.

Patterns are literals in one projection: each text is read once, and only
matched labels go through the shuffle, never the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorica.functions.catalogues import ERROR_SIGNATURES, KEYWORDS
from quorica.functions.expressions import mean, ratio, row_count, share
from quorica.functions.patterns import folded, label_each, search_text
from quorica.operators.marts import SHOWCASE_FLAGS


def error_matches(questions: DataFrame) -> DataFrame:
    """One row per raw question and error signature found in title or body."""
    facts = ["score", "view_count", "answer_count", "accepted_answer_id"]
    text = search_text(F.col("title"), F.col("body"))
    return (
        questions.select(*facts, text.alias("text"))
        .withColumn("plain", folded(F.col("text")))
        .select(*facts, label_each(F.col("text"), F.col("plain"), ERROR_SIGNATURES).alias("error_pattern"))
        .where(F.col("error_pattern").isNotNull())
    )


def error_patterns(questions: DataFrame) -> DataFrame:
    """Volume and answer signal of every error signature found, most frequent first."""
    accepted = F.col("accepted_answer_id").isNotNull()
    return (
        error_matches(questions)
        .groupBy("error_pattern")
        .agg(
            row_count().alias("num_questions"),
            mean(F.col("score")).alias("avg_score"),
            F.sum("score").alias("total_upvotes"),
            F.sum("view_count").alias("total_views"),
            share(F.col("answer_count") > 0).alias("pct_answered"),
            share(accepted).alias("pct_accepted"),
            mean(F.col("answer_count")).alias("avg_answers_per_q"),
        )
        .orderBy(F.desc("num_questions"), "error_pattern")
    )


def top_error_patterns(patterns: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent rows of the error table."""
    return patterns.orderBy(F.desc("num_questions"), "error_pattern").limit(limit)


def accepted_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Raw answers that a question names as accepted."""
    accepted = questions.select("accepted_answer_id").where(F.col("accepted_answer_id").isNotNull())
    return answers.join(accepted, F.col("id") == F.col("accepted_answer_id")).drop("accepted_answer_id")


def keyword_hits(posts: DataFrame) -> DataFrame:
    """One row per post and keyword found in its body."""
    return (
        posts.select("id", search_text(F.col("body")).alias("text"))
        .withColumn("plain", folded(F.col("text")))
        .select("id", label_each(F.col("text"), F.col("plain"), KEYWORDS).alias("keyword"))
        .where(F.col("keyword").isNotNull())
    )


def keyword_frequency(questions: DataFrame, answers: DataFrame, slim_questions: DataFrame | None = None) -> DataFrame:
    """Keyword counts in questions and in accepted answers, and their ratio.

    Answers are matched before the join with the accepted ids, so the join
    moves ids and labels instead of bodies. ``slim_questions`` may give those
    ids from a cheaper source.
    """
    ids = questions if slim_questions is None else slim_questions
    asked = keyword_hits(questions).select("keyword", F.lit(1).alias("asked"))
    solved = accepted_answers(keyword_hits(answers), ids).select("keyword", F.lit(0).alias("asked"))
    in_questions, in_answers = F.col("in_questions"), F.col("in_accepted_answers")
    return (
        asked.unionByName(solved)
        .groupBy("keyword")
        .agg(
            F.count_if(F.col("asked") == 1).alias("in_questions"),
            F.count_if(F.col("asked") == 0).alias("in_accepted_answers"),
        )
        .where(in_questions > 0)
        .withColumn("answer_to_question_ratio", ratio(in_answers, in_questions))
        .orderBy(F.desc("in_accepted_answers"), "keyword")
    )


def complexity_scoring(complexity: DataFrame) -> DataFrame:
    """The complexity mart with the 16 query flags, highest score first.

    A sort draws its ranges from a run over all its input, then runs that input again. The rebalance shuffles the
    narrow rows first, so both runs read those and the bodies are searched once.
    """
    shown = complexity.select(
        "question_id",
        "creation_year",
        "score",
        "view_count",
        "is_answered",
        "has_accepted_answer",
        "complexity_score",
        "complexity_tier",
        *SHOWCASE_FLAGS,
    )
    return shown.hint("rebalance", "question_id").orderBy(F.desc("complexity_score"), "question_id")
