"""Corpus selection: five raw tables cut to one topic and kept consistent."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorica.sources.sinks import in_window, without_partitions


def select_questions(questions: DataFrame, start: str, end: str, topic: str) -> DataFrame:
    """Questions created in ``[start, end)`` whose tag string contains the topic.

    Over a date-partitioned table only the folders of the window are read.
    """
    picked = questions.where(in_window(questions, start, end) & F.col("tags").contains(topic))
    return without_partitions(picked)


def exclude_tag(questions: DataFrame, tag: str) -> DataFrame:
    """Questions that do not carry exactly this tag."""
    return questions.where(~F.array_contains(F.split("tags", r"\|"), tag))


def _since(posts: DataFrame, since: datetime | None) -> DataFrame:
    return without_partitions(posts.where(in_window(posts, since, None)))


def select_answers(answers: DataFrame, questions: DataFrame, since: datetime | None = None) -> DataFrame:
    """Answers whose parent is a selected question.

    ``since`` is a time before which no answer of these questions was written; over a date-partitioned
    table earlier folders aren't read.
    """
    asked = questions.select(F.col("id").alias("question_id"))
    return _since(answers, since).join(asked, F.col("parent_id") == F.col("question_id"), "left_semi")


def select_users(users: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Users who wrote a selected question or answer.

    The distinct comes before the join: its map-side pass shrinks a prolific
    author to one row per task, and the join reuses its partitioning.
    """
    owners = questions.select("owner_user_id").union(answers.select("owner_user_id"))
    authors = owners.where(F.col("owner_user_id").isNotNull()).distinct()
    return users.join(authors, F.col("id") == F.col("owner_user_id"), "left_semi")


def select_comments(
    comments: DataFrame, questions: DataFrame, answers: DataFrame, since: datetime | None = None
) -> DataFrame:
    """Comments on a selected question or answer, none of which was written before ``since``.

    A semi join needs no distinct on its right side; post ids are unique anyway.
    """
    posts = questions.select(F.col("id").alias("target_id")).union(answers.select("id"))
    return _since(comments, since).join(posts, F.col("post_id") == F.col("target_id"), "left_semi")


def select_tags(tags: DataFrame) -> DataFrame:
    """The whole tag dictionary."""
    return tags
