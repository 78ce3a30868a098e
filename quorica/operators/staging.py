"""Typed projections over the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stg_questions(questions: DataFrame) -> DataFrame:
    return questions.select(
        F.col("id").alias("question_id"),
        "title",
        "owner_user_id",
        "creation_date",
        "last_activity_date",
        "score",
        "view_count",
        "answer_count",
        "comment_count",
        "favorite_count",
        "accepted_answer_id",
        F.col("accepted_answer_id").isNotNull().alias("has_accepted_answer"),
        F.col("tags").alias("tags_raw"),
        F.split("tags", r"\|").alias("tags"),
    )


def stg_answers(answers: DataFrame) -> DataFrame:
    return answers.select(
        F.col("id").alias("answer_id"),
        F.col("parent_id").alias("question_id"),
        "owner_user_id",
        "creation_date",
        "last_activity_date",
        "last_edit_date",
        "score",
        "comment_count",
    )


def stg_users(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("id").alias("user_id"),
        "display_name",
        "reputation",
        F.col("age").try_cast("long").alias("age"),
        "location",
        "up_votes",
        "down_votes",
        F.col("views").alias("profile_views"),
        F.col("creation_date").alias("account_created_at"),
        "last_access_date",
        "website_url",
    )


def stg_comments(comments: DataFrame) -> DataFrame:
    return comments.select(
        F.col("id").alias("comment_id"),
        "post_id",
        "user_id",
        "score",
        "creation_date",
        F.col("text").alias("comment_text"),
    )


def stg_tags(tags: DataFrame) -> DataFrame:
    return tags.select(
        F.col("id").alias("tag_id"),
        "tag_name",
        F.col("count").alias("sitewide_question_count"),
    )
