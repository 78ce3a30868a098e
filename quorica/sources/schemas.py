"""Explicit schemas of the five raw tables."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType


def _schema(longs: str = "", strings: str = "", times: str = "", required: str = "id") -> StructType:
    typed = ((longs, LongType()), (strings, StringType()), (times, TimestampNTZType()))
    return StructType(
        [StructField(n, kind, n not in required.split()) for names, kind in typed for n in names.split()]
    )


QUESTIONS = _schema(
    "id owner_user_id score view_count answer_count comment_count favorite_count accepted_answer_id",
    "title body tags",
    "creation_date last_activity_date",
)
ANSWERS = _schema(
    "id parent_id owner_user_id score comment_count",
    "body",
    "creation_date last_activity_date last_edit_date",
)
USERS = _schema(
    "id reputation up_votes down_votes views",
    "display_name age location website_url",
    "creation_date last_access_date",
)
COMMENTS = _schema("id post_id user_id score", "text", "creation_date")
TAGS = _schema("id count", "tag_name")

RAW_SCHEMAS = {
    "questions": QUESTIONS,
    "answers": ANSWERS,
    "users": USERS,
    "comments": COMMENTS,
    "tags": TAGS,
}
