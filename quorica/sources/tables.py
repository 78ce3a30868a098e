"""The raw forum tables as one bundle, and readers that produce it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from quorica.sources.schemas import RAW_SCHEMAS


@dataclass(frozen=True)
class ForumTables:
    """Five raw DataFrames. ``slim_questions`` is ``questions`` without the body.

    A source that computes the body from another table can pass its own
    ``slim_questions`` and so spare that work for operators that read no text.
    """

    questions: DataFrame
    answers: DataFrame
    users: DataFrame
    comments: DataFrame
    tags: DataFrame
    slim_questions: DataFrame | None = None
    leads: Mapping[str, timedelta] = field(default_factory=dict)

    def __post_init__(self):
        if self.slim_questions is None:
            object.__setattr__(self, "slim_questions", self.questions.drop("body"))


def read_forum(spark: SparkSession, root: str, fmt: str = "parquet") -> ForumTables:
    """Read ``root/<table>`` for each raw table with its declared schema."""
    return ForumTables(
        **{name: spark.read.format(fmt).schema(schema).load(f"{root}/{name}") for name, schema in RAW_SCHEMAS.items()}
    )
