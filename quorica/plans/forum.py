"""A forum workspace: every layer as a lazy DataFrame, built on first use."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta
from functools import cached_property, partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorica.operators import marts, selection, staging, textmining
from quorica.sources import sinks
from quorica.sources.store import Entry, Store
from quorica.sources.tables import ForumTables


@dataclass(frozen=True)
class Scope:
    """Topic, window and thresholds. The defaults are the published analysis."""

    start: str = "2020-01-01"
    end: str = "2023-01-01"
    topic: str = "sql"
    years: tuple[int, ...] = (2020, 2021, 2022)
    yearly_floor: int = 500
    pair_floor: int = 200
    total_floor: int = 500
    top_tags: int = 20
    trend_tags: int = 10
    movers: int = 10
    cohort: int = 15


class layer(cached_property):
    """A layer of the forum: read where a stored table replaces it, else built; once in either case."""

    def __init__(self, build: Callable[[Forum], DataFrame]):
        def get(forum: Forum) -> DataFrame:
            read = forum.stored.get(build.__name__)
            return read() if read else build(forum)

        super().__init__(get)


class Forum:
    """Layers of one forum. ``stored`` gives readers for layers already written."""

    def __init__(
        self, raw: ForumTables | None, scope: Scope, stored: dict[str, Callable[[], DataFrame]] | None = None
    ):
        self.raw = raw
        self.scope = scope
        self.stored = stored or {}

    def _in_scope(self, questions: DataFrame) -> DataFrame:
        s = self.scope
        return selection.select_questions(questions, s.start, s.end, s.topic)

    def _earliest(self, name: str) -> datetime | None:
        """Time before which the source has no answers, or comments, on questions of the window."""
        lead = self.raw.leads.get(name)
        return lead if lead is None else datetime.fromisoformat(self.scope.start) - lead

    @layer
    def questions(self) -> DataFrame:
        return self._in_scope(self.raw.questions)

    @layer
    def slim_questions(self) -> DataFrame:
        """Selected questions without the body."""
        if "questions" in self.stored:
            return self.questions.drop("body")
        return self._in_scope(self.raw.slim_questions)

    @layer
    def answers(self) -> DataFrame:
        return selection.select_answers(self.raw.answers, self.slim_questions, self._earliest("answers"))

    @layer
    def users(self) -> DataFrame:
        return selection.select_users(self.raw.users, self.slim_questions, self.answers)

    @layer
    def comments(self) -> DataFrame:
        return selection.select_comments(
            self.raw.comments, self.slim_questions, self.answers, self._earliest("comments")
        )

    @layer
    def tags(self) -> DataFrame:
        return selection.select_tags(self.raw.tags)

    @layer
    def stg_questions(self) -> DataFrame:
        return staging.stg_questions(self.slim_questions)

    @layer
    def stg_answers(self) -> DataFrame:
        return staging.stg_answers(self.answers)

    @layer
    def stg_users(self) -> DataFrame:
        return staging.stg_users(self.users)

    @layer
    def stg_comments(self) -> DataFrame:
        return staging.stg_comments(self.comments)

    @layer
    def stg_tags(self) -> DataFrame:
        return staging.stg_tags(self.tags)

    @layer
    def dim_questions(self) -> DataFrame:
        return marts.dim_questions(self.stg_questions, self.stg_users, self.stg_answers)

    @layer
    def fct_tag_yearly(self) -> DataFrame:
        return marts.fct_tag_yearly(self.dim_questions)

    @layer
    def dialects(self) -> DataFrame:
        return marts.dialect_mart(self.dim_questions)

    @layer
    def complexity(self) -> DataFrame:
        return marts.complexity_mart(self.questions)

    @layer
    def error_patterns(self) -> DataFrame:
        return textmining.error_patterns(self.questions)

    @layer
    def keyword_frequency(self) -> DataFrame:
        return textmining.keyword_frequency(self.questions, self.answers, self.slim_questions)

    @property
    def models(self) -> dict[str, DataFrame]:
        """Layers under declared column tests; the sources are tested without the body."""
        return {
            "questions": self.slim_questions,
            "answers": self.answers,
            "users": self.users,
            "stg_questions": self.stg_questions,
            "stg_answers": self.stg_answers,
            "stg_users": self.stg_users,
            "stg_comments": self.stg_comments,
            "stg_tags": self.stg_tags,
            "dim_questions": self.dim_questions,
            "fct_tag_yearly": self.fct_tag_yearly,
        }


@dataclass(frozen=True)
class Layout:
    """How a layer is stored: grain of its date partitions, if any, and sort keys, or the key of its buckets."""

    grain: str | None = None
    cluster: tuple[str, ...] = ()
    bucket: str | None = None


# In build order: each layer is computed from the written ones before it.
LAYOUTS = {
    "questions": Layout("day", ("owner_user_id", "id")),
    "answers": Layout("day", ("owner_user_id", "id")),
    "users": Layout(),
    "comments": Layout("day", ("post_id", "id")),
    "tags": Layout(),
    "dim_questions": Layout("month", ("owner_user_id", "question_id")),
    "fct_tag_yearly": Layout(),
    "dialects": Layout(),
    "complexity": Layout(),
    "error_patterns": Layout(),
    "keyword_frequency": Layout(),
}
# The corpus by post instead of by date: what belongs to a question is in the bucket of its number, so
# joins and groupings by question move nothing.
COLOCATED = LAYOUTS | {
    "questions": Layout(bucket="id"),
    "answers": Layout(bucket="parent_id"),
    "comments": Layout(bucket="post_id"),
}
BUCKET_BYTES = 256 << 20
LEAST_BUCKETS = 8
HOT_SHARE = 2.0
CORPUS = ("questions", "answers", "users", "comments", "tags")


def coarser(grain: str) -> dict[str, Layout]:
    """The layouts with another grain for the corpus, for volumes too small for day folders."""
    return {n: replace(layout, grain=grain) if layout.grain else layout for n, layout in LAYOUTS.items()}


def _bucket_count(store: Store, raw: ForumTables) -> int:
    """The same number for all tables of a store, a power of two, from the bytes of the raw ones."""
    wanted = store.volume(raw.questions, raw.answers, raw.comments) // BUCKET_BYTES
    return max(LEAST_BUCKETS, 1 << max(0, wanted - 1).bit_length())


def _even_enough(df: DataFrame, key: str, buckets: int) -> bool:
    """Whether no key holds more than HOT_SHARE buckets' worth of rows.

    One task reads a whole bucket, so a table with a hotter key is stored without buckets: its joins
    shuffle, and adaptive execution splits the key.
    """
    held = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return held[0] is None or held[0] * buckets <= HOT_SHARE * held[1]


def _write(df: DataFrame, layout: Layout, buckets: int | None, path: str) -> None:
    if buckets:
        sinks.write_bucketed(df, path, layout.bucket, buckets)
    elif layout.grain:
        sinks.write_by_date(df, path, sinks.PARTITIONS[layout.grain], layout.grain, layout.cluster)
    else:
        df.write.parquet(path)


@dataclass(frozen=True)
class Step:
    """Outcome of one step of a run; `written` is false where the table of an earlier run was kept."""

    name: str
    version: str
    written: bool
    seconds: float


def _selection(scope: Scope) -> dict[str, str]:
    """The part of a scope that decides on rows; the rest are parameters of queries."""
    return {"start": scope.start, "end": scope.end, "topic": scope.topic}


def _leads(forum: Forum, name: str) -> dict[str, int]:
    """Microseconds by which an answer, or comment, at most precedes its question; negative if all follow it."""
    asked = forum.slim_questions.select("id", F.col("creation_date").alias("asked"))
    posts = asked
    if name == "comments":
        answered = forum.answers.select(F.col("id").alias("answer_id"), "parent_id")
        posts = asked.union(answered.join(asked, F.col("parent_id") == F.col("id")).select("answer_id", "asked"))
    post = "parent_id" if name == "answers" else "post_id"
    made = getattr(forum, name).select(post, "creation_date").join(posts, F.col(post) == F.col("id"))
    ahead = F.max(F.unix_micros(F.col("asked").cast("timestamp")) - F.unix_micros(F.col("creation_date").cast("timestamp")))
    lead = made.agg(ahead).first()[0]
    return {} if lead is None else {"lead_micros": lead}


def publish(
    raw: ForumTables,
    scope: Scope,
    spark: SparkSession,
    root: str,
    layouts: dict[str, Layout] = LAYOUTS,
    input_version: str | None = None,
    after_step: Callable[[Step], None] = lambda step: None,
) -> list[Step]:
    """Write the layers in order, each computed from the tables before it, then show them to readers all at once.

    Every step has a fingerprint of its plan, layout and inputs. A table of an earlier run, finished or failed, is kept if its
    fingerprint is the same, so a run after a failure goes on where that one ended, and a run over
    unchanged data writes nothing. Raw files count by path, size and time unless `input_version` names their state, which
    sources without files need in order to be recognised. Readers see the earlier publication until the last step is done.
    """
    store = Store(spark, root)
    done = store.progress()
    tables: dict[str, Entry] = {}
    steps = []
    bucketed = any(layout.bucket for layout in layouts.values())
    n_buckets = _bucket_count(store, raw) if bucketed else None
    for name, layout in layouts.items():
        start = time.perf_counter()
        forum = Forum(raw, scope, {n: partial(_plain, store, n, entry) for n, entry in tables.items()})
        df = getattr(forum, name)
        made = [_selection(scope), asdict(layout), layout.bucket and n_buckets]
        fingerprint = store.fingerprint(df, made, input_version)
        entry = done.get(name)
        written = entry is None or fingerprint is None or entry.fingerprint != fingerprint or not store.is_whole(name, entry)
        if written:
            fits = layout.bucket and _even_enough(df, layout.bucket, n_buckets)
            buckets = n_buckets if fits else None
            stored_as = asdict(layout) | {"buckets": buckets}
            entry = store.write(name, partial(_write, df, layout, buckets), fingerprint, stored_as)
            if name in ("answers", "comments") and "questions" in tables:
                stored = Forum(None, scope, forum.stored | {name: partial(_plain, store, name, entry)})
                entry = replace(entry, notes=_leads(stored, name))
            store.note_progress({**done, **tables, name: entry})
        tables[name] = entry
        step = Step(name, entry.version, written, time.perf_counter() - start)
        steps.append(step)
        after_step(step)
    store.publish(_selection(scope), tables)
    return steps


def _plain(store: Store, name: str, entry: Entry) -> DataFrame:
    """A stored layer without the helper column of its layout, but for the mart whose queries prune by it."""
    df = store.read(name, entry)
    return df if name == "dim_questions" else sinks.without_partitions(df)


def covers(stored: dict[str, str], scope: Scope) -> bool:
    """Whether a stored selection holds every row of a scope.

    A tag string that contains the narrower topic contains each part of it.
    """
    begins = datetime.fromisoformat(stored["start"]) <= datetime.fromisoformat(scope.start)
    ends = datetime.fromisoformat(scope.end) <= datetime.fromisoformat(stored["end"])
    return begins and ends and stored["topic"] in scope.topic


def open_published(spark: SparkSession, root: str, scope: Scope) -> Forum:
    """A forum over the published tables under ``root``.

    With the stored window and topic, layers are the tables themselves. A narrower scope selects from the stored
    corpus, from the folders its window needs; question marts are cut to the selection, and sums are computed anew. A scope that
    the tables don't cover is refused.
    """
    store = Store(spark, root)
    published = store.published()
    if published is None:
        raise ValueError(f"nothing is published under {root}")
    selection_, tables = published
    if selection_ == _selection(scope):
        return Forum(None, scope, {name: partial(_plain, store, name, entry) for name, entry in tables.items()})
    if not covers(selection_, scope):
        raise ValueError(f"the tables hold {selection_}, which doesn't cover {_selection(scope)}")
    missing = [name for name in CORPUS if name not in tables]
    if missing:
        raise ValueError(f"a narrower scope needs the whole corpus; not published: {missing}")
    leads = {
        name: timedelta(microseconds=tables[name].notes["lead_micros"])
        for name in ("answers", "comments")
        if "lead_micros" in tables[name].notes
    }
    corpus = ForumTables(**{name: store.read(name, tables[name]) for name in CORPUS}, leads=leads)
    forum = Forum(corpus, scope)

    def dim_questions() -> DataFrame:
        mart = store.read("dim_questions", tables["dim_questions"])
        tagged = F.array_join("tags", "|").contains(scope.topic)
        return mart.where(sinks.in_window(mart, scope.start, scope.end) & tagged)

    def complexity() -> DataFrame:
        asked = forum.slim_questions.select(F.col("id").alias("asked_id"))
        mart = store.read("complexity", tables["complexity"])
        return mart.join(asked, F.col("question_id") == F.col("asked_id"), "left_semi")

    cut = {"dim_questions": dim_questions, "complexity": complexity}
    forum.stored = {name: read for name, read in cut.items() if name in tables}
    return forum


def register(forum: Forum) -> None:
    """Staging layers as session views, under their own names."""
    for name, df in forum.models.items():
        if name.startswith("stg_"):
            df.createOrReplaceTempView(name)


def corpus_row_counts(forum: Forum) -> DataFrame:
    """Rows of each selected table, in selection order."""
    counts = [
        layer.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(step).alias("step"), F.lit(name).alias("table_name"), "n_rows"
        )
        for step, (name, layer) in enumerate(
            [("questions", forum.slim_questions)] + [(n, getattr(forum, n)) for n in CORPUS[1:]], start=1
        )
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("step")
