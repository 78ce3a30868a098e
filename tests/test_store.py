"""Published forums: atomic switch, resumed runs, scopes cut from stored tables, pruned folders."""

import io
from contextlib import redirect_stdout
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from conftest import SF_DIR
from quorica.operators import marts, selection
from quorica.plans.forum import COLOCATED, LAYOUTS, Forum, Scope, coarser, covers, open_published, publish
from quorica.sources import sinks
from quorica.sources.store import Store
from quorica.sources.tables import ForumTables, read_forum

SCOPE = Scope(start="2021-01-01", end="2021-07-01", years=(2021,))
SMALL = {name: coarser("month")[name] for name in ("questions", "answers", "users", "dim_questions")}


def write_raw(raw_rows, root, n, mode="overwrite"):
    """n questions a day and a half apart, an early and a late answer to each, comments on all of them."""
    start = datetime(2021, 1, 1)
    asked = [start + timedelta(hours=36 * i) for i in range(n)]
    base = {"score": 1, "view_count": 2, "comment_count": 0, "answer_count": 2}
    rows = {
        "questions": [base | {"id": i, "owner_user_id": i % 5, "tags": "sql|mysql" if i % 2 else "sql", "creation_date": t,
                              "title": "t", "body": "select 1"} for i, t in enumerate(asked)],
        "answers": [{"id": 1000 + 2 * i + late, "parent_id": i, "owner_user_id": 7, "body": "x",
                     "creation_date": t + timedelta(days=40 if late else -2)} for i, t in enumerate(asked) for late in (0, 1)],
        "users": [{"id": i, "display_name": f"u{i}", "reputation": i} for i in range(9)],
        "comments": [{"id": i, "post_id": i if i % 2 else 1000 + 2 * i, "creation_date": t + timedelta(days=1)}
                     for i, t in enumerate(asked)],
        "tags": [{"id": 1, "tag_name": "sql", "count": 1}],
    }
    for name, some in rows.items():
        raw_rows(name, *some).coalesce(1).write.mode(mode).parquet(f"{root}/{name}")


def written(steps):
    return [step.name for step in steps if step.written]


def broken(df):
    return df.where(F.raise_error(F.lit("out of luck")).isNull())


def test_failed_run_leaves_readers_alone_and_the_next_one_resumes(spark, raw_rows, tmp_path, monkeypatch):
    raw_dir, root = str(tmp_path / "raw"), str(tmp_path / "forum")
    write_raw(raw_rows, raw_dir, 20)
    assert written(publish(read_forum(spark, raw_dir), SCOPE, spark, root, SMALL)) == list(SMALL)
    before = open_published(spark, root, SCOPE)
    opened = before.questions
    assert written(publish(read_forum(spark, raw_dir), SCOPE, spark, root, SMALL)) == []

    write_raw(raw_rows, raw_dir, 30)
    select = selection.select_users
    monkeypatch.setattr(selection, "select_users", lambda *parts: broken(select(*parts)))
    with pytest.raises(Exception, match="out of luck"):
        publish(read_forum(spark, raw_dir), SCOPE, spark, root, SMALL)
    assert opened.count() == 20 and open_published(spark, root, SCOPE).questions.count() == 20
    assert open_published(spark, root, SCOPE).users.count() == 6

    monkeypatch.setattr(selection, "select_users", select)
    assert written(publish(read_forum(spark, raw_dir), SCOPE, spark, root, SMALL)) == ["users", "dim_questions"]
    assert opened.count() == 20 and open_published(spark, root, SCOPE).dim_questions.count() == 30

    store = Store(spark, root)
    assert len(store.drop_unused()) >= 4 and store.drop_unused() == []
    assert open_published(spark, root, SCOPE).dim_questions.count() == 30


def test_changed_scope_layout_or_operator_is_written_anew(spark, raw_rows, tmp_path, monkeypatch):
    raw_dir, root = str(tmp_path / "raw"), str(tmp_path / "forum")
    write_raw(raw_rows, raw_dir, 12)

    def run(scope=SCOPE, layouts=SMALL):
        return written(publish(read_forum(spark, raw_dir), scope, spark, root, layouts))

    run()
    assert run(replace(SCOPE, yearly_floor=1)) == []
    assert run(layouts=SMALL | {"answers": replace(SMALL["answers"], cluster=("id",))}) == ["answers", "users", "dim_questions"]
    run()
    assert run(replace(SCOPE, end="2021-01-05")) == list(SMALL)
    run()
    select = selection.select_users
    monkeypatch.setattr(selection, "select_users", lambda *parts: select(*parts).where("id > 1"))
    assert run() == ["users", "dim_questions"]


def test_input_version_stands_for_sources_without_files(spark, raw_rows, tmp_path):
    root = str(tmp_path / "forum")
    base = {"score": 1, "view_count": 2, "comment_count": 0, "answer_count": 0, "tags": "sql", "creation_date": datetime(2021, 2, 1)}
    raw = ForumTables(raw_rows("questions", base | {"id": 1}), *(raw_rows(n, {"id": 1}) for n in ("answers", "users", "comments", "tags")))
    only = {"questions": SMALL["questions"]}
    assert written(publish(raw, SCOPE, spark, root, only)) == ["questions"]
    assert written(publish(raw, SCOPE, spark, root, only)) == ["questions"]
    assert written(publish(raw, SCOPE, spark, root, only, input_version="monday")) == ["questions"]
    assert written(publish(raw, SCOPE, spark, root, only, input_version="monday")) == []
    assert written(publish(raw, SCOPE, spark, root, only, input_version="tuesday")) == ["questions"]


def test_failed_write_leaves_the_catalogue_table(spark):
    spark.sql("DROP TABLE IF EXISTS replaced")
    sinks.save_table(spark.range(5), "replaced")
    with pytest.raises(Exception, match="out of luck"):
        sinks.save_table(broken(spark.range(9)), "replaced")
    assert spark.table("replaced").count() == 5
    opened = spark.table("replaced")
    sinks.save_table(spark.range(7), "replaced")
    assert spark.table("replaced").count() == 7 and opened.count() in (5, 7)
    sinks.save_table(spark.range(3).selectExpr("id", "'x' AS more"), "replaced")
    assert spark.table("replaced").columns == ["id", "more"]
    spark.sql("DROP TABLE replaced")


@pytest.mark.parametrize("scope, inside", [(("2020-01-01", "2021-01-01", "sql"), True), (("2020-05-01", "2020-06-01", "mysql"), True),
                                           (("2019-12-31", "2021-01-01", "sql"), False), (("2020-01-01", "2021-01-02", "sql"), False),
                                           (("2020-01-01", "2021-01-01", "python"), False), (("2020-01-01", "2021-01-01", "sq"), False)])
def test_which_scopes_are_covered(scope, inside):
    stored = {"start": "2020-01-01", "end": "2021-01-01", "topic": "sql"}
    assert covers(stored, Scope(*scope)) is inside


@pytest.fixture(scope="module")
def daily(spark, tmp_path_factory):
    """The forum of the test tables by days, over half a year."""
    root = str(tmp_path_factory.mktemp("daily"))
    scope = replace(entry_module.TEST_SCOPE, start="1998-01-01", end="1998-07-01")
    publish(entry_module.DerivedForum(spark, SF_DIR), scope, spark, root, LAYOUTS)
    return root, scope


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


NARROW = replace(entry_module.TEST_SCOPE, start="1998-03-01", end="1998-04-15", topic="mysql", yearly_floor=1, pair_floor=1,
                 total_floor=1)


def test_other_scopes_are_refused(spark, daily):
    root, scope = daily
    for wider in (replace(scope, end="1998-08-01"), replace(scope, topic="python")):
        with pytest.raises(ValueError, match="cover"):
            open_published(spark, root, wider)
    with pytest.raises(ValueError, match="nothing is published"):
        open_published(spark, f"{root}/none", scope)


@pytest.mark.parametrize("name", ["questions", "slim_questions", "answers", "users", "comments", "tags", "dim_questions", "complexity",
                                  "fct_tag_yearly", "dialects", "error_patterns", "keyword_frequency"])
def test_narrower_scope_has_the_rows_of_an_unstored_forum(spark, daily, name):
    stored = sinks.without_partitions(getattr(open_published(spark, daily[0], NARROW), name))
    fresh = getattr(Forum(entry_module.DerivedForum(spark, SF_DIR), NARROW), name)
    assert sorted(stored.columns) == sorted(fresh.columns)
    order = sorted(fresh.columns)
    assert sorted(map(str, stored.select(order).collect())) == sorted(map(str, fresh.select(order).collect()))


def test_stored_layers_have_the_columns_of_the_unstored(spark, daily):
    root, scope = daily
    stored, fresh = open_published(spark, root, scope), Forum(entry_module.DerivedForum(spark, SF_DIR), scope)
    for name in ("questions", "answers", "comments"):
        assert getattr(stored, name).schema.simpleString() == getattr(fresh, name).schema.simpleString()


def test_narrower_scope_reads_only_its_day_folders(spark, daily):
    forum = open_published(spark, daily[0], NARROW)
    for df in (entry_module.FORUM_QUERIES["select_questions"](forum), entry_module.FORUM_QUERIES["select_answers"](forum)):
        filters = [line for line in plan_of(df).split("\n") if "PartitionFilters" in line]
        assert filters and all("creation_day" in line for line in filters)
    assert "creation_month" in plan_of(entry_module.FORUM_QUERIES["kpis"](forum))


def test_early_answers_move_the_edge_of_the_folders(spark, raw_rows, tmp_path):
    raw_dir, root = str(tmp_path / "raw"), str(tmp_path / "forum")
    write_raw(raw_rows, raw_dir, 60)
    publish(read_forum(spark, raw_dir), SCOPE, spark, root, LAYOUTS)
    tables = Store(spark, root).published()[1]
    assert tables["answers"].notes == {"lead_micros": 2 * 86_400_000_000}
    assert tables["comments"].notes == {"lead_micros": -86_400_000_000}
    narrow = replace(SCOPE, start="2021-02-01", end="2021-03-01")
    stored, fresh = open_published(spark, root, narrow), Forum(read_forum(spark, raw_dir), narrow)
    for name in ("answers", "comments", "users"):
        assert sorted(r.id for r in getattr(stored, name).collect()) == sorted(r.id for r in getattr(fresh, name).collect())
    edge = [line for line in plan_of(stored.answers).split("\n") if "PartitionFilters" in line and "2021-01-30" in line]
    assert edge


@pytest.fixture
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def test_colocated_corpus_joins_without_exchange(spark, raw_rows, tmp_path, no_broadcast):
    raw_dir, root = str(tmp_path / "raw"), str(tmp_path / "forum")
    write_raw(raw_rows, raw_dir, 200)
    scope = replace(SCOPE, end="2021-12-31")
    before = {t.name for t in spark.catalog.listTables()}
    publish(read_forum(spark, raw_dir), scope, spark, root, COLOCATED)
    assert {n: e.layout["buckets"] for n, e in Store(spark, root).published()[1].items() if e.layout["buckets"]} == {
        "questions": 8, "answers": 8, "comments": 8,
    }
    same, narrow = open_published(spark, root, scope), open_published(spark, root, replace(scope, end="2021-06-01"))
    assert {t.name for t in spark.catalog.listTables()} == before
    fresh = Forum(read_forum(spark, raw_dir), narrow.scope)
    # Selection of answers (S2), first answers (M1), and their join with the questions of the mart (M2).
    first = marts.first_answer(same.stg_answers)
    joined = same.stg_questions.join(first, "question_id", "left")
    for df in (narrow.answers, first, joined):
        assert "Exchange" not in plan_of(df)
    # Comments (S4) stay where they are; only ids of posts move.
    moved = plan_of(narrow.comments)
    assert "hashpartitioning(post_id" not in moved and "hashpartitioning(target_id" in moved
    for name in ("answers", "comments", "dim_questions"):
        stored = sinks.without_partitions(getattr(narrow, name))
        assert sorted(map(str, stored.collect())) == sorted(map(str, getattr(fresh, name).collect()))
    assert publish(read_forum(spark, raw_dir), scope, spark, root, COLOCATED)[0].written is False


def test_a_hot_post_keeps_its_table_out_of_buckets(spark, raw_rows, tmp_path):
    raw_dir, root = str(tmp_path / "raw"), str(tmp_path / "forum")
    write_raw(raw_rows, raw_dir, 60)
    hot = [{"id": 5000 + i, "parent_id": 3, "creation_date": datetime(2021, 2, 1)} for i in range(80)]
    raw_rows("answers", *hot).write.mode("append").parquet(f"{raw_dir}/answers")
    publish(read_forum(spark, raw_dir), SCOPE, spark, root, {n: COLOCATED[n] for n in ("questions", "answers")})
    tables = Store(spark, root).published()[1]
    assert tables["questions"].layout["buckets"] == 8 and tables["answers"].layout["buckets"] is None
    assert open_published(spark, root, SCOPE).answers.count() == Forum(read_forum(spark, raw_dir), SCOPE).answers.count()
