"""Sinks, partition pruning, hot keys and plan shapes."""

import io
import random
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from conftest import SF_DIR, at, rows_of
from quorica.operators import marts, panels, selection, semantic
from quorica.plans.forum import Forum, Scope, coarser, open_published, publish
from quorica.session import shared_dir
from quorica.sources import sinks
from quorica.sources.tables import ForumTables


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def hot_rows():
    """A third of all answers belong to one question, a third of all posts to one or to no author."""
    rng = random.Random(2)
    start = datetime(2021, 1, 1)
    questions = [
        {"id": i, "owner_user_id": 1 if i % 3 == 0 else (None if i % 3 == 1 else i), "tags": "sql|hot" if i % 2 else "sql",
         "creation_date": start + timedelta(days=0 if i % 3 == 0 else i % 40), "score": i % 9, "view_count": i,
         "answer_count": i % 3, "body": "x"}
        for i in range(600)
    ]
    answers = [
        {"id": 10000 + i, "parent_id": 0 if i % 3 == 0 else rng.randrange(900), "owner_user_id": 1 if i % 3 else i,
         "creation_date": start + timedelta(hours=i % 999)}
        for i in range(3000)
    ]
    comments = [{"id": i, "post_id": 0 if i % 3 == 0 else rng.randrange(14000)} for i in range(3000)]
    users = [{"id": i, "display_name": f"u{i}", "reputation": i} for i in range(700)]
    return {"questions": questions, "answers": answers, "comments": comments, "users": users, "tags": []}


@pytest.fixture(scope="module")
def hot_forum(raw_rows, hot_rows):
    return Forum(ForumTables(**{name: raw_rows(name, *rows) for name, rows in hot_rows.items()}), Scope())


@pytest.fixture
def shuffled_joins(spark):
    """Make every join shuffle, and let adaptive execution split even tiny hot partitions."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_keys_match_brute_force(hot_forum, hot_rows, shuffled_joins):
    asked = {q["id"]: q for q in hot_rows["questions"]}
    kept = [a for a in hot_rows["answers"] if a["parent_id"] in asked]
    assert sorted(r["id"] for r in rows_of(hot_forum.answers)) == sorted(a["id"] for a in kept)
    posts = set(asked) | {a["id"] for a in kept}
    assert hot_forum.comments.count() == sum(c["post_id"] in posts for c in hot_rows["comments"])
    authors = {p["owner_user_id"] for p in [*asked.values(), *kept]}
    named = {u["id"] for u in hot_rows["users"]} & authors
    assert {r["id"] for r in rows_of(hot_forum.users)} == named
    first = {}
    for a in kept:
        first[a["parent_id"]] = min(a["creation_date"], first.get(a["parent_id"], a["creation_date"]))
    dim = rows_of(hot_forum.dim_questions)
    assert {r["question_id"]: (r["first_answer_at"], r["owner_reputation"]) for r in dim} == {
        i: (first.get(i), q["owner_user_id"] if q["owner_user_id"] in named else None) for i, q in asked.items()
    }
    assert len(dim) == len(asked)


def test_adaptive_execution_splits_the_hot_parent(spark, raw_rows, hot_rows, shuffled_joins):
    answers = raw_rows("answers", *hot_rows["answers"]).repartition(16)
    joined = selection.select_answers(answers, raw_rows("questions", *hot_rows["questions"]))
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_writing_twice_gives_the_same_table(spark, hot_forum, tmp_path):
    path = str(tmp_path / "answers")
    for _ in range(2):
        sinks.write_by_date(hot_forum.answers, path, "creation_day", "day", ("owner_user_id", "id"))
    again = spark.read.parquet(path)
    assert again.drop("creation_day").exceptAll(hot_forum.answers).count() == 0
    assert again.count() == hot_forum.answers.count()


def test_hot_day_is_split_over_files_and_each_file_is_clustered(spark, hot_forum, tmp_path):
    path = str(tmp_path / "questions")
    copies = hot_forum.questions.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(60))))
    big = copies.withColumn("body", F.sha2(F.rand(1).cast("string"), 512))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        sinks.write_by_date(big.repartition(16), path, "creation_day", "day", ("owner_user_id", "id"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = spark.read.parquet(path).withColumn("file", F.input_file_name())
    hot = stored.where("creation_day = date '2021-01-01'")
    assert hot.select("file").distinct().count() > 1
    for part in (tmp_path / "questions" / "creation_day=2021-01-01").glob("*.parquet"):
        owners = [r[0] or 0 for r in spark.read.parquet(str(part)).select("owner_user_id").collect()]
        assert owners == sorted(owners)


def test_window_read_prunes_day_folders(spark, hot_forum, tmp_path):
    path = str(tmp_path / "answers")
    sinks.write_by_date(hot_forum.answers, path, "creation_day", "day", ("owner_user_id", "id"))
    window = sinks.read_window(spark, path, "2021-01-05", "2021-01-07 12:00:00")
    low, high = at("2021-01-05"), at("2021-01-07T12:00:00")
    assert window.count() == hot_forum.answers.where((F.col("creation_date") >= low) & (F.col("creation_date") < high)).count()
    assert "PartitionFilters: [isnotnull(creation_day" in plan_of(window)


def test_published_month_mart_prunes_other_years(spark, tmp_path):
    root, scope = str(tmp_path), entry_module.TEST_SCOPE
    raw = entry_module.DerivedForum(spark, SF_DIR)
    wanted = {name: coarser("month")[name] for name in ("questions", "answers", "users", "dim_questions")}
    assert [step.name for step in publish(raw, scope, spark, root, wanted)] == list(wanted)
    forum = open_published(spark, root, scope)
    kpis = panels.kpis(forum.dim_questions, [1998])
    assert "creation_month" in plan_of(kpis).split("PartitionFilters:")[1].split("\n")[0]
    assert kpis.first() == panels.kpis(Forum(raw, scope).dim_questions, [1998]).first()


def test_tables_replace_each_other(spark, hot_forum):
    for _ in range(2):
        sinks.save_table(hot_forum.fct_tag_yearly, "fct_check")
    assert spark.table("fct_check").count() == hot_forum.fct_tag_yearly.count()
    spark.sql("DROP TABLE fct_check")


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_facts_read_no_text_and_push_filters(spark, raw_rows, tmp_path):
    raw_rows("questions", {"id": 1, "tags": "sql", "creation_date": at("2021-01-01"), "answer_count": 0, "score": 1,
                           "view_count": 1}).write.parquet(f"{tmp_path}/q")
    stored = spark.read.parquet(f"{tmp_path}/q")
    scope = Scope()
    picked = selection.select_questions(stored, scope.start, scope.end, scope.topic)
    plan = plan_of(picked.select("id", "tags"))
    assert "StringContains(tags,sql)" in plan and "GreaterThanOrEqual(creation_date" in plan
    assert "body" not in plan


@pytest.fixture(scope="module")
def stored_forum(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("forum"))
    publish(entry_module.DerivedForum(spark, SF_DIR), entry_module.TEST_SCOPE, spark, root, coarser("month"))
    return open_published(spark, root, entry_module.TEST_SCOPE)


@pytest.mark.parametrize("name, scans", [("rising_falling_tags", 1), ("answer_rate_by_tag", 1), ("growth_head_tail", 1),
                                         ("answer_rate_extremes", 1), ("tile_tag_volume_pivot", 1), ("dq_unique", 10)])
def test_each_stored_table_is_scanned_once(stored_forum, name, scans):
    df = entry_module.FORUM_QUERIES[name](stored_forum)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == scans
    assert df.count() > 0


def test_unique_report_shuffles_all_keys_at_once(stored_forum):
    assert plan_of(entry_module.FORUM_QUERIES["dq_unique"](stored_forum)).count("hashpartitioning(test") == 2


def test_sample_of_the_practice_pool_is_taken_before_the_join(stored_forum):
    plan = stored_forum and entry_module.FORUM_QUERIES["practice_pool"](stored_forum)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=50" in plan.split("Join", 1)[1]


@pytest.mark.parametrize("name", ["validation_checks", "dialect_mart", "error_patterns", "keyword_frequency",
                                  "rising_falling_tags", "answer_rate_by_tag", "top_n_tag_trend", "complexity_mart"])
def test_no_nested_loop_or_cartesian_join(spark, name):
    plan = plan_of(entry_module.queries()[name](spark, SF_DIR))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_complexity_flags_are_computed_once_and_joined_with_nothing(spark):
    plan = plan_of(entry_module.queries()["complexity_by_tier"](spark, SF_DIR))
    above = plan.split("Generate")[0]
    assert "RLIKE" not in above and plan.count("inline(") >= 1
    assert "Join" not in above
    assert marts.FLAGS[0] in plan


def test_dialects_of_a_question_need_no_join_and_no_shuffle(spark):
    rows = spark.createDataFrame(
        [(1, 2021, 1, 1, True, True, ["mysql", "mysql", "postgresql"]), (2, 2021, 1, 1, True, True, ["sql", None])],
        "question_id long, creation_year long, score long, view_count long, is_answered boolean, "
        "has_accepted_answer boolean, tags array<string>",
    )
    found = marts.question_dialects(rows)
    plan = plan_of(found)
    assert "Join" not in plan and "Exchange" not in plan
    assert [r.question_id for r in found.collect()] == [1, 1]


def test_monthly_tile_keeps_all_months(spark):
    months = spark.range(600).selectExpr("cast(add_months(date'1960-01-01', cast(id AS int)) AS timestamp_ntz) AS creation_date")
    filler = [F.lit(None).cast(kind).alias(name) for name, kind in (
        ("question_id", "long"), ("title", "string"), ("creation_year", "long"), ("score", "long"),
        ("view_count", "long"), ("answer_count", "long"), ("comment_count", "long"), ("is_answered", "boolean"),
        ("has_accepted_answer", "boolean"), ("hours_to_first_answer", "long"), ("owner_user_id", "long"),
        ("owner_display_name", "string"), ("owner_reputation", "long"))]
    assert semantic.tile_monthly(months.select("*", *filler)).count() == 600
