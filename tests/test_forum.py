"""Selection, staging, marts, text mining and panels on hand-written raw rows."""

import pytest

from conftest import at, rows_of
from quorica.operators import marts, panels, selection, semantic, staging, textmining
from quorica.plans.forum import Forum, Scope, register
from quorica.sources.tables import ForumTables


def question(id, tags="sql", created="2021-03-01T10:00:00", **rest):
    base = {"score": 1, "view_count": 10, "answer_count": 0, "comment_count": 0}
    return base | {"id": id, "tags": tags, "creation_date": at(created)} | rest


@pytest.fixture(scope="module")
def forum(spark, raw_rows):
    questions = raw_rows(
        "questions",
        question(1, "sql|mysql|mariadb|mysql", owner_user_id=7, answer_count=2, accepted_answer_id=102,
                 title="T", body="SELECT (SELECT 1) syntax  error"),
        question(2, "|plsql|", owner_user_id=8, answer_count=1, title=None, body=None),
        question(3, "nosql", title="deadlock", body="with recursive n as (select 1)"),
        question(4, "python|pandas", owner_user_id=9),
        question(5, "sql", created="2023-01-01T00:00:00"),
        question(6, "sql", created="2020-01-01T00:00:00", owner_user_id=7, answer_count=1),
        question(7, "SQL"),
    )
    answers = raw_rows(
        "answers",
        {"id": 101, "parent_id": 1, "owner_user_id": 8, "creation_date": at("2021-03-01T11:01:00"), "body": "merge into t"},
        {"id": 102, "parent_id": 1, "owner_user_id": 11, "creation_date": at("2021-03-01T10:59:00"),
         "body": "x LATERAL y; with q as (select row_number() over (partition by a))"},
        {"id": 103, "parent_id": 2, "creation_date": at("2021-03-01T09:00:00"), "body": None},
        {"id": 104, "parent_id": 4, "owner_user_id": 12, "creation_date": at("2021-03-01T10:00:00")},
        {"id": 105, "parent_id": 6, "owner_user_id": 7, "creation_date": at("2020-01-01T01:01:00")},
    )
    users = raw_rows("users", *[{"id": i, "display_name": f"u{i}", "reputation": i * 100, "age": age}
                                for i, age in ((7, "31"), (9, "40"), (11, "n/a"), (12, None), (13, "50"))])
    comments = raw_rows("comments", *[{"id": i, "post_id": p, "text": "c"} for i, p in enumerate((1, 101, 104, 4, None))])
    tags = raw_rows("tags", {"id": 1, "tag_name": "sql", "count": 5})
    return Forum(ForumTables(questions, answers, users, comments, tags), Scope())


def ids(df, column="id"):
    return sorted(row[column] for row in df.select(column).collect())


def test_window_is_half_open_and_topic_is_a_case_sensitive_substring(forum):
    assert ids(forum.questions) == [1, 2, 3, 6]


def test_strict_variant_drops_only_the_exact_tag(forum):
    assert ids(selection.exclude_tag(forum.questions, "nosql")) == [1, 2, 6]


def test_other_tables_follow_the_selected_questions(forum):
    assert ids(forum.answers) == [101, 102, 103, 105]
    assert ids(forum.users) == [7, 11]
    assert ids(forum.comments) == [0, 1]
    assert ids(forum.tags) == [1]


def test_staging_keeps_empty_tags_and_parses_age(forum):
    staged = {r["question_id"]: r for r in rows_of(forum.stg_questions)}
    assert staged[2]["tags"] == ["", "plsql", ""] and not staged[2]["has_accepted_answer"]
    assert "body" not in staged[2]
    assert {r["user_id"]: r["age"] for r in rows_of(forum.stg_users)} == {7: 31, 11: None}


def test_question_mart_keeps_its_grain_and_counts_whole_hours(forum):
    dim = {r["question_id"]: r for r in rows_of(forum.dim_questions)}
    assert len(rows_of(forum.dim_questions)) == len(dim) == 4
    assert {k: r["hours_to_first_answer"] for k, r in dim.items()} == {1: 0, 2: -1, 3: None, 6: 1}
    assert {k: r["owner_display_name"] for k, r in dim.items()} == {1: "u7", 2: None, 3: None, 6: "u7"}


def test_tier_under_an_hour_takes_negative_hours(forum):
    rows = rows_of(panels.time_to_answer_tiers(forum.dim_questions, (2020, 2021)))
    assert [(r["label"], r["num_questions"]) for r in rows] == [("< 1 hour", 2), ("1–6 hours", 1)]
    everyone = rows_of(semantic.time_to_answer_tier_all(forum.dim_questions))
    assert {r["time_to_answer_tier"]: r["count"] for r in everyone} == {"Below 1": 2, "1 to 5": 1, "Undefined": 1}


def test_repeated_tags_count_twice_in_facts_and_once_per_dialect(forum):
    facts = {(r["tag"], r["creation_year"]): r["num_questions"] for r in rows_of(forum.fct_tag_yearly)}
    assert facts == {("sql", 2020): 1, ("sql", 2021): 1, ("mysql", 2021): 2, ("mariadb", 2021): 1,
                     ("plsql", 2021): 1, ("nosql", 2021): 1}
    dialects = {r["dialect"]: r["num_questions"] for r in rows_of(forum.dialects)}
    assert dialects == {"MySQL / MariaDB": 1, "Oracle": 1}


def test_complexity_score_and_tier(forum):
    scored = {r["question_id"]: (r["complexity_score"], r["complexity_tier"]) for r in rows_of(forum.complexity)}
    assert scored == {1: (4, "2 · Basic"), 2: (0, "0 · No SQL detected"), 3: (8, "2 · Basic"), 6: (0, "0 · No SQL detected")}
    assert len(marts.FLAGS) == 22 and len(marts.SHOWCASE_FLAGS) == 16


@pytest.mark.parametrize("score, tier", [(0, "0 · No SQL detected"), (1, "1 · Trivial"), (3, "1 · Trivial"),
                                         (4, "2 · Basic"), (9, "3 · Intermediate"), (14, "3 · Intermediate"),
                                         (15, "4 · Advanced"), (22, "4 · Advanced"), (23, "5 · Expert"), (70, "5 · Expert")])
def test_tier_bounds(spark, score, tier):
    from pyspark.sql import functions as F

    assert spark.range(1).select(marts.complexity_tier(F.lit(score))).first()[0] == tier


def test_null_title_and_body_match_nothing_and_title_counts(forum):
    found = {r["error_pattern"]: r["num_questions"] for r in rows_of(forum.error_patterns)}
    assert found == {"Syntax error": 1, "Deadlock": 1}


def test_keyword_only_in_answers_is_dropped(forum):
    found = {r["keyword"]: (r["in_questions"], r["in_accepted_answers"]) for r in rows_of(forum.keyword_frequency)}
    assert found == {}
    hits = {r["keyword"] for r in rows_of(textmining.keyword_hits(forum.answers))}
    assert {"LATERAL", "MERGE", "PARTITION BY", "CTE (WITH ... AS)"} <= hits


def test_plain_recursive_cte_is_neither_keyword(raw_rows):
    posts = raw_rows("answers", {"id": 1, "body": "with recursive n as (select 1)"},
                     {"id": 2, "body": "with n, m recursive"}, {"id": 3, "body": "with n as (select 1)"})
    hits = [(r["id"], r["keyword"]) for r in rows_of(textmining.keyword_hits(posts))]
    assert sorted(hits) == [(2, "Recursive CTE"), (3, "CTE (WITH ... AS)")]


def test_practice_pool_repeats_for_a_seed_and_differs_between_seeds(forum):
    pool = [ids(panels.practice_pool(forum.dim_questions, forum.complexity.repartition(n), "2 · Basic", 3, 1), "question_id")
            for n in (1, 5)]
    assert pool[0] == pool[1]
    seen = {tuple(ids(panels.practice_pool(forum.dim_questions, forum.complexity, "2 · Basic", s, 1), "question_id"))
            for s in range(4)}
    assert len(seen) == 2


def test_feature_list_follows_the_practice_labels(forum):
    found = {r["question_id"]: r["features"] for r in rows_of(panels.active_features(forum.complexity))}
    assert found[1] == "Subqueries" and found[3] == "Recursive CTE" and found[2] == ""


def test_feature_presence_can_be_limited_to_years(forum):
    assert panels.feature_presence_wide(forum.complexity).first().select_pct == 50.0
    assert panels.feature_presence_wide(forum.complexity, [2020]).first().select_pct == 0.0


def test_staging_layers_become_views(spark, forum):
    register(forum)
    assert spark.table("stg_answers").count() == 4


def test_staging_reads_declared_schemas(spark, raw_rows, tmp_path):
    from quorica.sources.tables import read_forum

    raw_rows("tags", {"id": 1, "tag_name": "sql", "count": 5}).write.parquet(f"{tmp_path}/tags")
    for name in ("questions", "answers", "users", "comments"):
        raw_rows(name, {"id": 1}).write.parquet(f"{tmp_path}/{name}")
    tables = read_forum(spark, str(tmp_path))
    assert rows_of(staging.stg_tags(tables.tags)) == [{"tag_id": 1, "tag_name": "sql", "sitewide_question_count": 5}]
    assert "body" not in tables.slim_questions.columns
