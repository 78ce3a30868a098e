"""Every registered query against its SQL twin, over layers written and read back."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from conftest import SF_DIR
from quorica.plans.forum import coarser, open_published, publish
from quorica.sources.testtables import DerivedForum

TABLES = "nation customer part orders lineitem events documents"
STATEMENTS = {n: sql for n, sql in entry_module.oracle_sql().items() if n in entry_module.FORUM_QUERIES}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def forum(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("forum"))
    publish(DerivedForum(spark, SF_DIR), entry_module.TEST_SCOPE, spark, root, coarser("month"))
    return open_published(spark, root, entry_module.TEST_SCOPE)


def compare(df, duck, sql):
    cursor = duck.execute(sql)
    names = [column[0] for column in cursor.description]
    if names[:1] == ["question_id"] and "creation_month" not in names:
        df = df.drop("creation_month")  # the stored question mart prunes by it
    order = sorted(names)
    assert sorted(df.columns) == order
    expected = Counter(tuple(row[names.index(c)] for c in order) for row in cursor.fetchall())
    assert Counter(tuple(row[c] for c in order) for row in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_matches_sql(name, forum, duck):
    compare(entry_module.FORUM_QUERIES[name](forum), duck, STATEMENTS[name])


@pytest.mark.parametrize("name", ["dim_questions", "keyword_frequency", "answer_rate_by_tag", "select_comments"])
def test_matches_sql_without_stored_layers(name, spark, duck):
    compare(entry_module.queries()[name](spark, SF_DIR), duck, STATEMENTS[name])


def test_every_forum_query_has_a_twin():
    assert set(entry_module.FORUM_QUERIES) == set(STATEMENTS)


def test_tag_pivot_has_the_trend_values_sorted_by_its_first_tag(forum):
    wide = entry_module.FORUM_QUERIES["tile_tag_volume_pivot"](forum).collect()
    trend = entry_module.FORUM_QUERIES["top_n_tag_trend"](forum).collect()
    assert len(wide[0]) == 21
    cells = {(r.creation_year, r[f"tag_{i}"]): r[f"total_questions_{i}"] for r in wide for i in range(1, 11)}
    assert {(r.creation_year, r.tag): r.num_questions for r in trend} == {k: n for k, n in cells.items() if n is not None}
    first = [r.total_questions_1 for r in wide]
    assert first == sorted(first, reverse=True) and len({r.tag_1 for r in wide}) == 1


def test_entry_is_the_flagship(spark):
    assert entry_module.entry(spark).columns[:3] == ["rank", "tag", "total_questions"]
