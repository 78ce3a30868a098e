"""How often the queries on complexity search a body."""

import __spark_entry__ as entry_module
from conftest import SF_DIR
from quorica.operators import marts, textmining


def test_sort_of_the_scores_reads_finished_rows(spark, raw_rows):
    """Between the search of the bodies and the sort's ranges lies a shuffle, which the sort's two runs read."""
    bodies = ({"id": i, "body": "select 1"} for i in range(3))
    scored = textmining.complexity_scoring(marts.complexity_mart(raw_rows("questions", *bodies)))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    between = plan.split("rangepartitioning", 1)[1].split("Generate", 1)[0]
    assert "Exchange hashpartitioning(question_id" in between


def test_practice_pool_searches_each_body_once_for_all_features(spark):
    plan = entry_module.queries()["practice_pool"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_sort_of_the_practice_pool_joins_all_questions_once(spark):
    """Between the join with all questions and the sort's ranges lies a shuffle, which the sort's two runs read."""
    plan = entry_module.queries()["practice_pool"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    between = plan.split("rangepartitioning", 1)[1].split("Join", 1)[0]
    assert "Exchange hashpartitioning(question_id" in between
