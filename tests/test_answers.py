"""What the join of lines with orders shuffles."""

import re

from pyspark.sql import functions as F

from conftest import SF_DIR
from quorica.sources.testtables import DerivedForum


def test_join_of_lines_shuffles_digests_not_their_sources(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        firsts = DerivedForum(spark, SF_DIR).answers.groupBy("parent_id").agg(F.min("id"))
        plan = firsts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffled = [re.search(r"Project \[(.*)\]", below)[1] for below in re.split(r"Exchange hashpartitioning\(l_orderkey", plan)[1:]]
    assert len(shuffled) == 1 and shuffled[0].startswith("l_orderkey") and shuffled[0].count(" AS ") == 1
    assert firsts.count() > 0
