"""A forum derived from the test tables (see FIXTURES.md).

Every row of orders, lineitem, customer, events and nation becomes one question,
answer, user, comment or tag. Departures from FIXTURES.md:

* a body holds the whole document, not its first 400 characters;
* an answer's id is a digest of its line instead of a rank within the order, so
  no window has to hold all lines of one order;
* answers that leave their question unanswered move to an out-of-scope question
  and closed accounts get a negative id, so that no row is dropped.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNIPPETS = (
    "no sql here",
    "SELECT id FROM t WHERE id = 1 ORDER BY id",
    "INSERT INTO t VALUES (1) -- Duplicate entry 1",
    "UPDATE t SET a = 1 -- Deadlock found",
    "DELETE FROM t WHERE a IS NULL -- error: violates foreign key",
    "CREATE TABLE t (id int) -- ORA-00942: table does not exist",
    "ALTER TABLE t ADD c int -- permission denied",
    "DROP TABLE t -- syntax  error near t",
    "SELECT a, COUNT(*) FROM t GROUP BY a HAVING COUNT(*) > 1",
    "SELECT * FROM a JOIN b USING (id) -- ambiguous column",
    "SELECT CASE WHEN a THEN 1 ELSE 0 END FROM t",
    "SELECT 1 UNION SELECT 2",
    "WITH x AS (SELECT 1) SELECT * FROM x",
    "SELECT ROW_NUMBER() OVER (PARTITION BY a ORDER BY b) FROM t",
    "WITH RECURSIVE n AS (SELECT 1) SELECT * FROM n",
    "SELECT * FROM t, LATERAL UNNEST(arr)",
    "SELECT * FROM t CROSS APPLY f(t.id)",
    "SELECT * FROM t PIVOT (SUM(x) FOR y IN (1))",
    "MERGE INTO t USING s ON t.id = s.id -- timeout expired",
    "SELECT JSON_VALUE(a), COALESCE(a, b) FROM t",
    "SELECT * FROM GENERATE_SERIES(1, 10)",
    "SELECT RANK() OVER (ORDER BY a) -- conversion failed",
    "SELECT (SELECT a FROM t) -- Subquery returns more than 1 row",
    "SELECT 1/0 -- division by zero",
    "SELECT a FROM t -- a is not in GROUP BY",
    "with nested, recursive calls",
    "café\u000bjoin",
)

TAG_LIST = (
    "mysql",
    "mysql-5.7",
    "mariadb",
    "postgresql",
    "psql",
    "sql-server",
    "tsql",
    "sql-server-2019",
    "oracle",
    "plsql",
    "sqlite",
    "snowflake-cloud-data-platform",
    "google-bigquery",
    "amazon-redshift",
    "databricks",
    "hive",
    "db2",
    "ms-access",
)

# Columns read from each test table.
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double",
    "part": "p_partkey long, p_name string",
    "documents": "doc_id long, text string",
    "customer": "c_custkey long, c_name string, c_acctbal double, c_mktsegment string",
    "events": "event_id long, ts timestamp_ntz, user_id long, value double, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}

ANSWER_ID_BASE = 4_000_000_000_000_000_000


def _pick(values: tuple[str, ...], index: str) -> str:
    quoted = ", ".join(f"'{value}'" for value in values)
    return f"get(array({quoted}), cast({index} AS int))"


TAG_SLOT = "floor(sqrt(o_custkey % 324))"


def _with_total(df: DataFrame, other: DataFrame) -> DataFrame:
    """Add the row count of another table as column ``total``."""
    return df.withColumn("total", other.agg(F.count(F.lit(1))).scalar())


def _answers(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """What a line alone decides is computed ahead of the join, which then shuffles results instead of their sources."""
    cents = "floor(l_extendedprice * 100 + 0.5)"
    line = f"concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, {cents})"
    lines = lineitem.selectExpr(
        "l_orderkey",
        f"{ANSWER_ID_BASE} + cast(conv(substring(md5({line}), 1, 15), 16, 10) AS bigint) AS id",
        "CASE WHEN l_orderkey % 89 <> 0 THEN l_suppkey END AS owner_user_id",
        "cast(l_linenumber * l_linenumber * floor(l_quantity) * 7 AS int) AS minutes",
        "floor(l_quantity) % 21 - 5 AS score",
        "cast(l_linenumber AS bigint) AS comment_count",
        f"""concat('<pre><code>', {_pick(SNIPPETS, "(l_orderkey * 5 + l_linenumber * 3) % 27")},
            '</code></pre>') AS body""",
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("created", F.expr("o_orderdate + make_dt_interval(0, 0, minutes)"))
        .selectExpr(
            "id",
            f"""CASE WHEN (l_orderkey * 7 + {TAG_SLOT}) % 9 > 1 THEN l_orderkey
                ELSE l_orderkey - l_orderkey % 10 + 9 END AS parent_id""",
            "owner_user_id",
            "created AS creation_date",
            "created AS last_activity_date",
            "CASE WHEN l_orderkey % 3 = 0 THEN created END AS last_edit_date",
            "score",
            "comment_count",
            "body",
        )
    )


def _answer_stats(answers: DataFrame) -> DataFrame:
    return answers.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.min("id").alias("lead_answer_id"),
    )


def _questions(orders: DataFrame, stats: DataFrame, part: DataFrame) -> DataFrame:
    titled = _with_total(orders, part).join(part, F.expr("o_orderkey % total = p_partkey"), "left")
    return titled.join(stats, F.col("o_orderkey") == F.col("parent_id"), "left").selectExpr(
        "o_orderkey AS id",
        "p_name AS title",
        "CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS owner_user_id",
        "o_orderdate AS creation_date",
        "o_orderdate AS last_activity_date",
        "floor(o_totalprice) % 41 - 10 AS score",
        "floor(o_totalprice) AS view_count",
        "coalesce(n_answers, 0L) AS answer_count",
        "o_orderkey % 5 AS comment_count",
        "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 9 END AS favorite_count",
        "CASE WHEN o_orderstatus = 'F' THEN lead_answer_id END AS accepted_answer_id",
        f"""CASE WHEN o_orderkey % 10 = 9 THEN 'python|pandas' ELSE concat_ws('|',
            CASE WHEN o_orderkey % 2 = 0 THEN 'sql' END,
            {_pick(TAG_LIST, TAG_SLOT)},
            CASE o_orderstatus WHEN 'F' THEN 'join' WHEN 'P' THEN 'group-by' END,
            CASE WHEN o_orderkey % 13 = 0 THEN 'nosql' END,
            CASE WHEN o_orderkey % 7 = 0 THEN '' END) END AS tags""",
    )


def _with_body(questions: DataFrame, documents: DataFrame) -> DataFrame:
    return (
        _with_total(questions, documents)
        .join(documents, F.expr("id % total = doc_id"), "left")
        .selectExpr(
            *questions.columns,
            f"""CASE WHEN id % 101 <> 0 THEN concat('<p>', text, '</p><pre><code>',
                {_pick(SNIPPETS, "id % 27")}, '</code></pre>') END AS body""",
        )
    )


def _users(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "CASE WHEN c_custkey % 50 = 7 THEN -1 - c_custkey ELSE c_custkey END AS id",
        "c_name AS display_name",
        "abs(floor(c_acctbal * 5)) AS reputation",
        "CASE c_custkey % 10 WHEN 0 THEN '31' WHEN 1 THEN 'n/a' END AS age",
        "c_mktsegment AS location",
        "c_custkey % 7 AS up_votes",
        "c_custkey % 3 AS down_votes",
        "c_custkey % 11 AS views",
        "timestamp_ntz '2010-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 2000 AS int)) AS creation_date",
        "timestamp_ntz '2010-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 3000 + 2000 AS int)) AS last_access_date",
        "CASE WHEN c_custkey % 4 = 0 THEN concat('https://example.org/', c_custkey) END AS website_url",
    )


def _comments(events: DataFrame, orders: DataFrame, stats: DataFrame) -> DataFrame:
    keyed = _with_total(events, orders).withColumn("question_key", F.expr("(event_id * 7) % total"))
    return keyed.join(stats, F.col("question_key") == F.col("parent_id"), "left").selectExpr(
        "event_id AS id",
        "CASE WHEN event_id % 2 = 0 THEN question_key ELSE lead_answer_id END AS post_id",
        "user_id",
        "floor(value) % 5 AS score",
        "ts AS creation_date",
        "props AS text",
    )


def _tags(nation: DataFrame) -> DataFrame:
    return nation.selectExpr(
        "cast(n_nationkey AS bigint) AS id",
        "n_name AS tag_name",
        "cast(n_regionkey * 1000 AS bigint) AS count",
    )


class DerivedForum:
    """The raw forum tables over one folder of test tables, each built on first use."""

    leads: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def answers(self) -> DataFrame:
        return _answers(self._table("lineitem"), self._table("orders"))

    @cached_property
    def _stats(self) -> DataFrame:
        return _answer_stats(self.answers)

    @cached_property
    def slim_questions(self) -> DataFrame:
        return _questions(self._table("orders"), self._stats, self._table("part"))

    @cached_property
    def questions(self) -> DataFrame:
        return _with_body(self.slim_questions, self._table("documents"))

    @cached_property
    def users(self) -> DataFrame:
        return _users(self._table("customer"))

    @cached_property
    def comments(self) -> DataFrame:
        return _comments(self._table("events"), self._table("orders"), self._stats)

    @cached_property
    def tags(self) -> DataFrame:
        return _tags(self._table("nation"))
