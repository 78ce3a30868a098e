"""Catalogues used by the text-mining, dialect and dashboard operators.

Patterns are written in the RE2 dialect; ``patterns.java_pattern`` turns them
into Java ones. ``needles`` are ours: every match of the pattern contains at
least one of them, so a cheap substring test can rule most texts out.
"""

from __future__ import annotations

from typing import NamedTuple


class Signature(NamedTuple):
    label: str
    pattern: str
    needles: tuple[str, ...]


class Feature(NamedTuple):
    flag: str
    pattern: str
    weight: int
    level: str
    needles: tuple[str, ...]
    min_hits: int = 1


# Error signatures.
ERROR_SIGNATURES = (
    Signature("Syntax error", r"(?i)syntax\s+error", ("syntax",)),
    Signature("Oracle ORA- error code", r"(?i)\bora-\d{4,5}\b", ("ora-",)),
    Signature(
        "NULL / unexpected null",
        r"(?i)(null value|unexpected null|\bnull\b.*error|null.*not allowed)",
        ("null",),
    ),
    Signature("Deadlock", r"(?i)deadlock", ("deadlock",)),
    Signature(
        "GROUP BY / aggregate error",
        r"(?i)(not in group by|not contained in.*group|invalid use of group function|aggregate)",
        ("group", "aggregate"),
    ),
    Signature(
        "Permission / access denied",
        r"(?i)(access denied|permission denied|insufficient privilege)",
        ("denied", "insufficient privilege"),
    ),
    Signature("Timeout / lock wait", r"(?i)(timeout|timed.?out|lock wait)", ("timeout", "timed", "lock wait")),
    Signature(
        "Duplicate / unique violation",
        r"(?i)(duplicate (entry|key|value)|unique constraint|violates unique)",
        ("duplicate ", "unique"),
    ),
    Signature(
        "Foreign-key constraint",
        r"(?i)(foreign key|constraint violation|violates foreign)",
        ("foreign", "constraint violation"),
    ),
    Signature(
        "Type conversion error",
        r"(?i)(conversion failed|cannot convert|invalid conversion|invalid cast)",
        ("conver", "invalid cast"),
    ),
    Signature("Ambiguous column/field", r"(?i)ambiguous (column|field|identifier)", ("ambiguous ",)),
    Signature(
        "Object / column not found",
        r"(?i)(does not exist|table not found|column not found|relation.*does not|object not found|unknown column)",
        ("does not", "not found", "unknown column"),
    ),
    Signature("Subquery multi-row error", r"(?i)subquery returns more than (1|one) row", ("subquery returns",)),
    Signature("Divide by zero", r"(?i)(divide by zero|division by zero)", ("by zero",)),
)

# SQL keywords.
KEYWORDS = (
    Signature("Recursive CTE", r"(?i)\bwith\s+\w[\w\s,]*\brecursive\b", ("recursive",)),
    Signature("CTE (WITH ... AS)", r"(?i)\bwith\s+\w+\s+as\s*\(", ("with",)),
    Signature("Window function (OVER)", r"(?i)\bover\s*\(", ("over",)),
    Signature("PARTITION BY", r"(?i)\bpartition\s+by\b", ("partition",)),
    Signature("ROW_NUMBER()", r"(?i)\brow_number\s*\(", ("row_number",)),
    Signature("RANK / DENSE_RANK", r"(?i)\b(rank|dense_rank)\s*\(", ("rank",)),
    Signature("LATERAL", r"(?i)\blateral\b", ("lateral",)),
    Signature("MERGE", r"(?i)\bmerge\s+(into\s+)?\w", ("merge",)),
    Signature("PIVOT", r"(?i)\bpivot\s*\(", ("pivot",)),
    Signature("UNNEST()", r"(?i)\bunnest\s*\(", ("unnest",)),
    Signature("COALESCE()", r"(?i)\bcoalesce\s*\(", ("coalesce",)),
    Signature("CASE WHEN", r"(?i)\bcase\s+when\b", ("case",)),
    Signature("CROSS/OUTER APPLY", r"(?i)\b(cross|outer)\s+apply\b", ("apply",)),
    Signature("JSON functions", r"(?i)\bjson_", ("json_",)),
    Signature(
        "Series generation",
        r"(?i)\bgenerate_series\b|\bgenerate_array\b",
        ("generate_series", "generate_array"),
    ),
)

# Dialect families and their tags.
DIALECT_TAGS = {
    "MySQL / MariaDB": ("mysql", "mysql-5.6", "mysql-5.7", "mysql-8.0", "mariadb"),
    "PostgreSQL": ("postgresql", "psql"),
    "SQL Server": (
        "sql-server",
        "t-sql",
        "tsql",
        "sql-server-2008",
        "sql-server-2012",
        "sql-server-2014",
        "sql-server-2016",
        "sql-server-2017",
        "sql-server-2019",
        "azure-sql-database",
    ),
    "Oracle": ("oracle", "oracle-database", "oracle-11g", "oracle-12c", "oracle-xe", "plsql", "pl-sql"),
    "SQLite": ("sqlite",),
    "Snowflake": ("snowflake", "snowflake-cloud-data-platform"),
    "Google BigQuery": ("google-bigquery", "bigquery"),
    "Amazon Redshift": ("amazon-redshift", "redshift"),
    "Databricks": ("databricks",),
    "Apache Hive": ("hive", "apache-hive"),
    "IBM DB2": ("db2", "ibm-db2"),
    "Microsoft Access": ("access", "ms-access"),
}

# Features scored per question, with weight and level.
FEATURES = (
    Feature("f_select", r"(?i)\bselect\b", 1, "Basic", ("select",)),
    Feature("f_where", r"(?i)\bwhere\b", 1, "Basic", ("where",)),
    Feature("f_order_by", r"(?i)\border\s+by\b", 1, "Basic", ("order",)),
    Feature("f_insert", r"(?i)\binsert\s+into\b", 2, "DML / DDL", ("insert",)),
    Feature("f_update", r"(?i)\bupdate\s+\w", 2, "DML / DDL", ("update",)),
    Feature("f_delete", r"(?i)\bdelete\s+from\b", 2, "DML / DDL", ("delete",)),
    Feature(
        "f_create",
        r"(?i)\bcreate\s+(table|view|index|database|procedure|function)\b",
        2,
        "DML / DDL",
        ("create",),
    ),
    Feature("f_alter", r"(?i)\balter\s+table\b", 2, "DML / DDL", ("alter",)),
    Feature("f_drop", r"(?i)\bdrop\s+(table|view|index|database)\b", 2, "DML / DDL", ("drop",)),
    Feature("f_group_by", r"(?i)\bgroup\s+by\b", 2, "Intermediate", ("group",)),
    Feature("f_join", r"(?i)\bjoin\b", 2, "Intermediate", ("join",)),
    Feature("f_aggregate", r"(?i)\b(count|sum|avg|min|max)\s*\(", 2, "Intermediate", ("count", "sum", "avg", "min", "max")),
    Feature("f_having", r"(?i)\bhaving\b", 2, "Intermediate", ("having",)),
    Feature("f_case_when", r"(?i)\bcase\s+when\b", 3, "Advanced", ("case",)),
    Feature("f_set_ops", r"(?i)\b(union|intersect|except)\b", 3, "Advanced", ("union", "intersect", "except")),
    Feature("f_subqueries", r"(?i)\bselect\b", 3, "Advanced", ("select",), 2),
    Feature("f_cte", r"(?i)\bwith\s+\w+\s+as\s*\(", 5, "Expert", ("with",)),
    Feature("f_window", r"(?i)\bover\s*\(", 5, "Expert", ("over",)),
    Feature("f_recursive", r"(?i)\brecursive\b", 7, "Master", ("recursive",)),
    Feature("f_lateral", r"(?i)\blateral\b", 7, "Master", ("lateral",)),
    Feature("f_apply", r"(?i)\b(cross|outer)\s+apply\b", 7, "Master", ("apply",)),
    Feature("f_pivot", r"(?i)\bpivot\s*\(", 7, "Master", ("pivot",)),
)

# Upper bound of the score for each tier, then the open tier.
COMPLEXITY_TIERS = (
    (0, "0 · No SQL detected"),
    (3, "1 · Trivial"),
    (8, "2 · Basic"),
    (14, "3 · Intermediate"),
    (22, "4 · Advanced"),
)
TOP_COMPLEXITY_TIER = "5 · Expert"

# Chart label of each feature flag.
FEATURE_LABELS = {
    "f_select": "SELECT",
    "f_where": "WHERE",
    "f_order_by": "ORDER BY",
    "f_insert": "INSERT INTO",
    "f_update": "UPDATE",
    "f_delete": "DELETE FROM",
    "f_create": "CREATE TABLE/VIEW",
    "f_alter": "ALTER TABLE",
    "f_drop": "DROP",
    "f_join": "JOIN",
    "f_group_by": "GROUP BY",
    "f_aggregate": "Aggregate fn",
    "f_having": "HAVING",
    "f_case_when": "CASE WHEN",
    "f_set_ops": "Set ops (UNION…)",
    "f_subqueries": "Subquery",
    "f_cte": "CTE (WITH…AS)",
    "f_window": "Window fn (OVER)",
    "f_recursive": "Recursive CTE",
    "f_lateral": "LATERAL",
    "f_apply": "CROSS/OUTER APPLY",
    "f_pivot": "PIVOT",
}

# Label of each feature in the practice list.
PRACTICE_LABELS = {
    "f_join": "JOIN",
    "f_group_by": "GROUP BY",
    "f_aggregate": "Aggregate functions",
    "f_having": "HAVING",
    "f_case_when": "CASE WHEN",
    "f_set_ops": "UNION / INTERSECT / EXCEPT",
    "f_subqueries": "Subqueries",
    "f_cte": "CTE (WITH … AS)",
    "f_window": "Window functions (OVER)",
    "f_recursive": "Recursive CTE",
    "f_lateral": "LATERAL",
    "f_apply": "CROSS / OUTER APPLY",
    "f_pivot": "PIVOT",
}

# Upper bound in hours (exclusive) for each answer-time tier.
ANSWER_TIME_TIERS = (
    (1, "1. < 1 hour"),
    (6, "2. 1–6 hours"),
    (24, "3. 6–24 hours"),
    (72, "4. 1–3 days"),
    (168, "5. 3–7 days"),
)
LAST_ANSWER_TIME_TIER = "6. > 7 days"

# Tier bounds of the semantic layer.
ANSWER_HOURS_BOUNDS = (1, 6, 24, 72, 168)
REPUTATION_BOUNDS = (100, 1000, 5000, 25000)
PCT_ANSWERED_BOUNDS = (50, 70, 85, 95)

# Fixed value: site that question and tag links point to.
LINK_ROOT = "https://stackoverflow.com/questions/"
