"""One DuckDB statement per registered query, written apart from the Spark operators.

Each statement derives the forum from the test tables by itself. Only the
catalogues (patterns, labels, tags, weights) are shared with the library.
"""

from __future__ import annotations

from quorica.functions import catalogues as cat
from quorica.sources.testtables import SNIPPETS, TAG_LIST


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(map(_text, row)) + ")" for row in rows)


def _round(x: str, n: int) -> str:
    return f"cast(round(cast({x} as decimal(38,12)), {n}) as double)"


def _ratio(a: str, b: str, n: int = 4) -> str:
    return _round(f"cast({a} as double) / nullif({b}, 0)", n)


def _share(flag: str, n: int = 4) -> str:
    return _ratio(f"count(*) filter (where {flag})", "count(*)", n)


def _even(total: str, parts: str) -> str:
    """Integer quotient rounded half to even."""
    rest = f"((({total}) % ({parts})) + ({parts})) % ({parts})"
    down = f"((({total}) - ({rest})) // ({parts}))"
    return f"({down} + case when 2 * ({rest}) > ({parts}) or (2 * ({rest}) = ({parts}) and {down} % 2 <> 0) then 1 else 0 end)"


def _steps(x: str, compare: str, cuts, last: str) -> str:
    whens = " ".join(f"WHEN {x} {compare} {bound} THEN {_text(label)}" for bound, label in cuts)
    return f"CASE {whens} ELSE {_text(last)} END"


def _tier(x: str, bounds) -> str:
    cuts = [(bounds[0], f"Below {bounds[0]}")]
    cuts += [(high, f"{low} to {high - 1}") for low, high in zip(bounds, bounds[1:])]
    return f"CASE WHEN {x} IS NULL THEN 'Undefined' ELSE {_steps(x, '<', cuts, f'{bounds[-1]} or Above')} END"


BASE = f"""
WITH ord AS (
  SELECT *, cast(floor(sqrt(o_custkey % 324)) AS bigint) AS slot FROM orders
),
all_answers AS (
  SELECT
    4000000000000000000 + ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      cast(floor(l_extendedprice * 100 + 0.5) AS bigint))), 1, 15))::bigint AS id,
    CASE WHEN (l_orderkey * 7 + slot) % 9 > 1 THEN l_orderkey ELSE l_orderkey - l_orderkey % 10 + 9 END AS parent_id,
    CASE WHEN l_orderkey % 89 <> 0 THEN l_suppkey END AS owner_user_id,
    o_orderdate + to_minutes(cast(l_linenumber * l_linenumber * floor(l_quantity) * 7 AS bigint)) AS creation_date,
    o_orderdate + to_minutes(cast(l_linenumber * l_linenumber * floor(l_quantity) * 7 AS bigint)) AS last_activity_date,
    CASE WHEN l_orderkey % 3 = 0
      THEN o_orderdate + to_minutes(cast(l_linenumber * l_linenumber * floor(l_quantity) * 7 AS bigint)) END AS last_edit_date,
    cast(floor(l_quantity) AS bigint) % 21 - 5 AS score,
    cast(l_linenumber AS bigint) AS comment_count,
    '<pre><code>' || ({_list(SNIPPETS)})[(l_orderkey * 5 + l_linenumber * 3) % 27 + 1] || '</code></pre>' AS body
  FROM lineitem JOIN ord ON l_orderkey = o_orderkey
),
stats AS (
  SELECT parent_id, count(*) AS n, min(id) AS lead_id FROM all_answers GROUP BY parent_id
),
all_questions AS (
  SELECT
    o_orderkey AS id,
    p_name AS title,
    CASE WHEN o_orderkey % 101 <> 0 THEN '<p>' || d.text || '</p><pre><code>'
      || ({_list(SNIPPETS)})[o_orderkey % 27 + 1] || '</code></pre>' END AS body,
    CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS owner_user_id,
    o_orderdate AS creation_date,
    o_orderdate AS last_activity_date,
    cast(floor(o_totalprice) AS bigint) % 41 - 10 AS score,
    cast(floor(o_totalprice) AS bigint) AS view_count,
    coalesce(stats.n, 0) AS answer_count,
    o_orderkey % 5 AS comment_count,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 9 END AS favorite_count,
    CASE WHEN o_orderstatus = 'F' THEN lead_id END AS accepted_answer_id,
    CASE WHEN o_orderkey % 10 = 9 THEN 'python|pandas' ELSE concat_ws('|',
      CASE WHEN o_orderkey % 2 = 0 THEN 'sql' END,
      ({_list(TAG_LIST)})[slot + 1],
      CASE o_orderstatus WHEN 'F' THEN 'join' WHEN 'P' THEN 'group-by' END,
      CASE WHEN o_orderkey % 13 = 0 THEN 'nosql' END,
      CASE WHEN o_orderkey % 7 = 0 THEN '' END) END AS tags
  FROM ord
  LEFT JOIN stats ON o_orderkey = stats.parent_id
  LEFT JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
  LEFT JOIN documents d ON d.doc_id = o_orderkey % (SELECT count(*) FROM documents)
),
all_users AS (
  SELECT
    CASE WHEN c_custkey % 50 = 7 THEN -1 - c_custkey ELSE c_custkey END AS id,
    c_name AS display_name,
    cast(abs(floor(c_acctbal * 5)) AS bigint) AS reputation,
    CASE c_custkey % 10 WHEN 0 THEN '31' WHEN 1 THEN 'n/a' END AS age,
    c_mktsegment AS location,
    c_custkey % 7 AS up_votes, c_custkey % 3 AS down_votes, c_custkey % 11 AS views,
    TIMESTAMP '2010-01-01 00:00:00' + to_days(cast(c_custkey % 2000 AS integer)) AS creation_date,
    TIMESTAMP '2010-01-01 00:00:00' + to_days(cast(c_custkey % 3000 + 2000 AS integer)) AS last_access_date,
    CASE WHEN c_custkey % 4 = 0 THEN 'https://example.org/' || c_custkey END AS website_url
  FROM customer
),
all_comments AS (
  SELECT event_id AS id,
    CASE WHEN event_id % 2 = 0 THEN (event_id * 7) % (SELECT count(*) FROM orders) ELSE lead_id END AS post_id,
    user_id, cast(floor(value) AS bigint) % 5 AS score, ts AS creation_date, props AS text
  FROM events LEFT JOIN stats ON parent_id = (event_id * 7) % (SELECT count(*) FROM orders)
),
raw_questions AS (
  SELECT * FROM all_questions
  WHERE creation_date >= TIMESTAMP '1997-01-01' AND creation_date < TIMESTAMP '2000-01-01' AND tags LIKE '%sql%'
),
raw_answers AS (SELECT * FROM all_answers WHERE parent_id IN (SELECT id FROM raw_questions)),
raw_users AS (
  SELECT * FROM all_users WHERE id IN (
    SELECT owner_user_id FROM raw_questions WHERE owner_user_id IS NOT NULL
    UNION SELECT owner_user_id FROM raw_answers WHERE owner_user_id IS NOT NULL)
),
raw_comments AS (
  SELECT * FROM all_comments WHERE post_id IN (SELECT id FROM raw_questions UNION SELECT id FROM raw_answers)
),
raw_tags AS (
  SELECT cast(n_nationkey AS bigint) AS id, n_name AS tag_name, cast(n_regionkey * 1000 AS bigint) AS count FROM nation
),
stg_questions AS (
  SELECT id AS question_id, title, owner_user_id, creation_date, last_activity_date, score, view_count, answer_count,
    comment_count, favorite_count, accepted_answer_id, accepted_answer_id IS NOT NULL AS has_accepted_answer,
    tags AS tags_raw, string_split(tags, '|') AS tags
  FROM raw_questions
),
stg_answers AS (
  SELECT id AS answer_id, parent_id AS question_id, owner_user_id, creation_date, last_activity_date, last_edit_date,
    score, comment_count
  FROM raw_answers
),
stg_users AS (
  SELECT id AS user_id, display_name, reputation, try_cast(age AS bigint) AS age, location, up_votes, down_votes,
    views AS profile_views, creation_date AS account_created_at, last_access_date, website_url
  FROM raw_users
),
stg_comments AS (
  SELECT id AS comment_id, post_id, user_id, score, creation_date, text AS comment_text FROM raw_comments
),
stg_tags AS (SELECT id AS tag_id, tag_name, count AS sitewide_question_count FROM raw_tags),
first_answer AS (SELECT question_id, min(creation_date) AS first_answer_at FROM stg_answers GROUP BY question_id),
dim_questions AS (
  SELECT q.question_id, q.title, q.owner_user_id, u.display_name AS owner_display_name,
    u.reputation AS owner_reputation, q.creation_date, cast(year(q.creation_date) AS bigint) AS creation_year,
    q.score, q.view_count, q.answer_count, q.comment_count, q.favorite_count, q.answer_count > 0 AS is_answered,
    q.has_accepted_answer, f.first_answer_at,
    date_sub('hour', q.creation_date, f.first_answer_at) AS hours_to_first_answer, q.tags
  FROM stg_questions q
  LEFT JOIN stg_users u ON q.owner_user_id = u.user_id
  LEFT JOIN first_answer f ON q.question_id = f.question_id
),
exploded AS (
  SELECT * FROM (SELECT unnest(tags) AS tag, question_id, creation_year, score, view_count, answer_count, is_answered,
    has_accepted_answer FROM dim_questions) WHERE tag IS NOT NULL AND tag <> ''
),
fct AS (
  SELECT tag || '|' || creation_year AS tag_year_key, tag, creation_year, count(*) AS num_questions,
    count(*) FILTER (WHERE is_answered) AS num_answered, {_share('is_answered')} AS pct_answered,
    count(*) FILTER (WHERE has_accepted_answer) AS num_accepted, {_share('has_accepted_answer')} AS pct_accepted,
    {_round('avg(score)', 2)} AS avg_score, quantile_disc(score, 0.5) AS median_score,
    cast(sum(view_count) AS bigint) AS total_views, {_round('avg(answer_count)', 2)} AS avg_answers_per_question
  FROM exploded GROUP BY tag, creation_year
)"""

DIALECTS = f""",
dialect_tags(dialect, tag) AS (VALUES {_rows([(d, t) for d, tags in cat.DIALECT_TAGS.items() for t in tags])}),
matched AS (
  SELECT DISTINCT dialect, question_id, creation_year, score, view_count, is_answered, has_accepted_answer
  FROM dim_questions q, dialect_tags dt WHERE list_contains(q.tags, dt.tag)
),
dialects AS (
  SELECT dialect, creation_year, count(*) AS num_questions, count(*) FILTER (WHERE is_answered) AS num_answered,
    {_share('is_answered')} AS pct_answered, count(*) FILTER (WHERE has_accepted_answer) AS num_accepted,
    {_share('has_accepted_answer')} AS pct_accepted, {_round('avg(score)', 2)} AS avg_score,
    cast(sum(view_count) AS bigint) AS total_views, {_round('avg(view_count)', 0)} AS avg_views
  FROM matched GROUP BY dialect, creation_year
)"""


def _flag_sql(f: cat.Feature) -> str:
    if f.min_hits > 1:
        return f"cast(len(regexp_extract_all(body_text, {_text(f.pattern)})) >= {f.min_hits} AS bigint) AS {f.flag}"
    return f"cast(regexp_matches(body_text, {_text(f.pattern)}) AS bigint) AS {f.flag}"


_FLAGS = ", ".join(f.flag for f in cat.FEATURES)
_SHOW = ", ".join(f.flag for f in cat.FEATURES if f.level != "DML / DDL")
_FACTS = "question_id, creation_year, score, view_count, is_answered, has_accepted_answer"

COMPLEXITY = f""",
bodies AS (SELECT id AS question_id, lower(coalesce(body, '')) AS body_text FROM raw_questions),
flags AS (SELECT question_id, {', '.join(map(_flag_sql, cat.FEATURES))} FROM bodies),
scored AS (SELECT *, {' + '.join(f'{f.flag} * {f.weight}' for f in cat.FEATURES)} AS complexity_score FROM flags),
complexity AS (
  SELECT {_FACTS}, complexity_score,
    {_steps('complexity_score', '<=', cat.COMPLEXITY_TIERS, cat.TOP_COMPLEXITY_TIER)} AS complexity_tier, {_FLAGS}
  FROM dim_questions JOIN scored USING (question_id)
)"""

ERRORS = f""",
signatures(label, pattern) AS (VALUES {_rows([(s.label, s.pattern) for s in cat.ERROR_SIGNATURES])}),
searched AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(body, '')) AS search_text FROM raw_questions)"""

KEYWORDS = f""",
keywords(label, pattern) AS (VALUES {_rows([(s.label, s.pattern) for s in cat.KEYWORDS])}),
accepted AS (SELECT a.* FROM raw_answers a JOIN raw_questions q ON a.id = q.accepted_answer_id)"""

YEARS = "(1997, 1998, 1999)"

PAIR = f""",
pair AS (
  SELECT a.tag, a.num_questions AS q_1997, b.num_questions AS q_1999, b.num_questions - a.num_questions AS abs_change,
    {_ratio('(b.num_questions - a.num_questions)', 'a.num_questions')} AS growth_rate,
    a.pct_answered AS pct_answered_1997, b.pct_answered AS pct_answered_1999
  FROM fct a JOIN fct b USING (tag)
  WHERE a.creation_year = 1997 AND b.creation_year = 1999 AND a.num_questions >= 20 AND b.num_questions >= 20
)"""

RATES = f""",
rates AS (
  SELECT tag, cast(sum(num_questions) AS bigint) AS total_questions,
    {_ratio('sum(num_answered)', 'sum(num_questions)')} AS pct_answered,
    {_ratio('sum(num_accepted)', 'sum(num_questions)')} AS pct_accepted,
    {_round('avg(avg_score)', 2)} AS avg_score, {_round('avg(avg_answers_per_question)', 2)} AS avg_answers_per_q
  FROM fct WHERE creation_year IN {YEARS} GROUP BY tag HAVING sum(num_questions) >= 150
)"""

_CX = COMPLEXITY


def _in_year(year: int) -> str:
    return f"cast(coalesce(sum(num_questions) FILTER (WHERE creation_year = {year}), 0) AS bigint)"


_PRACTICE = ", ".join(cat.PRACTICE_LABELS)
_LEVEL = {f.flag: f.level for f in cat.FEATURES}


def _pct_sql(flag: str) -> str:
    return _round(f"100.0 * sum({flag}) / nullif(count(*), 0)", 1)


def _even_mean(column: str, digits: int) -> str:
    total = f"cast(sum(cast(round({column} * 10000) AS bigint)) AS bigint)"
    parts = f"(count({column}) * {10 ** (4 - digits)})"
    return f"{_even(total, parts)} / {10.0 ** digits} AS {column}"


_HOURS = _steps("hours_to_first_answer", "<", cat.ANSWER_TIME_TIERS, cat.LAST_ANSWER_TIME_TIER)

_QUESTION_COLUMNS = """title, owner_user_id, creation_date, last_activity_date, score, view_count, answer_count,
  comment_count, favorite_count, accepted_answer_id"""

_UNIQUE = [
    ("questions", "id", "raw_questions"),
    ("answers", "id", "raw_answers"),
    ("users", "id", "raw_users"),
    ("stg_questions", "question_id", "stg_questions"),
    ("stg_answers", "answer_id", "stg_answers"),
    ("stg_users", "user_id", "stg_users"),
    ("stg_comments", "comment_id", "stg_comments"),
    ("stg_tags", "tag_id", "stg_tags"),
    ("stg_tags", "tag_name", "stg_tags"),
    ("dim_questions", "question_id", "dim_questions"),
    ("fct_tag_yearly", "tag_year_key", "fct"),
]
_NOT_NULL = _UNIQUE + [("stg_answers", "question_id", "stg_answers"), ("fct_tag_yearly", "tag", "fct")]


def _verdict(model: str, column: str, failures: str) -> str:
    return f"SELECT '{model}' AS model, '{column}' AS column_name, ({failures}) AS failures, ({failures}) = 0 AS passed"


def _dup(column: str, table: str) -> str:
    return (
        f"SELECT count(*) FROM (SELECT {column} FROM {table} WHERE {column} IS NOT NULL "
        f"GROUP BY {column} HAVING count(*) > 1)"
    )


_CHECKS = [
    ("raw → dim_questions row count", "SELECT count(*) FROM raw_questions", "SELECT count(*) FROM dim_questions"),
    (
        "dim_questions: no duplicate question_ids",
        "SELECT count(*) FROM dim_questions",
        "SELECT count(DISTINCT question_id) FROM dim_questions",
    ),
    ("raw → dim_questions score sum", "SELECT sum(score) FROM raw_questions", "SELECT sum(score) FROM dim_questions"),
    (
        "raw → dim_questions view count sum",
        "SELECT sum(view_count) FROM raw_questions",
        "SELECT sum(view_count) FROM dim_questions",
    ),
    (
        "has_accepted_answer matches raw accepted_answer_id IS NOT NULL",
        "SELECT count(*) FROM raw_questions WHERE accepted_answer_id IS NOT NULL",
        "SELECT count(*) FROM dim_questions WHERE has_accepted_answer",
    ),
    (
        "is_answered matches raw answer_count > 0",
        "SELECT count(*) FROM raw_questions WHERE answer_count > 0",
        "SELECT count(*) FROM dim_questions WHERE is_answered",
    ),
    ("raw → stg_answers row count", "SELECT count(*) FROM raw_answers", "SELECT count(*) FROM stg_answers"),
    (
        "fct_tag_yearly sql/1997 count matches dim_questions",
        "SELECT sum(num_questions) FROM fct WHERE tag = 'sql' AND creation_year = 1997",
        "SELECT count(*) FROM dim_questions WHERE list_contains(tags, 'sql') AND creation_year = 1997",
    ),
]
CHECKS = ", checks AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS check_name, cast(({a}) AS varchar) AS expected, cast(({b}) AS varchar) AS actual, "
    f"({a}) = ({b}) AS passed"
    for name, a, b in _CHECKS
) + ")"

_FACT_MEASURES = f"""cast(sum(num_questions) AS bigint) AS total_questions,
  cast(sum(num_answered) AS bigint) AS total_answered, cast(sum(num_accepted) AS bigint) AS total_accepted,
  {_round('avg(pct_answered)', 6)} AS pct_answered, {_round('avg(pct_accepted)', 6)} AS pct_accepted,
  {_round('avg(avg_score)', 6)} AS avg_score, cast(sum(total_views) AS bigint) AS total_views,
  {_round('avg(avg_answers_per_question)', 6)} AS avg_answers_per_question, count(*) AS count_tag_year_rows"""

_QUESTION_MEASURES = f"""count(*) AS count, {_round('avg(CASE WHEN is_answered THEN 1.0 ELSE 0.0 END)', 6)} AS pct_answered,
  {_round('avg(CASE WHEN has_accepted_answer THEN 1.0 ELSE 0.0 END)', 6)} AS pct_accepted,
  {_round('avg(score)', 6)} AS avg_score, cast(sum(view_count) AS bigint) AS total_views,
  quantile_cont(hours_to_first_answer, 0.5) AS median_hours_to_answer,
  {_round('avg(owner_reputation)', 6)} AS avg_owner_reputation"""

_LINK = _text(cat.LINK_ROOT)


def _volume(direction: str) -> str:
    return f"""SELECT tag, cast(sum(num_questions) FILTER (WHERE creation_year = 1997) AS bigint) AS total_questions_1997,
      cast(sum(num_questions) FILTER (WHERE creation_year = 1999) AS bigint) AS total_questions_1999
      FROM fct WHERE creation_year IN (1997, 1999) GROUP BY tag
      ORDER BY total_questions_1997 {direction} NULLS LAST, tag LIMIT 10"""


def _practice(tail: str) -> str:
    return f"""SELECT question_id, q.title, q.score, q.view_count, array_to_string(q.tags, ', ') AS tags_str,
      complexity_score, complexity_tier, {_PRACTICE}
      FROM dim_questions q JOIN (SELECT question_id, complexity_score, complexity_tier, {_PRACTICE} FROM complexity)
      USING (question_id) WHERE complexity_tier = '2 · Basic' AND complexity_score > 0 {tail}"""


_BODIES: dict[str, str] = {
    # sources
    "select_questions": "SELECT * FROM raw_questions",
    "select_questions_strict": "SELECT * FROM raw_questions WHERE NOT list_contains(string_split(tags, '|'), 'nosql')",
    "select_answers": "SELECT * FROM raw_answers",
    "select_users": "SELECT * FROM raw_users",
    "select_comments": "SELECT * FROM raw_comments",
    "select_tags": "SELECT * FROM raw_tags",
    "corpus_row_counts": """SELECT 1 AS step, 'questions' AS table_name, count(*) AS n_rows FROM raw_questions
      UNION ALL SELECT 2, 'answers', count(*) FROM raw_answers UNION ALL SELECT 3, 'users', count(*) FROM raw_users
      UNION ALL SELECT 4, 'comments', count(*) FROM raw_comments UNION ALL SELECT 5, 'tags', count(*) FROM raw_tags""",
    # staging
    "stg_questions": f"""SELECT question_id, {_QUESTION_COLUMNS}, has_accepted_answer, tags_raw,
      array_to_string(tags, ',') AS tags FROM stg_questions""",
    "stg_answers": "SELECT * FROM stg_answers",
    "stg_users": "SELECT * FROM stg_users",
    "stg_comments": "SELECT * FROM stg_comments",
    "stg_tags": "SELECT * FROM stg_tags",
    # marts
    "first_answer": "SELECT * FROM first_answer",
    "dim_questions": "SELECT * EXCLUDE (tags), array_to_string(tags, ',') AS tags FROM dim_questions",
    "tag_explode": "SELECT * FROM exploded",
    "fct_tag_yearly": "SELECT * FROM fct",
    "dialect_mart": DIALECTS + "SELECT * FROM dialects",
    "complexity_mart": _CX + "SELECT * FROM complexity",
    # analyses
    "top_tags_by_volume": f""", volumes AS (
        SELECT tag, cast(sum(num_questions) AS bigint) AS total_questions, cast(sum(total_views) AS bigint) AS total_views,
          {", ".join(f"{_in_year(y)} AS q_{y}" for y in (1997, 1998, 1999))}
        FROM fct WHERE creation_year IN {YEARS} GROUP BY tag)
      SELECT (SELECT count(*) FROM volumes w WHERE w.total_questions > v.total_questions) + 1 AS rank, *,
        q_1999 - q_1997 AS delta_1997_1999
      FROM volumes v ORDER BY total_questions DESC, tag LIMIT 20""",
    "tag_yoy_growth": f""", series AS (
        SELECT f.*, (SELECT arg_max(p.num_questions, p.creation_year) FROM fct p
            WHERE p.tag = f.tag AND p.creation_year IN {YEARS} AND p.creation_year < f.creation_year) AS prev_year_questions,
          (SELECT count(*) FROM fct p
            WHERE p.tag = f.tag AND p.creation_year IN {YEARS} AND p.num_questions >= 50) AS big_years
        FROM fct f WHERE creation_year IN {YEARS})
      SELECT tag, creation_year, num_questions, prev_year_questions,
        {_ratio('(num_questions - prev_year_questions)', 'prev_year_questions')} AS yoy_growth_rate,
        pct_answered, avg_score FROM series WHERE big_years >= 2""",
    "rising_falling_tags": PAIR + """, placed AS (
        SELECT *, row_number() OVER (ORDER BY growth_rate DESC, tag) AS up, count(*) OVER () AS n FROM pair)
      SELECT if(up <= 5, 'rising', 'falling') AS direction, cast(up AS varchar) AS rank_within_group,
        if(up <= 5, up, n + 1 - up) AS rank_in_direction,
        tag, q_1997, q_1999, abs_change, growth_rate, pct_answered_1997, pct_answered_1999
      FROM placed WHERE up <= 5 OR up > n - 5""",
    "answer_rate_by_tag": RATES + """, placed AS (
        SELECT *, row_number() OVER (ORDER BY pct_answered DESC, tag) AS best_answered_rank,
          row_number() OVER (ORDER BY pct_accepted DESC, tag) AS best_accepted_rank, count(*) OVER () AS n FROM rates)
      SELECT * EXCLUDE (n), n + 1 - best_answered_rank AS worst_answered_rank,
        if(best_answered_rank <= 5, 'highest', 'lowest') || ' answer rate' AS cohort
      FROM placed WHERE best_answered_rank <= 5 OR best_answered_rank > n - 5""",
    "error_patterns": ERRORS + f"""SELECT label AS error_pattern, count(*) AS num_questions,
        {_round('avg(score)', 2)} AS avg_score, cast(sum(score) AS bigint) AS total_upvotes,
        cast(sum(view_count) AS bigint) AS total_views, {_share('answer_count > 0')} AS pct_answered,
        {_share('accepted_answer_id IS NOT NULL')} AS pct_accepted, {_round('avg(answer_count)', 2)} AS avg_answers_per_q
      FROM searched, signatures WHERE regexp_matches(search_text, pattern)
      GROUP BY label ORDER BY num_questions DESC, label LIMIT 10""",
    "error_patterns_table": ERRORS + f"""SELECT label AS error_pattern, count(*) AS num_questions,
        {_round('avg(score)', 2)} AS avg_score, cast(sum(score) AS bigint) AS total_upvotes,
        cast(sum(view_count) AS bigint) AS total_views, {_share('answer_count > 0')} AS pct_answered,
        {_share('accepted_answer_id IS NOT NULL')} AS pct_accepted, {_round('avg(answer_count)', 2)} AS avg_answers_per_q
      FROM searched, signatures WHERE regexp_matches(search_text, pattern)
      GROUP BY label""",
    "keyword_frequency": KEYWORDS + f""", q AS (
        SELECT label, count(*) AS in_questions FROM raw_questions, keywords
        WHERE regexp_matches(lower(coalesce(body, '')), pattern) GROUP BY label),
      a AS (
        SELECT label, count(*) AS n FROM accepted, keywords
        WHERE regexp_matches(lower(coalesce(body, '')), pattern) GROUP BY label)
      SELECT q.label AS keyword, in_questions, coalesce(n, 0) AS in_accepted_answers,
        {_ratio('coalesce(n, 0)', 'in_questions')} AS answer_to_question_ratio
      FROM q LEFT JOIN a USING (label)""",
    "accepted_answers": KEYWORDS + "SELECT * FROM accepted",
    "dialect_frequency": DIALECTS + """SELECT * FROM dialects
      ORDER BY sum(num_questions) OVER (PARTITION BY dialect) DESC, dialect, creation_year""",
    "complexity_scoring": _CX + f"""SELECT {_FACTS}, complexity_score, complexity_tier, {_SHOW} FROM complexity
      ORDER BY complexity_score DESC""",
    "sql_feature_flags": _CX + "SELECT * FROM flags",
    "complexity_tiers": _CX + """SELECT complexity_tier, complexity_score, count(*) AS num_questions FROM complexity
      GROUP BY complexity_tier, complexity_score""",
    # quality
    "dq_unique": " UNION ALL ".join(_verdict(m, c, _dup(c, t)) for m, c, t in _UNIQUE),
    "dq_not_null": " UNION ALL ".join(
        _verdict(m, c, f"SELECT count(*) FROM {t} WHERE {c} IS NULL") for m, c, t in _NOT_NULL
    ),
    "dq_relationships": _verdict(
        "stg_answers",
        "question_id",
        "SELECT count(*) FROM stg_answers WHERE question_id IS NOT NULL "
        "AND question_id NOT IN (SELECT question_id FROM stg_questions)",
    ),
    "validation_checks": CHECKS + "SELECT * FROM checks",
    "validation_summary": CHECKS + """SELECT count(*) FILTER (WHERE passed) AS checks_passed, count(*) AS checks_total,
      CASE WHEN count(*) FILTER (WHERE passed) = count(*) THEN 'Pass' ELSE 'Fail' END AS status FROM checks""",
    # panels
    "kpis": f"""SELECT count(*) AS total_questions, {_share('is_answered')} AS pct_answered,
      {_share('has_accepted_answer')} AS pct_accepted, cast(sum(view_count) AS bigint) AS total_views
      FROM dim_questions WHERE year(creation_date) IN {YEARS}""",
    "top_n_tag_trend": f""", top AS (SELECT tag, sum(num_questions) AS total FROM fct WHERE creation_year IN {YEARS}
        GROUP BY tag ORDER BY total DESC, tag LIMIT 10)
      SELECT tag, creation_year, num_questions FROM fct JOIN top USING (tag) WHERE creation_year IN {YEARS}""",
    "monthly_volume": f"""SELECT cast(date_trunc('month', creation_date) AS date) AS month, count(*) AS num_questions,
      {_share('has_accepted_answer')} AS pct_accepted FROM dim_questions
      WHERE year(creation_date) IN {YEARS} GROUP BY 1""",
    "tag_growth": PAIR + "SELECT tag, q_1997, q_1999, growth_rate FROM pair",
    "growth_head_tail": PAIR + f""", head AS (SELECT *, 'Rising' AS direction FROM pair ORDER BY growth_rate DESC, tag LIMIT 5),
      tail AS (SELECT *, 'Falling' AS direction FROM pair ORDER BY growth_rate, tag DESC LIMIT 5)
      SELECT tag, q_1997, q_1999, growth_rate, direction,
        {_even('cast(round(growth_rate * 10000) AS bigint)', '10')} / 10.0 AS growth_pct
      FROM (SELECT * FROM head UNION ALL SELECT * FROM tail)""",
    "answer_rates_min_volume": RATES + "SELECT * EXCLUDE (avg_answers_per_q) FROM rates",
    "answer_rate_extremes": RATES + """, best AS (SELECT *, 'best' AS side FROM rates ORDER BY pct_answered DESC, tag LIMIT 5),
      worst AS (SELECT *, 'worst' AS side FROM rates ORDER BY pct_answered, tag DESC LIMIT 5)
      SELECT * EXCLUDE (avg_answers_per_q) FROM (SELECT * FROM best UNION ALL SELECT * FROM worst)""",
    "time_to_answer_tiers": f"""SELECT {_HOURS} AS tier, count(*) AS num_questions, substr({_HOURS}, 4) AS label
      FROM dim_questions WHERE is_answered AND hours_to_first_answer IS NOT NULL AND year(creation_date) IN {YEARS}
      GROUP BY 1, 3""",
    "dialect_table": DIALECTS + "SELECT * EXCLUDE (num_answered, num_accepted) FROM dialects",
    "dialect_rollup": DIALECTS + f"""SELECT dialect, cast(sum(num_questions) AS bigint) AS total_questions,
      {_even_mean('pct_answered', 4)}, {_even_mean('pct_accepted', 4)}, {_even_mean('avg_score', 2)},
      cast(sum(total_views) AS bigint) AS total_views FROM dialects WHERE creation_year IN {YEARS} GROUP BY dialect""",
    "complexity_by_tier": _CX + f"""SELECT complexity_tier, count(*) AS num_questions, {_share('is_answered')} AS pct_answered,
      {_share('has_accepted_answer')} AS pct_accepted, {_round('avg(score)', 2)} AS avg_score,
      {_round('avg(complexity_score)', 1)} AS avg_complexity_score, cast(sum(view_count) AS bigint) AS total_views
      FROM complexity WHERE creation_year IN {YEARS} GROUP BY complexity_tier""",
    "feature_presence_wide": _CX + "SELECT "
    + ", ".join(f"{_pct_sql(flag)} AS {flag[2:]}_pct" for flag in cat.FEATURE_LABELS)
    + " FROM complexity",
    "feature_presence_long": _CX + " UNION ALL ".join(
        f"SELECT {_text(label)} AS feature, {_pct_sql(flag)} AS pct, {_text(_LEVEL[flag])} AS level FROM complexity"
        for flag, label in cat.FEATURE_LABELS.items()
    ),
    "practice_candidates": _CX + _practice(""),
    "practice_pool": _CX + _practice("ORDER BY md5('7:' || question_id), question_id LIMIT 50"),
    "active_features": _CX + "SELECT question_id, concat_ws(', ', "
    + ", ".join(f"CASE WHEN {flag} <> 0 THEN {_text(label)} END" for flag, label in cat.PRACTICE_LABELS.items())
    + ") AS features FROM complexity",
    # semantic layer
    "fct_measures": f"SELECT creation_year, {_FACT_MEASURES} FROM fct GROUP BY creation_year",
    "pct_answered_tier": f"""SELECT {_tier('(pct_answered * 100)', cat.PCT_ANSWERED_BOUNDS)} AS pct_answered_tier,
      count(*) AS count_tag_year_rows, cast(sum(num_questions) AS bigint) AS total_questions FROM fct GROUP BY 1""",
    "question_measures": f"SELECT creation_year, {_QUESTION_MEASURES} FROM dim_questions GROUP BY creation_year",
    "median_hours_to_answer": """SELECT is_answered, has_accepted_answer,
      quantile_cont(hours_to_first_answer, 0.5) AS median_hours_to_answer FROM dim_questions GROUP BY ALL""",
    "creation_timeframes": """SELECT cast(creation_date AS date) AS creation_date,
      cast(date_trunc('month', q.creation_date) AS date) AS creation_month,
      cast(date_trunc('quarter', q.creation_date) AS date) AS creation_quarter,
      cast(date_trunc('year', q.creation_date) AS date) AS creation_calendar_year,
      count(*) AS count FROM dim_questions q GROUP BY 1, 2, 3, 4""",
    "creation_raw": "SELECT creation_date AS creation_raw, count(*) AS count FROM dim_questions GROUP BY 1",
    "time_to_answer_tier_all": f"""SELECT {_tier('hours_to_first_answer', cat.ANSWER_HOURS_BOUNDS)} AS time_to_answer_tier,
      count(*) AS count FROM dim_questions GROUP BY 1""",
    "reputation_tier": f"""SELECT {_tier('owner_reputation', cat.REPUTATION_BOUNDS)} AS reputation_tier, count(*) AS count
      FROM dim_questions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "link_columns": f"SELECT question_id, {_LINK} || question_id AS question_link FROM dim_questions",
    "tag_links": f"SELECT DISTINCT tag, {_LINK} || 'tagged/' || url_encode(tag) AS tag_link FROM fct",
    "tile_kpis": f"""SELECT cast(sum(num_questions) AS bigint) AS total_questions,
      {_round('avg(pct_answered)', 6)} AS pct_answered, {_round('avg(pct_accepted)', 6)} AS pct_accepted,
      cast(sum(total_views) AS bigint) AS total_views FROM fct WHERE creation_year IN {YEARS}""",
    "tile_tag_volume_pivot": f""", slots AS (
        SELECT tag, row_number() OVER (ORDER BY sum(num_questions) DESC, tag) AS slot FROM fct
        WHERE creation_year IN {YEARS} GROUP BY tag QUALIFY slot <= 10),
      wide AS (FROM (PIVOT (SELECT creation_year, slot, num_questions FROM fct JOIN slots USING (tag)
        WHERE creation_year IN {YEARS}) ON slot IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
        USING sum(num_questions) GROUP BY creation_year))
      SELECT creation_year, """
    + ", ".join(
        f'(SELECT tag FROM slots WHERE slot = {i}) AS tag_{i}, cast("{i}" AS bigint) AS total_questions_{i}'
        for i in range(1, 11)
    )
    + " FROM wide",
    "tile_best_answered": f"""SELECT tag, {_round('avg(pct_answered)', 6)} AS pct_answered,
      cast(sum(num_questions) AS bigint) AS total_questions FROM fct WHERE creation_year IN {YEARS}
      GROUP BY tag HAVING sum(num_questions) > 150 ORDER BY 2 DESC, tag LIMIT 15""",
    "tile_volume_top": _volume("DESC"),
    "tile_volume_bottom": _volume("ASC"),
    "tile_monthly": """SELECT cast(date_trunc('month', creation_date) AS date) AS creation_month, count(*) AS count
      FROM dim_questions GROUP BY 1 ORDER BY 1 LIMIT 500""",
    "tile_time_to_answer": f"""SELECT {_tier('hours_to_first_answer', cat.ANSWER_HOURS_BOUNDS)} AS time_to_answer_tier,
      count(*) AS count FROM dim_questions WHERE is_answered GROUP BY 1 ORDER BY 1 LIMIT 10""",
}

STATEMENTS = {name: f"{BASE}\n{body}" for name, body in _BODIES.items()}
