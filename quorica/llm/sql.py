"""DuckDB statements that give the rows of the queries."""

from __future__ import annotations

from quorica.llm.licenses import COPYRIGHT_LINE, FOLDER, NOTICES, PUNCTUATION, RESERVED_LINE, SPELLINGS
from quorica.llm.quality_rules import PRIOR_ROWS
from quorica.llm.url_filter import ADDRESSES, PUBLIC_SUFFIXES

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SHINGLE_CTES = f"""
words AS (
    SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + {{last}}], ' ') AS s
    FROM words, unnest(range(1, greatest(len(w) - {{last}}, 1) + 1)) AS place(i)
    WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    GROUP BY ALL
),
links AS (
    SELECT x, y FROM shared
    JOIN sizes sx ON sx.doc_id = x
    JOIN sizes sy ON sy.doc_id = y
    WHERE 100 * shared.n >= 80 * (sx.n + sy.n - shared.n)
),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
    SELECT x, y FROM both_ways
    UNION
    SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
)"""

OP7 = f"""
WITH RECURSIVE {SHINGLE_CTES.format(last=1)},
least_reached AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x),
found AS (
    SELECT words.doc_id, coalesce(sizes.n, 0) AS n_shingles,
           least(words.doc_id, coalesce(low, words.doc_id)) AS component_id
    FROM words
    LEFT JOIN sizes ON sizes.doc_id = words.doc_id
    LEFT JOIN least_reached ON least_reached.doc_id = words.doc_id
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM found
"""

RATES = (
    ("symbol_rate", "1000 * n_symbols // n_words", 200, False),
    ("dup_line_rate", "1000 * n_dup_lines // n_words", 50, False),
    ("repeat_rate", "1000 * n_repeat_words // n_words", 100, False),
    ("word_length", "100 * word_chars // n_words", 150, True),
)
_LOW = " ".join(
    f"WHEN '{n}' THEN q50 - 4 * (q50 - q25) - {slack}" if both else f"WHEN '{n}' THEN NULL" for n, _, slack, both in RATES
)
_SLACK = " ".join(f"WHEN '{n}' THEN {slack}" for n, _, slack, _ in RATES)
_RATE_ROWS = " UNION ALL ".join(
    f"SELECT lang, source, '{n}' AS rate, {e} AS value FROM measured WHERE NOT base_failed" for n, e, _, _ in RATES
)
_RATE_COLUMNS = ", ".join(f"CASE WHEN n_words > 0 THEN {e} END AS {n}" for n, e, _, _ in RATES)



def _drawn(own: str, above: str) -> str:
    """Quantiles of a group drawn to those of the level above."""
    return ", ".join(
        f"({own}.total * {own}.{q} + {PRIOR_ROWS} * {above}.{q}) // ({own}.total + {PRIOR_ROWS}) AS {q}"
        for q in ("q25", "q50", "q75")
    )


# Expects a relation `docs` (doc_id, text, lang, source); gives `judged` with doc_id, the statistics and kept.
QUALITY_CTES = f"""
q_words AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
    FROM docs
),
q_windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s
    FROM q_words, unnest(range(1, len(w) - 6)) AS place(i)
),
q_repeated AS (
    SELECT doc_id, i FROM q_windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
),
q_marked AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM q_repeated, range(0, 8) AS step(k) GROUP BY doc_id
),
q_lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM q_words)
    WHERE regexp_matches(line, '{WORD}')
    GROUP BY doc_id
),
counted AS (
    SELECT q_words.doc_id, lang, source, len(w) AS n_words,
           length(array_to_string(w, '')) AS word_chars,
           length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
           coalesce(q_lines.n, 0) AS n_dup_lines,
           coalesce(q_marked.n, 0) AS n_repeat_words
    FROM q_words
    LEFT JOIN q_lines ON q_lines.doc_id = q_words.doc_id
    LEFT JOIN q_marked ON q_marked.doc_id = q_words.doc_id
),
measured AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
),
rate_rows AS ({_RATE_ROWS}),
leaf_sketches AS (
    SELECT lang, source, rate,
           (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS value,
           count(*) AS n
    FROM rate_rows GROUP BY ALL
),
level_sketches AS (
    SELECT 0 AS level, NULL AS lang, NULL AS source, rate, value, n FROM leaf_sketches
    UNION ALL SELECT 1, lang, NULL, rate, value, n FROM leaf_sketches
    UNION ALL SELECT 2, lang, source, rate, value, n FROM leaf_sketches
),
merged AS (SELECT level, lang, source, rate, value, sum(n) AS n FROM level_sketches GROUP BY ALL),
ranked AS (
    SELECT *,
           sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY value) AS upto,
           sum(n) OVER (PARTITION BY level, lang, source, rate) AS total
    FROM merged
),
quantiles AS (
    SELECT level, lang, source, rate, any_value(total) AS total,
           min(CASE WHEN 100 * upto >= 25 * total THEN value END) AS q25,
           min(CASE WHEN 100 * upto >= 50 * total THEN value END) AS q50,
           min(CASE WHEN 100 * upto >= 75 * total THEN value END) AS q75
    FROM ranked GROUP BY level, lang, source, rate
),
stacked AS (
    SELECT leaf.lang, leaf.source, q0.rate, {_drawn("q1", "q0")}, q2.total AS total,
           q2.q25 AS own25, q2.q50 AS own50, q2.q75 AS own75
    FROM (SELECT DISTINCT lang, source FROM leaf_sketches) AS leaf
    JOIN quantiles q0 ON q0.level = 0
    JOIN quantiles q1 ON q1.level = 1 AND q1.rate = q0.rate AND q1.lang IS NOT DISTINCT FROM leaf.lang
    JOIN quantiles q2 ON q2.level = 2 AND q2.rate = q0.rate AND q2.lang IS NOT DISTINCT FROM leaf.lang
        AND q2.source IS NOT DISTINCT FROM leaf.source
),
drawn AS (
    SELECT lang, source, rate,
           (total * own25 + {PRIOR_ROWS} * q25) // (total + {PRIOR_ROWS}) AS q25,
           (total * own50 + {PRIOR_ROWS} * q50) // (total + {PRIOR_ROWS}) AS q50,
           (total * own75 + {PRIOR_ROWS} * q75) // (total + {PRIOR_ROWS}) AS q75
    FROM stacked
),
leaf_bounds AS (
    SELECT lang, source, rate,
           coalesce(CASE rate {_LOW} END, -1000000) AS low,
           q50 + 4 * (q75 - q50) + CASE rate {_SLACK} END AS high
    FROM drawn
),
doc_rates AS (
    UNPIVOT (SELECT doc_id, lang, source, {_RATE_COLUMNS} FROM measured WHERE NOT base_failed)
    ON {", ".join(n for n, *_ in RATES)} INTO NAME rate VALUE value
),
good AS (
    SELECT doc_id FROM doc_rates
    JOIN leaf_bounds ON leaf_bounds.rate = doc_rates.rate
        AND leaf_bounds.lang IS NOT DISTINCT FROM doc_rates.lang
        AND leaf_bounds.source IS NOT DISTINCT FROM doc_rates.source
    GROUP BY doc_id HAVING bool_and(value BETWEEN low AND high)
),
judged AS (
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           doc_id IN (SELECT doc_id FROM good) AS kept
    FROM measured
)"""

OP3 = f"""
WITH docs AS (SELECT doc_id, text, lang, source FROM documents), {QUALITY_CTES}
SELECT * FROM judged
"""

# Expects a relation `docs` (doc_id, text, source); gives `copied` with doc_id, size, source_size, target, copies.
MIX_CTES = f"""
m_sized AS (
    SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM docs
),
m_sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM m_sized GROUP BY source),
m_caps AS (
    SELECT source, source_size, 2 * source_size AS cap,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
    FROM m_sources
),
m_levels AS (
    SELECT *, cap::DOUBLE / weight AS ratio,
           row_number() OVER by_ratio AS place,
           (sum(source_size) OVER ()::DOUBLE * 1.5
               - coalesce(sum(cap) OVER (by_ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
               / (sum(weight) OVER (by_ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM m_caps WINDOW by_ratio AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)
),
m_first AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM m_levels WHERE level < ratio),
m_targets AS (
    SELECT source, source_size,
           CASE WHEN m_first.place IS NULL OR m_levels.place < m_first.place THEN cap::DOUBLE
                ELSE m_first.level * weight END AS target
    FROM m_levels CROSS JOIN m_first
),
m_needs AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END AS whole FROM m_targets
),
m_placed AS (
    SELECT doc_id, size, source_size, target, whole,
           target - whole * source_size::DOUBLE AS need,
           coalesce(sum(size) OVER (
               PARTITION BY m_sized.source ORDER BY md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), md5(coalesce(text, ''))
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM m_sized JOIN m_needs ON m_sized.source IS NOT DISTINCT FROM m_needs.source
),
copied AS (
    SELECT doc_id, size, source_size, target,
           whole::BIGINT + CASE WHEN need > 0 AND before + size / 2.0 <= need THEN 1 ELSE 0 END AS copies
    FROM m_placed
)"""

OP9 = f"""
WITH docs AS (SELECT doc_id, text, source FROM documents), {MIX_CTES}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM copied
"""

OP1 = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


OP13 = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           list_inner_product(a.v, c.v)::BIGINT AS score
    FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
),
positives AS (
    SELECT * FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id,
           row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank,
           p.score AS positive_score, n.score AS negative_score
    FROM positives p
    JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""


def _shrunk(name: str, source: str) -> str:
    """The posterior of one level: rows of `source` have n, bad and prior."""
    return f"""
{name}_strength AS (
    SELECT round(coalesce(CASE WHEN sum(n::DOUBLE) > 0 THEN least(greatest(1 / greatest(
        (sum(pow(bad - n::DOUBLE * prior, 2) / n::DOUBLE) - sum(prior * (1 - prior)))
            / greatest(sum(n::DOUBLE * prior * (1 - prior)) - sum(prior * (1 - prior)), 1e-12),
        1e-9) - 1, 1.0), 1000.0) ELSE 1000.0 END, 1000.0), 6) AS strength
    FROM {source} WHERE n > 0
),
{name} AS (
    SELECT {source}.*, strength, round((strength * prior + bad) / (strength + n), 9) AS rate
    FROM {source}, {name}_strength
)"""


OP5 = f"""
WITH rests AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
    SELECT page_id, {LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
           regexp_replace(regexp_replace(string_split(host, '@')[-1], '(:[0-9]*)?$', ''), '\\.$', '') AS site
    FROM rests
),
public(suffix) AS (VALUES {", ".join(f"('{s}')" for s in PUBLIC_SUFFIXES)}),
outcomes AS (
    SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id
),
counts AS (
    SELECT site, count(bad) AS n, coalesce(sum(bad), 0) AS bad
    FROM parts LEFT JOIN outcomes ON doc_id = page_id GROUP BY site
),
ends AS (
    SELECT counts.*, string_split(site, '.') AS labels,
           regexp_matches(site, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$|^\\[.*\\]$') AS numbers,
           coalesce((SELECT max(len(string_split(suffix, '.'))) FROM public WHERE suffix(site, '.' || public.suffix)
                     OR site = public.suffix), 1) AS k
    FROM counts
),
sites AS (
    SELECT site, n, bad,
           CASE WHEN numbers THEN site ELSE array_to_string(labels[-(k + 1):], '.') END AS domain,
           CASE WHEN numbers THEN '{ADDRESSES}' ELSE array_to_string(labels[-k:], '.') END AS suffix
    FROM ends
),
overall AS (SELECT coalesce(round((sum(bad) + 0.5) / (sum(n) + 1.0), 9), 0.5) AS prior FROM sites),
suffix_rows AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM sites, overall GROUP BY suffix),
{_shrunk("suffixes", "suffix_rows")},
domain_rows AS (
    SELECT domain, sites.suffix, sum(sites.n) AS n, sum(sites.bad) AS bad, any_value(suffixes.rate) AS prior
    FROM sites JOIN suffixes ON suffixes.suffix = sites.suffix GROUP BY ALL
),
{_shrunk("domains", "domain_rows")},
site_rows AS (
    SELECT site, sites.n, sites.bad, domains.rate AS prior
    FROM sites JOIN domains ON domains.domain = sites.domain AND domains.suffix = sites.suffix
),
{_shrunk("rated", "site_rows")},
bounds AS (
    SELECT site, round(rate - 1.645 * sqrt(rate * (1 - rate) / (strength + n + 1)), 6) AS low FROM rated
),
rules(verdict, rule, rule_host, rule_path) AS (
    VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
           ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
),
matched AS (
    SELECT host, path, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict
    FROM (SELECT DISTINCT host, path FROM parts) AS p
    JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
)
SELECT page_id, parts.host, parts.path, rule,
       coalesce(verdict, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts
LEFT JOIN matched ON matched.host = parts.host AND matched.path = parts.path
LEFT JOIN bounds ON bounds.site = parts.site
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13) || chr(9) || chr(11) || chr(12), 'abcdefghijklmnopqrstuvwxyz    ')"
    for line in (COPYRIGHT_LINE, RESERVED_LINE):
        out = f"regexp_replace({out}, '(?m){line}', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g'), ' +', ' ', 'g')"
    return _unified(out)


def _unified(text: str) -> str:
    for spelling, usual in SPELLINGS:
        text = f"replace({text}, '{spelling}', '{usual}')"
    return text


def _flat(form: str) -> str:
    flat = f"trim(regexp_replace({form}, '[ \\n]+', ' ', 'g'), ' ')"
    return f"sha256({_unified(flat)})"


_KNOWN = ", ".join(
    f"({_quoted(name)}, {_quoted(text)})"
    for name, text in [*((p.stem, p.read_text(encoding="utf-8")) for p in sorted(FOLDER.glob("*.txt"))), *NOTICES]
)
OP4 = f"""
WITH known(license_id, text) AS (VALUES {_KNOWN}),
digests AS (
    SELECT {_flat(_canonical("text"))} AS digest, min(license_id) AS license_id FROM known GROUP BY 1
),
forms AS (SELECT doc_id, {_canonical("coalesce(text, '')")} AS form FROM documents),
lines AS (SELECT doc_id, trim(unnest(string_split(form, chr(10))), ' ') AS line FROM forms),
named AS (
    SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
    FROM lines JOIN digests ON digest = sha256(line) WHERE line <> '' GROUP BY doc_id
)
SELECT forms.doc_id, license_id, coalesce(notices, '') AS notices
FROM forms
LEFT JOIN digests ON digest = {_flat("form")}
LEFT JOIN named ON named.doc_id = forms.doc_id
"""

STATEMENTS: dict[str, str] = {
    "op1_exact_top_k": OP1,
    "op3_quality_rules": OP3,
    "op4_license_scan": OP4,
    "op5_url_filter": OP5,
    "op7_minhash_near_dedup": OP7,
    "op9_source_mixing": OP9,
    "op13_hard_negatives": OP13,
}
