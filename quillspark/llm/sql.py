"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .license_scan import CONTAINED, TEMPLATES, template_shingles
from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS


def _verdict() -> str:
    checks = []
    for r in RULES:
        if r.low is not None:
            checks.append(f"{r.numerator}::DOUBLE >= {r.denominator} * {r.low!r}::DOUBLE")
        if r.high is not None:
            checks.append(f"{r.numerator}::DOUBLE <= {r.denominator} * {r.high!r}::DOUBLE")
    return " AND ".join(checks)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
             len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x))::BIGINT AS n_upper_words,
             coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM w LEFT JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM f)
SELECT *, NOT base_failed AND {_verdict()} AS kept FROM b
"""

_SHINGLES = ", ".join(f"({t}, '{name}', '{s}')" for t, (name, text) in enumerate(TEMPLATES) for s in template_shingles(text))

OP2 = rf"""
WITH t(t, name, s) AS (VALUES {_SHINGLES}),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
n AS (SELECT doc_id, t.t, t.name, count(*) AS n FROM d JOIN t USING (s) GROUP BY ALL),
k AS (SELECT DISTINCT doc_id, name FROM n JOIN (SELECT t, count(*) AS k FROM t GROUP BY t) USING (t) WHERE n >= k * {CONTAINED}),
a AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS l FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(l, '') AS licenses FROM documents LEFT JOIN a USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_licenses": OP2, "op10_quality_rules": OP10}
