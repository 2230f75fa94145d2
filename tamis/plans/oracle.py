"""DuckDB oracle SQL for the driver queries (tables are pre-registered views).

Written independently of the Spark plans: occurrences come from chunked
``substr`` scans, regexes run on RE2 (the reference's dialect), policies are
plain GROUP BY / window SQL.
"""

from tamis import fixed

W_HIGH, W_MED, W_LOW = (int(round(fixed.SEVERITY_WEIGHTS[k] * 1_000_000)) for k in ("high", "medium", "low"))
EMAIL = next(r for r in fixed.DEFAULT_RULES if r[0] == "email_pattern")
_C = 256  # chunk size of the oracle's occurrence scan


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rules_values_sql(rules=fixed.DEFAULT_RULES, alias: str = "rules") -> str:
    vals = ", ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in rules)
    return f"{alias}(name, pattern, type, severity, action) AS (VALUES {vals})"


def kw_hits_cte(table: str = "documents", id_col: str = "doc_id", text_col: str = "text",
                bank: str = "bank") -> str:
    """CTE ``kw`` (id, word, type, severity, action, idx, len): every occurrence."""
    return f"""
pairs AS (
  SELECT t.{id_col} AS id, t.{text_col} AS text, b.word, b.type, b.severity, b.action
  FROM {table} t JOIN {bank} b ON contains(t.{text_col}, b.word)),
chunks AS (
  SELECT id, word, type, severity, action, k,
         substr(text, k * {_C} + 1, {_C - 1} + length(word)) AS c
  FROM (SELECT *, unnest(range(0, (length(text) - 1) // {_C} + 1)) AS k FROM pairs)),
kw AS (
  SELECT id, word, type, severity, action, CAST(k * {_C} + i - 1 AS INTEGER) AS idx,
         CAST(length(word) AS INTEGER) AS len
  FROM (SELECT *, unnest(range(1, {_C + 1})) AS i FROM chunks)
  WHERE i <= length(c) AND substr(c, i, length(word)) = word)"""


def weight_case(col: str = "severity") -> str:
    return (f"CASE {col} WHEN 'high' THEN {W_HIGH} WHEN 'medium' THEN {W_MED} "
            f"WHEN 'low' THEN {W_LOW} ELSE 0 END")


def email_cte(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    p = _q(EMAIL[1])
    return f"""
em AS (
  SELECT {id_col} AS id, {_q(EMAIL[0])} AS word, {_q(EMAIL[2])} AS type, {_q(EMAIL[3])} AS severity,
         {_q(EMAIL[4])} AS action,
         CAST(length(regexp_extract({text_col}, '^((?s:.*?))(?:' || {p} || ')', 1)) AS INTEGER) AS idx,
         CAST(length(regexp_extract({text_col}, {p}, 0)) AS INTEGER) AS len
  FROM {table} WHERE regexp_matches({text_col}, {p}))"""


def regex_first_sql(table, id_col, text_col, values_cte, name_col, with_count=False) -> str:
    cnt = (", CAST(len(regexp_extract_all(t.{tc}, r.pattern)) AS INTEGER) AS n_matches"
           .format(tc=text_col)) if with_count else ""
    return f"""
WITH {values_cte}
SELECT t.{id_col} AS id, r.{name_col} AS word, r.type, r.severity,
       CAST(length(regexp_extract(t.{text_col}, '^((?s:.*?))(?:' || r.pattern || ')', 1)) AS INTEGER) AS idx,
       CAST(length(regexp_extract(t.{text_col}, r.pattern, 0)) AS INTEGER) AS len{cnt}
FROM {table} t JOIN r ON regexp_matches(t.{text_col}, r.pattern)"""
