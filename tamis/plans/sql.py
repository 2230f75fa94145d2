"""Oracle SQL (DuckDB) for each driver query."""

from __future__ import annotations

from tamis import fixed
from tamis.functions.text import _fullwidth_tables
from tamis.plans import queries as Q
from tamis.plans.history import sql as _history_sql
from tamis.plans.large_bank import BANK_SQL, sql as _large_bank_sql
from tamis.plans.tables import sql as _tables_sql
from tamis.plans.fixtures import DOC_BANK, REGEX_BANK_VALID, bank_values_sql
from tamis.plans.oracle import (_q, kw_hits_cte, email_cte, weight_case, regex_first_sql, rules_values_sql,
                                W_MED)

BANK = bank_values_sql(DOC_BANK)
RANK = ("CASE {c} WHEN 'block' THEN 4 WHEN 'mask' THEN 3 WHEN 'review' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END")
UNRANK = "CASE {c} WHEN 4 THEN 'block' WHEN 3 THEN 'mask' WHEN 2 THEN 'review' WHEN 1 THEN 'pass' END"


def _doc_kw() -> str:
    return f"WITH {BANK},{kw_hits_cte()}"


SQL: dict[str, str] = {}

SQL["keyword_hits"] = _doc_kw() + "\nSELECT id AS doc_id, word, type, severity, idx, len FROM kw"

SQL["keyword_first"] = f"""WITH {BANK}
SELECT d.doc_id, b.word, b.type, b.severity, CAST(instr(d.text, b.word) - 1 AS INTEGER) AS idx,
       CAST(length(b.word) AS INTEGER) AS len
FROM documents d JOIN bank b ON contains(d.text, b.word)"""

SQL["regex_bank_hits"] = regex_first_sql(
    "documents", "doc_id", "text",
    "r(pattern, type, severity, action) AS (VALUES " + ", ".join(
        "(" + ", ".join(_q(v) for v in row) + ")" for row in REGEX_BANK_VALID) + ")",
    "pattern").replace("SELECT t.doc_id AS id,", "SELECT t.doc_id AS doc_id,")

SQL["rule_hits"] = regex_first_sql("documents", "doc_id", "text", rules_values_sql(alias="r"), "name",
                                   with_count=True) \
    .replace("SELECT t.doc_id AS id, r.name AS word,", "SELECT t.doc_id AS doc_id, r.name AS rule,")

SQL["rule_hits_pages"] = regex_first_sql("pages", "page_id", "html", rules_values_sql(alias="r"), "name",
                                         with_count=True) \
    .replace("SELECT t.page_id AS id, r.name AS word,", "SELECT t.page_id AS page_id, r.name AS rule,")

_CHAIN = _doc_kw() + "," + email_cte() + """,
k AS (SELECT id, count(*) AS n FROM kw GROUP BY id)"""

SQL["chain_verdict"] = _CHAIN + """
SELECT d.doc_id, (k.n IS NOT NULL OR em.id IS NOT NULL) AS flagged,
       CASE WHEN k.n IS NOT NULL OR em.id IS NOT NULL THEN 'block' ELSE 'pass' END AS action,
       CAST(CASE WHEN k.n IS NOT NULL THEN k.n WHEN em.id IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_hits,
       CASE WHEN k.n IS NOT NULL THEN 'keyword' WHEN em.id IS NOT NULL THEN 'rules' END AS decided_by
FROM documents d LEFT JOIN k ON k.id = d.doc_id LEFT JOIN em ON em.id = d.doc_id"""

SQL["parallel_verdict"] = _doc_kw() + "," + email_cte() + """,
f AS (SELECT id, word, min(idx) AS idx FROM kw GROUP BY id, word
      UNION ALL SELECT id, word, idx FROM em),
g AS (SELECT id, count(*) AS n, string_agg(word, ',' ORDER BY word) AS words, sum(idx) AS s FROM f GROUP BY id)
SELECT d.doc_id, g.n IS NOT NULL AS flagged, CASE WHEN g.n IS NOT NULL THEN 'block' ELSE 'pass' END AS action,
       CAST(coalesce(g.n, 0) AS BIGINT) AS n_hits, coalesce(g.words, '') AS words,
       CAST(coalesce(g.s, 0) AS BIGINT) AS idx_sum
FROM documents d LEFT JOIN g ON g.id = d.doc_id"""

SQL["weighted_verdict"] = _doc_kw() + "," + email_cte() + f""",
s AS (SELECT id, sum(w) AS m FROM (SELECT id, {weight_case()} AS w FROM kw
                                   UNION ALL SELECT id, {W_MED} AS w FROM em) GROUP BY id)
SELECT d.doc_id, coalesce(s.m, 0) > 500000 AS flagged,
       CASE WHEN coalesce(s.m, 0) > 500000 THEN 'block' ELSE 'pass' END AS action,
       CAST(coalesce(s.m, 0) AS BIGINT) / 1000000.0 AS score
FROM documents d LEFT JOIN s ON s.id = d.doc_id"""

SQL["declared_action"] = _CHAIN + f""",
ch AS (SELECT id, action FROM kw UNION ALL SELECT id, action FROM em WHERE id NOT IN (SELECT id FROM kw)),
r AS (SELECT id, max({RANK.format(c='action')}) AS r FROM ch GROUP BY id)
SELECT d.doc_id, {UNRANK.format(c='r.r')} AS declared FROM documents d LEFT JOIN r ON r.id = d.doc_id"""

SQL["redact_counts"] = _doc_kw() + """,
sp AS (SELECT id, idx AS s, idx + len AS e FROM kw WHERE len > 0),
pm AS (SELECT id, s, e, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                        AS pmax FROM sp),
isl AS (SELECT id, s, e, sum(CASE WHEN pmax IS NULL OR s > pmax THEN 1 ELSE 0 END)
                          OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM pm),
iv AS (SELECT id, k, min(s) AS s, max(e) AS e FROM isl GROUP BY id, k),
agg AS (SELECT id, sum(e - s) AS n_masked, count(*) AS n_islands FROM iv GROUP BY id),
lg AS (SELECT id, k, s, e, lag(e, 1, 0) OVER (PARTITION BY id ORDER BY k) AS pe FROM iv),
mt AS (SELECT lg.id, string_agg(substr(t.text, CAST(pe + 1 AS BIGINT), CAST(s - pe AS BIGINT)) || repeat('*', CAST(e - s AS BIGINT)), '' ORDER BY k)
                     || substr(any_value(t.text), CAST(max(e) + 1 AS BIGINT)) AS m
       FROM lg JOIN documents t ON t.doc_id = lg.id GROUP BY lg.id)
SELECT d.doc_id, CAST(coalesce(agg.n_masked, 0) AS INTEGER) AS n_masked,
       CAST(coalesce(agg.n_islands, 0) AS INTEGER) AS n_islands, CAST(length(d.text) AS INTEGER) AS masked_len,
       md5(coalesce(mt.m, d.text)) AS masked_md5
FROM documents d LEFT JOIN agg ON agg.id = d.doc_id LEFT JOIN mt ON mt.id = d.doc_id"""

_CONV = f"""WITH {BANK},
ctx AS (SELECT conv_id * 1000 + turn AS id, text,
               CASE WHEN role = 'assistant' THEN 'output' ELSE 'input' END AS point FROM conversations),
{kw_hits_cte('ctx', 'id', 'text')[1:]}"""

SQL["conversation_points"] = _CONV + """,
k AS (SELECT id, count(*) AS n FROM kw GROUP BY id)
SELECT c.point, count(*) AS n_turns, count(k.n) AS n_flagged, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS n_hits
FROM ctx c LEFT JOIN k ON k.id = c.id GROUP BY c.point"""

_SRC, _DST = _fullwidth_tables()
SQL["normalize_text"] = f"""
SELECT doc_id, md5(x) AS h, CAST(length(x) AS INTEGER) AS n
FROM (SELECT doc_id, translate(text || {_q(Q.NORMALIZE_PROBE)}, {_q(_SRC)}, {_q(_DST)}) AS x FROM documents)"""

SQL["is_ascii"] = "SELECT doc_id, strlen(text) = length(text) AS is_ascii FROM documents"

SQL["mask_head"] = """
SELECT doc_id, md5(m) AS h, CAST(length(m) AS INTEGER) AS n FROM (
  SELECT doc_id, CASE WHEN s >= e THEN text ELSE substr(text, 1, s) || repeat('*', e - s) || substr(text, e + 1) END AS m
  FROM (SELECT doc_id, text, greatest(CAST(doc_id % 7 - 2 AS INTEGER), 0) AS s,
               least(CAST((doc_id % 13) * 3 - 1 AS INTEGER), length(text)) AS e FROM documents))"""

_ANY = " OR ".join(f"contains(text, {_q(r[0])})" for r in DOC_BANK)
_RARE = " OR ".join(f"contains(text, {_q(w)})" for w in Q.RARE)
SQL["contains_any"] = f"SELECT doc_id, ({_ANY}) AS any_word, ({_RARE}) AS any_rare FROM documents"

_WORDS = "(VALUES " + ", ".join(f"({i}, {_q(r[0])})" for i, r in enumerate(DOC_BANK)) + ") w(ord, word)"
SQL["first_match"] = f"""
WITH c AS (SELECT d.doc_id, instr(d.text, w.word) - 1 AS idx, w.ord, w.word
           FROM documents d, {_WORDS} WHERE instr(d.text, w.word) > 0),
b AS (SELECT doc_id, min(idx) AS idx, arg_min(word, idx * 1000 + ord) AS word FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(b.idx, -1) AS INTEGER) AS idx, coalesce(b.word, '') AS word
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id"""

_TOK = """tok AS (SELECT doc_id, token FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents)
        WHERE token <> '')"""

SQL["bank_lookup"] = f"""WITH {BANK}, {_TOK}
SELECT t.doc_id, b.type, count(*) AS n FROM tok t LEFT JOIN bank b ON b.word = t.token GROUP BY t.doc_id, b.type"""

SQL["bank_semi"] = f"""WITH {BANK}, {_TOK}
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT t.doc_id FROM tok t JOIN bank b ON b.word = t.token)"""

SQL["bank_anti"] = f"""WITH {BANK}, {_TOK}
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT t.doc_id FROM tok t JOIN bank b ON b.word = t.token)"""

SQL["bank_by_type"] = f"""WITH {BANK},
per AS (SELECT b.type, count(DISTINCT d.doc_id) AS n_docs FROM documents d JOIN bank b ON contains(d.text, b.word)
        GROUP BY b.type)
SELECT b.type, CAST(count(*) AS BIGINT) AS n_words, string_agg(b.word, ',' ORDER BY b.word) AS words,
       CAST(coalesce(any_value(per.n_docs), 0) AS BIGINT) AS n_docs
FROM bank b LEFT JOIN per ON per.type = b.type WHERE b.type <> '' GROUP BY b.type"""

SQL["bank_size"] = f"""SELECT CAST({len(DOC_BANK)} AS BIGINT) AS n_words, CAST(count_if({_ANY}) AS BIGINT) AS n_docs_any FROM documents"""

# expected parse of tamis/data/doc_bank.csv: comments, blank line, padded fields,
# a blank word, a repeated word (last wins), two malformed rows, a quoted comma
_CSV_BANK = [r if r[0] != "eau" else ("eau", "lang_fr", "low", "review") for r in DOC_BANK] + \
    [("q,uo", "t", "low", "pass"), ('the "x" y', "t", "low", "pass"), ("two\nlines", "t", "low", "pass")]
SQL["word_bank_csv"] = f"""WITH {bank_values_sql(_CSV_BANK)},
per AS (SELECT b.word, count(DISTINCT d.doc_id) AS n_docs FROM documents d JOIN bank b ON contains(d.text, b.word)
        GROUP BY b.word)
SELECT b.word, b.type, b.severity, b.action, CAST(coalesce(per.n_docs, 0) AS BIGINT) AS n_docs,
       CAST(2 AS BIGINT) AS n_bad
FROM bank b LEFT JOIN per ON per.word = b.word"""

# ----------------------------------------------------------------------- requests / responses

_STD_REQ = """req AS (
  SELECT conv_id * 1000 + turn AS id, CAST(CASE turn % 5
    WHEN 0 THEN json_object('text', text, 'point', 'input', 'app_id', 'app-' || conv_id)
    WHEN 1 THEN json_object('text', text, 'point', 'output')
    WHEN 2 THEN json_object('text', text, 'point', role)
    WHEN 3 THEN json_object('point', 'input')
    ELSE json_object('text', length(text)) END AS VARCHAR) AS request
  FROM conversations)"""

_STD_PARSE = _STD_REQ + f""",
p AS (
  SELECT id, request, json_valid(request) AND json_type(request) = 'OBJECT' AS is_obj,
         coalesce(json_type(request, '$.text'), 'NULL') IN ('VARCHAR', 'NULL')
         AND coalesce(json_type(request, '$.point'), 'NULL') IN ('VARCHAR', 'NULL')
         AND coalesce(json_type(request, '$.app_id'), 'NULL') IN ('VARCHAR', 'NULL') AS types_ok,
         coalesce(json_extract_string(request, '$.text'), '') AS text,
         coalesce(json_extract_string(request, '$.point'), '') AS point,
         coalesce(json_extract_string(request, '$.app_id'), '') AS app_id
  FROM req),
e AS (
  SELECT *, CASE WHEN NOT (is_obj AND types_ok) OR text = '' THEN {_q(fixed.MSG_TEXT_REQUIRED)}
                 WHEN point NOT IN ('', 'input', 'output') THEN {_q(fixed.MSG_BAD_POINT)} END AS err
  FROM p),
parsed AS (
  SELECT id, CASE WHEN err IS NULL THEN text END AS text,
         CASE WHEN err IS NULL THEN CASE WHEN point = 'output' THEN 'output' ELSE 'input' END END AS point,
         CASE WHEN err IS NULL THEN app_id END AS app_id,
         CASE WHEN err IS NOT NULL THEN {_q(fixed.ERR_INVALID_INPUT)} END AS error_code, err AS error
  FROM e)"""

SQL["parse_standard"] = "WITH " + _STD_PARSE + "\nSELECT * FROM parsed"

_DIFY_REQ = f"""req AS (
  SELECT conv_id * 1000 + turn AS id, CAST(CASE turn % 5
    WHEN 0 THEN json_object('point', {_q(fixed.DIFY_POINT_INPUT)}, 'params', json_object('app_id', 'app-' || conv_id, 'query', text))
    WHEN 1 THEN json_object('point', {_q(fixed.DIFY_POINT_OUTPUT)}, 'params', json_object('text', text))
    WHEN 2 THEN json_object('point', 'app.moderation.' || role)
    WHEN 3 THEN json_object('params', json_object('query', text))
    ELSE json_object('point', {_q(fixed.DIFY_POINT_INPUT)}, 'params', json_object('text', text)) END AS VARCHAR) AS request
  FROM conversations)"""


def _vs(path):
    return f"coalesce(json_type(request, '{path}'), 'NULL') IN ('VARCHAR', 'NULL')"


_DIFY_PARSE = _DIFY_REQ + f""",
p AS (
  SELECT id, json_valid(request) AND json_type(request) = 'OBJECT'
         AND {_vs('$.point')} AND coalesce(json_type(request, '$.params'), 'NULL') IN ('OBJECT', 'NULL')
         AND {_vs('$.params.app_id')} AND {_vs('$.params.query')} AND {_vs('$.params.text')} AS bind_ok,
         coalesce(json_extract_string(request, '$.point'), '') AS point,
         coalesce(CASE WHEN json_extract_string(request, '$.point') = {_q(fixed.DIFY_POINT_INPUT)}
                       THEN json_extract_string(request, '$.params.query')
                       ELSE json_extract_string(request, '$.params.text') END, '') AS text,
         coalesce(json_extract_string(request, '$.params.app_id'), '') AS app_id
  FROM req),
e AS (
  SELECT *, CASE WHEN NOT bind_ok THEN {_q(fixed.MSG_BAD_BODY)}
                 WHEN point = '' THEN {_q(fixed.MSG_POINT_REQUIRED)}
                 WHEN point NOT IN ({_q(fixed.DIFY_POINT_INPUT)}, {_q(fixed.DIFY_POINT_OUTPUT)})
                   THEN {_q(fixed.MSG_UNSUPPORTED_POINT)} || point
                 WHEN text = '' THEN {_q(fixed.MSG_TEXT_REQUIRED)} END AS err
  FROM p),
parsed AS (
  SELECT id, CASE WHEN err IS NULL THEN text END AS text,
         CASE WHEN err IS NULL THEN CASE WHEN point = {_q(fixed.DIFY_POINT_INPUT)} THEN 'input' ELSE 'output' END END AS point,
         CASE WHEN err IS NULL THEN app_id END AS app_id,
         CASE WHEN err IS NOT NULL THEN {_q(fixed.ERR_INVALID_INPUT)} END AS error_code, err AS error
  FROM e)"""

SQL["parse_dify"] = "WITH " + _DIFY_PARSE + "\nSELECT * FROM parsed"


def _render_dify_sql(documented: bool) -> str:
    if documented:
        flagged = (f"json_object('flagged', true, 'action', {_q(fixed.DIFY_DOC_ACTION_FLAGGED)}, "
                   f"'preset_response', {_q(fixed.DIFY_DOC_PRESET)})")
        clean = f"json_object('flagged', false, 'action', {_q(fixed.DIFY_ACTION)}, 'preset_response', '')"
    else:
        flagged = (f"json_object('flagged', true, 'action', {_q(fixed.DIFY_ACTION)}, "
                   f"'preset_response', {_q(fixed.DIFY_PRESET)})")
        clean = f"json_object('flagged', false, 'action', {_q(fixed.DIFY_ACTION)})"
    return f"WITH {BANK}, " + _DIFY_PARSE + "," + kw_hits_cte("parsed", "id", "text")[1:] + f""",
k AS (SELECT id, count(*) AS n FROM kw GROUP BY id)
SELECT p.id, CAST(CASE WHEN p.error IS NOT NULL THEN json_object('error', p.error)
                       WHEN k.n IS NOT NULL THEN {flagged} ELSE {clean} END AS VARCHAR) AS response
FROM parsed p LEFT JOIN k ON k.id = p.id"""


SQL["render_dify"] = _render_dify_sql(False)
SQL["render_dify_documented"] = _render_dify_sql(True)

SQL["render_standard"] = f"WITH {BANK}, " + _STD_PARSE + "," + kw_hits_cte("parsed", "id", "text")[1:] + """,
h AS (SELECT id, to_json(list(json_object('word', word, 'type', type, 'severity', severity, 'index', idx,
                                           'length', len) ORDER BY idx + len, len DESC, word)) AS hits
      FROM kw GROUP BY id)
SELECT p.id, CAST(CASE WHEN p.error IS NOT NULL THEN json_object('error', p.error)
                       WHEN h.hits IS NOT NULL THEN json_object('flagged', true, 'action', 'block', 'hits', h.hits)
                       ELSE json_object('flagged', false, 'action', 'pass', 'hits', json('[]')) END AS VARCHAR) AS response
FROM parsed p LEFT JOIN h ON h.id = p.id"""

# ----------------------------------------------------------------------- reports

SQL["hit_counts"] = _doc_kw() + """
SELECT type, severity, count(*) AS n_hits, count(DISTINCT id) AS n_texts FROM kw GROUP BY type, severity"""

SQL["hit_counts_rollup"] = _doc_kw() + """
SELECT type, word, CAST(GROUPING(type, word) AS INTEGER) AS gid, count(*) AS n_hits, count(DISTINCT id) AS n_texts
FROM kw GROUP BY ROLLUP(type, word)"""

SQL["top_words"] = _doc_kw() + """
SELECT type, word, n, CAST(rk AS INTEGER) AS rk FROM (
  SELECT type, word, count(*) AS n, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, word) AS rk
  FROM kw GROUP BY type, word) WHERE rk <= 2"""

SQL["gauge_last"] = """
SELECT user_id, first(value ORDER BY ts DESC, event_id DESC) AS last_value, count(*) AS n_events
FROM events GROUP BY user_id"""

SQL["gauge_level"] = """
SELECT event_id, user_id, event_type, CAST(sum(CAST(value AS DECIMAL(38,9))) OVER (
         PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS level
FROM events"""


def _hist_sql() -> str:
    from tamis.plans.fixtures import VALUE_BUCKETS
    cols = []
    for b in sorted(VALUE_BUCKETS):
        name = ("le_" + (str(int(b)) if float(b).is_integer() else str(b))).replace(".", "_")
        cols.append(f"CAST(count_if(value <= {float(b)}) AS BIGINT) AS {name}")
    return ("SELECT event_type, " + ", ".join(cols) +
            ", count(value) AS le_inf, CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE) AS sum, count(*) AS count"
            " FROM events GROUP BY event_type")


SQL["value_histogram"] = _hist_sql()

SQL["flag_rate_windows"] = """
SELECT CAST(epoch(b) AS BIGINT) AS window_start, count(*) AS n_events,
       CAST(count_if(event_type = 'error') AS BIGINT) AS n_flagged,
       CAST(count_if(event_type = 'error') AS BIGINT) / count(*) AS rate
FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS b, event_type FROM events) GROUP BY b"""

SQL["flag_rate_sliding"] = """
SELECT CAST(epoch(b) AS BIGINT) AS window_start, count(*) AS n_events,
       CAST(count_if(event_type = 'error') AS BIGINT) AS n_flagged,
       CAST(count_if(event_type = 'error') AS BIGINT) / count(*) AS rate
FROM (SELECT time_bucket(INTERVAL 1 hour, ts) - to_hours(k) AS b, event_type FROM events, range(0, 3) t(k))
GROUP BY b"""

# ----------------------------------------------------------------------- streams and user matchers

SQL["stream_moderate"] = SQL["chain_verdict"]
SQL["custom_matcher"] = SQL["keyword_first"]


def _quota_sql() -> str:
    from tamis.plans.fixtures import QUOTA_RATE, QUOTA_CAPACITY
    rate, cap = repr(float(QUOTA_RATE)), f"CAST({float(QUOTA_CAPACITY)} AS DOUBLE)"

    def adv(tok, last, has):
        d = f"(e.t - {last})"
        return (f"CASE WHEN {has} THEN least({cap}, {tok} + (CAST({d} // 1000000000 AS DOUBLE) "
                f"+ CAST({d} % 1000000000 AS DOUBLE) / 1e9) * CAST({rate} AS DOUBLE)) ELSE {cap} END")

    ok = ("(a - 1.0 >= 0 OR ({r} > 0 AND CAST(trunc(1e9 * (-(a - 1.0) / CAST({r} AS DOUBLE))) AS BIGINT) = 0))"
          .format(r=rate))
    if QUOTA_CAPACITY < 1:
        ok = "false"
    return f"""
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, epoch_ns(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
st AS (
  SELECT user_id, rn, event_id, ok AS admitted,
         CAST(CASE WHEN ok THEN a - 1.0 ELSE 0.0 END AS DOUBLE) AS tokens,
         CASE WHEN ok THEN t ELSE 0 END AS last_t, ok AS has
  FROM (SELECT e.*, {cap} AS a FROM ev e WHERE rn = 1) x, LATERAL (SELECT {ok} AS ok)
  UNION ALL
  SELECT user_id, rn, event_id, ok, CASE WHEN ok THEN a - 1.0 ELSE tokens END,
         CASE WHEN ok THEN t ELSE last_t END, has OR ok
  FROM (SELECT e.user_id, e.rn, e.event_id, e.t, s.tokens, s.last_t, s.has,
               {adv('s.tokens', 's.last_t', 's.has')} AS a
        FROM st s JOIN ev e ON e.user_id = s.user_id AND e.rn = s.rn + 1) y, LATERAL (SELECT {ok} AS ok))
SELECT event_id, user_id, admitted FROM st"""


SQL["quota_audit"] = _quota_sql()


def _reload_sql() -> str:
    from tamis.streaming.moderate import bank_version
    rows = [dict(word=w, type=t, severity=s, action=a) for (w, t, s, a) in _CSV_BANK]
    ver = bank_version(rows)
    return f"""WITH {bank_values_sql(_CSV_BANK)},{kw_hits_cte()},
k AS (SELECT id, count(*) AS n FROM kw GROUP BY id)
SELECT d.doc_id, k.n IS NOT NULL AS flagged, CASE WHEN k.n IS NOT NULL THEN 'block' ELSE 'pass' END AS action,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_hits, {_q(ver)} AS bank_version
FROM documents d LEFT JOIN k ON k.id = d.doc_id"""


SQL["stream_reload"] = _reload_sql()

SQL["quota_audit_stream"] = SQL["quota_audit"]

SQL["severity_weights"] = """
SELECT s AS severity, count(*) AS n, CAST(sum(CASE s WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.2 ELSE 0.0 END * 10) AS BIGINT) AS tenths
FROM (SELECT ['low', 'medium', 'high', 'critical'][CAST(event_id % 4 AS INTEGER) + 1] AS s FROM events) GROUP BY s"""

SQL["bank_words"] = "WITH " + BANK_SQL + "\nSELECT word, type, severity, action FROM bank"

SQL["null_text_fallback"] = f"WITH {BANK}, t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS text FROM documents)" + """
SELECT doc_id, CASE WHEN text IS NULL THEN false ELSE EXISTS (SELECT 1 FROM bank b WHERE contains(t.text, b.word)) END AS flagged,
       CASE WHEN text IS NULL THEN 'block' WHEN EXISTS (SELECT 1 FROM bank b WHERE contains(t.text, b.word)) THEN 'block' ELSE 'pass' END AS action
FROM t"""

SQL |= _large_bank_sql(SQL, BANK)
SQL |= _tables_sql(SQL)
SQL |= _history_sql(SQL, BANK_SQL)
