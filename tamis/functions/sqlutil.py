"""Building config-size literals (banks, rule packs) into a plan.

A literal built with ``array(named_struct(...))`` is folded once by Catalyst into
one constant and shipped with the task binary, like a broadcast. Callers check the
size before they build one.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sql_str(s: str | None) -> str:
    """A Spark SQL string literal for ``s`` (NULL for None)."""
    if s is None:
        return "CAST(NULL AS STRING)"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}L" if abs(v) > 2**31 - 1 else str(v)
    if isinstance(v, float):
        return repr(v) + "D"
    return sql_str(str(v))


def literal_rows(rows: list[dict], ddl_fields: list[tuple[str, str]]) -> Column:
    """``array<struct>`` literal from dict rows; ``ddl_fields`` = [(name, sql type)]."""
    elem = "struct<" + ",".join(f"{n}:{t}" for n, t in ddl_fields) + ">"
    if not rows:
        return F.expr(f"CAST(array() AS array<{elem}>)")
    parts = []
    for r in rows:
        kv = ", ".join(f"'{n}', CAST({_sql_value(r.get(n))} AS {t})" for n, t in ddl_fields)
        parts.append(f"named_struct({kv})")
    return F.expr("array(" + ", ".join(parts) + ")")
