"""Times as integers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def micros(c: str, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ column."""
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
    return F.unix_micros(c)
