"""JSON request sources (S3, S4): a column of request bodies -> moderation contexts.

Fields bind as in the service's JSON decoder: keys match case-insensitively and the
last matching key wins (the body is read as an ordered map of key -> VARIANT).

Good and bad rows are both kept; bad rows carry ``error_code`` (E003) and the
service's error message. A field of the wrong JSON type is a binding error, as in
the service (Spark's own ``from_json`` would quietly turn ``123`` into "123", so
types are checked on the parsed VARIANT).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tamis import fixed


_OUT = ("text", "point", "app_id", "error_code", "error")


def _kept(df: DataFrame) -> list:
    """Input columns that the parsed fields do not replace."""
    return [F.col(f"`{c}`") for c in df.columns if c not in _OUT]


def _obj(col: str) -> Column:
    """The request as an ordered map of key -> VARIANT (NULL for bad JSON or a non-object)."""
    return F.from_json(F.col(f"`{col}`"), "map<string,variant>")


def _field(m: Column, name: str) -> Column:
    """A field as the service's JSON decoder binds it: keys match case-insensitively
    and the last matching key wins. VARIANT or NULL when absent."""
    hits = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == F.lit(name))
    return F.try_element_at(hits, F.lit(-1))["value"]


def _sub(v: Column) -> Column:
    """A nested object as a map (NULL when it is not an object)."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_str(v: Column) -> Column:
    """Absent, JSON null or a string: anything else fails binding to a string field."""
    k = F.schema_of_variant(v)
    return v.isNull() | k.isin("STRING", "VOID")


def _s(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def parse_standard(df: DataFrame, col: str = "request") -> DataFrame:
    """S3: adds text, point, app_id, error_code, error."""
    m = F.col("_m")
    tv, pv, av = _field(m, "text"), _field(m, "point"), _field(m, "app_id")
    bind_ok = m.isNotNull() & _is_str(tv) & _is_str(pv) & _is_str(av)
    text = F.coalesce(_s(tv), F.lit(""))
    point = F.coalesce(_s(pv), F.lit(""))
    err = (F.when(~bind_ok | (text == ""), F.lit(fixed.MSG_TEXT_REQUIRED))
           .when(~point.isin("", fixed.POINT_INPUT, fixed.POINT_OUTPUT), F.lit(fixed.MSG_BAD_POINT)))
    out = df.withColumn("_m", _obj(col)).withColumn("_err", err)
    return out.select(
        *_kept(df),
        F.when(F.col("_err").isNull(), text).alias("text"),
        F.when(F.col("_err").isNull(), F.when(point == fixed.POINT_OUTPUT, F.lit(fixed.POINT_OUTPUT))
               .otherwise(F.lit(fixed.POINT_INPUT))).alias("point"),
        F.when(F.col("_err").isNull(), F.coalesce(_s(av), F.lit(""))).alias("app_id"),
        F.when(F.col("_err").isNotNull(), F.lit(fixed.ERR_INVALID_INPUT)).alias("error_code"),
        F.col("_err").alias("error"))


def parse_dify(df: DataFrame, col: str = "request") -> DataFrame:
    """S4: Dify moderation extension requests -> text, point, app_id, error_code, error."""
    m = F.col("_m")
    pv, par = _field(m, "point"), _field(m, "params")
    pk = F.schema_of_variant(par)
    params_ok = par.isNull() | (pk == "VOID") | pk.startswith("OBJECT")
    pm = _sub(par)
    av, qv, xv = _field(pm, "app_id"), _field(pm, "query"), _field(pm, "text")
    bind_ok = m.isNotNull() & _is_str(pv) & params_ok & _is_str(av) & _is_str(qv) & _is_str(xv)
    point = F.coalesce(_s(pv), F.lit(""))
    is_in = point == fixed.DIFY_POINT_INPUT
    is_out = point == fixed.DIFY_POINT_OUTPUT
    text = F.coalesce(F.when(is_in, _s(qv)).otherwise(_s(xv)), F.lit(""))
    err = (F.when(~bind_ok, F.lit(fixed.MSG_BAD_BODY))
           .when(point == "", F.lit(fixed.MSG_POINT_REQUIRED))
           .when(~(is_in | is_out), F.concat(F.lit(fixed.MSG_UNSUPPORTED_POINT), point))
           .when(text == "", F.lit(fixed.MSG_TEXT_REQUIRED)))
    out = df.withColumn("_m", _obj(col)).withColumn("_err", err)
    ok = F.col("_err").isNull()
    return out.select(
        *_kept(df),
        F.when(ok, text).alias("text"),
        F.when(ok, F.when(is_in, F.lit(fixed.POINT_INPUT)).otherwise(F.lit(fixed.POINT_OUTPUT))).alias("point"),
        F.when(ok, F.coalesce(_s(av), F.lit(""))).alias("app_id"),
        F.when(~ok, F.lit(fixed.ERR_INVALID_INPUT)).alias("error_code"),
        F.col("_err").alias("error"))
