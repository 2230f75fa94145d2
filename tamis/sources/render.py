"""Result sinks (S5, S6): verdict rows -> JSON response bodies (documented lower-case keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tamis import fixed


def render_standard(flagged, action: Column | None = None, hits: Column | None = None):
    """S5: {"flagged", "action", "hits": [{"word","type","severity","index","length"}]}.

    ``hits`` keeps its order (the policies give the reference's order); empty -> [].
    Given a results DataFrame (``moderate()`` output) returns (id, response).
    """
    if isinstance(flagged, DataFrame):
        r = flagged
        return r.select("id", render_standard(F.col("flagged"), F.col("action"), F.col("hits")).alias("response"))
    hs = F.transform(hits, lambda h: F.struct(h["word"].alias("word"), h["type"].alias("type"),
                                              h["severity"].alias("severity"), h["idx"].alias("index"),
                                              h["len"].alias("length")))
    return F.to_json(F.struct(flagged.alias("flagged"), action.alias("action"),
                              F.coalesce(hs, F.array()).alias("hits")))


def render_dify(flagged, preset: str = fixed.DIFY_PRESET, style: str = "code"):
    """S6: {"flagged", "action", "preset_response"}.

    ``style="code"``: action is always "direct_output"; preset only when flagged (a
    NULL field is left out, like ``omitempty``). ``style="documented"``: flagged ->
    "overridden" with the documented preset, clean -> "direct_output" and "".
    Given a results DataFrame returns (id, response).
    """
    if isinstance(flagged, DataFrame):
        return flagged.select("id", render_dify(F.col("flagged"), preset, style).alias("response"))
    if style == "documented":
        doc_preset = fixed.DIFY_DOC_PRESET if preset == fixed.DIFY_PRESET else preset
        return F.to_json(F.struct(
            flagged.alias("flagged"),
            F.when(flagged, F.lit(fixed.DIFY_DOC_ACTION_FLAGGED)).otherwise(F.lit(fixed.DIFY_ACTION)).alias("action"),
            F.when(flagged, F.lit(doc_preset)).otherwise(F.lit("")).alias("preset_response")))
    return F.to_json(F.struct(flagged.alias("flagged"), F.lit(fixed.DIFY_ACTION).alias("action"),
                              F.when(flagged, F.lit(preset)).alias("preset_response")))
