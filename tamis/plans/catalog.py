"""Name -> query callable, and name -> oracle SQL (for the driver contract)."""

from __future__ import annotations

from tamis.plans import queries as Q
from tamis.plans.history import QUERIES as HISTORY
from tamis.plans.large_bank import QUERIES as LARGE
from tamis.plans.tables import QUERIES as TABLES


def queries() -> dict:
    return {
        "keyword_hits": Q.keyword_hits,
        "keyword_first": Q.keyword_first,
        "regex_bank_hits": Q.regex_bank_hits,
        "rule_hits": Q.rule_hits,
        "rule_hits_pages": Q.rule_hits_pages,
        "chain_verdict": Q.chain_verdict,
        "parallel_verdict": Q.parallel_verdict,
        "weighted_verdict": Q.weighted_verdict,
        "declared_action": Q.declared,
        "redact_counts": Q.redact_counts,
        "conversation_points": Q.conversation_points,
        "normalize_text": Q.normalize_text,
        "is_ascii": Q.is_ascii_q,
        "mask_head": Q.mask_head,
        "contains_any": Q.contains_any_q,
        "first_match": Q.first_match_q,
        "bank_lookup": Q.bank_lookup,
        "bank_semi": Q.bank_semi,
        "bank_anti": Q.bank_anti,
        "bank_by_type": Q.bank_by_type,
        "bank_size": Q.bank_size_q,
        "word_bank_csv": Q.word_bank_csv,
        "parse_standard": Q.parse_standard_q,
        "parse_dify": Q.parse_dify_q,
        "render_standard": Q.render_standard_q,
        "render_dify": Q.render_dify_q,
        "render_dify_documented": Q.render_dify_documented,
        "hit_counts": Q.hit_counts_q,
        "hit_counts_rollup": Q.hit_counts_rollup,
        "top_words": Q.top_words_q,
        "gauge_last": Q.gauge_last,
        "gauge_level": Q.gauge_level,
        "value_histogram": Q.value_histogram,
        "flag_rate_windows": Q.flag_rate_windows,
        "flag_rate_sliding": Q.flag_rate_sliding,
        "stream_moderate": Q.stream_moderate,
        "quota_audit": Q.quota_audit_q,
        "custom_matcher": Q.custom_matcher,
        "stream_reload": Q.stream_reload,
        "quota_audit_stream": Q.quota_audit_stream_q,
        **LARGE,
        **TABLES,
        **HISTORY,
    }


def oracle_sql() -> dict:
    from tamis.plans.sql import SQL
    return {k: v for k, v in SQL.items() if k in queries()}
