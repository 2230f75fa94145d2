"""tamis — text moderation as Spark jobs.

Word banks and rule packs are DataFrames; matching, verdict policies, redaction,
reports and streams are DataFrame / SQL plans.
"""

from tamis.session import get_spark, checkpoint_dir, materialize
from tamis.sources.wordbank import load_word_bank, load_rules, default_rules, bank_from_rows, by_type
from tamis.sources.texts import as_contexts, spread
from tamis.sources.requests import parse_standard, parse_dify
from tamis.sources.render import render_standard, render_dify
from tamis.operators.keyword import KeywordMatcher, LiteralMatcher, match_keywords, match_literal
from tamis.operators.regex import RegexMatcher, match_regex, match_rules
from tamis.operators.registry import register_matcher, get_matcher, row_matcher, dataframe_matcher
from tamis.operators.policy import (moderate, moderate_hits, policy_hits, redact, redact_texts, declared_action,
                                    moderate_conversations, byte_offsets)
from tamis.operators.bank import lookup, is_listed, not_listed, words, size
from tamis.operators.report import hit_counts, top_words, last_value, running_level, histogram, flag_rate
from tamis.streaming.moderate import moderate_stream, moderate_stream_reload, run_available_now
from tamis.streaming.quota import quota_audit, quota_audit_stream

__all__ = [n for n in dir() if not n.startswith("_")]
