from tamis.sources.wordbank import load_word_bank, bank_from_rows, load_rules, rules_from_rows, default_rules
from tamis.sources.texts import as_contexts
from tamis.sources.requests import parse_standard, parse_dify
from tamis.sources.render import render_standard, render_dify

__all__ = ["load_word_bank", "bank_from_rows", "load_rules", "rules_from_rows", "default_rules",
           "as_contexts", "parse_standard", "parse_dify", "render_standard", "render_dify"]
