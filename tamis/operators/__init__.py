from tamis.operators.matchers import Matcher, bank_rows, BankTooLarge
from tamis.operators.keyword import KeywordMatcher, LiteralMatcher, match_keywords, match_literal
from tamis.operators.regex import RegexMatcher, match_regex, match_rules
from tamis.operators.policy import moderate, moderate_hits, redact, declared_action

__all__ = ["Matcher", "bank_rows", "BankTooLarge", "KeywordMatcher", "LiteralMatcher", "match_keywords",
           "match_literal", "RegexMatcher", "match_regex", "match_rules", "moderate", "moderate_hits",
           "redact", "declared_action"]
