"""Test fixtures for the driver queries (our own, not the reference's).

The reference's default bank has no hit in the generated documents, so the
queries use this bank: accented, nested, suffix, self-overlapping and absent words.
"""

from tamis import fixed

# (word, type, severity, action)
DOC_BANK = [
    ("license", "legal", "critical", "block"),
    ("token", "secret", "high", "block"),
    ("haha", "spam", "medium", "review"),
    ("ción", "lang_es", "low", "review"),
    ("ung", "lang_de", "low", "review"),
    ("éau", "lang_fr", "high", "block"),
    ("eau", "lang_fr", "low", "review"),
    ("then", "common", "low", "pass"),
    ("hen", "common", "low", "pass"),
    ("zzqx", "never", "high", "block"),
]

EMAIL_RULE = [r for r in fixed.DEFAULT_RULES if r[0] == "email_pattern"]


def bank_values_sql(rows=DOC_BANK, alias: str = "bank") -> str:
    """The bank as a DuckDB/ANSI ``VALUES`` CTE body."""
    vals = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"{alias}(word, type, severity, action) AS (VALUES {vals})"

# Bank words used as regular expressions (M2): RE2 features that differ in Java
# (ASCII \b, POSIX classes, '$', '.', (?i)), a zero-length match, and two patterns
# RE2 rejects, which the matcher must skip.
REGEX_BANK_EXTRA = [
    ("th[ae]n", "common", "low", "pass"),
    (r"\bthe\b", "common", "low", "pass"),
    ("ción|sión", "lang_es", "low", "review"),
    ("[[:upper:]]{2,}", "shout", "medium", "review"),
    ("ha(ha)+", "spam", "medium", "review"),
    (r"\d{4}", "number", "low", "pass"),
    ("(?i)EAU", "lang_fr", "low", "review"),
    ("x*", "empty", "low", "pass"),
    ("é.u", "lang_fr", "low", "review"),
    (r"\.$", "tail", "low", "pass"),
    (r"\141n", "octal", "low", "pass"),
    ("(?P<a_name>ou)t?", "named", "low", "pass"),
]
REGEX_BANK_INVALID = [
    ("(", "broken", "high", "block"),
    ("(?=x)y", "lookahead", "high", "block"),
    (r"\h", "java", "high", "block"),
    (r"\R", "java", "high", "block"),
    (r"t{1001}", "count", "high", "block"),
    (r"t{2}{3}", "nested", "high", "block"),
    (r"(?P<n>a)\k<n>", "backref", "high", "block"),
]
REGEX_BANK_VALID = DOC_BANK + REGEX_BANK_EXTRA
REGEX_BANK = REGEX_BANK_VALID + REGEX_BANK_INVALID

# Histogram upper bounds for event values (R3).
VALUE_BUCKETS = [1.0, 5.0, 10.0, 50.0, 100.0, 250.0]

# Token bucket used by the quota audit query: one token per 5 days, two at most.
QUOTA_RATE = 1.0 / 432000.0
QUOTA_CAPACITY = 2
# Its stream: days an event may be late, and parts of the input (one micro-batch each).
QUOTA_DELAY = 5
QUOTA_PARTS = 6
# Rows of a file of its stream, about.
QUOTA_FILE_ROWS = 100_000
