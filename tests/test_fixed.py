"""The fixed values the service's clients see (enum strings, error codes, defaults)."""

from tamis import fixed


def test_enum_strings():
    assert (fixed.ACTION_PASS, fixed.ACTION_BLOCK, fixed.ACTION_MASK) == ("pass", "block", "mask")
    assert (fixed.POINT_INPUT, fixed.POINT_OUTPUT) == ("input", "output")
    assert sorted(fixed.SEVERITY_WEIGHTS) == ["high", "low", "medium"]


def test_error_codes_and_defaults():
    assert (fixed.ERR_CONFIG_LOAD, fixed.ERR_WORD_BANK_LOAD, fixed.ERR_INVALID_INPUT) == ("E001", "E002", "E003")
    assert (fixed.DEFAULT_MODE, fixed.DEFAULT_THRESHOLD, fixed.DEFAULT_FALLBACK) == ("chain", 0.5, "pass")
    assert (fixed.DEFAULT_RATE, fixed.DEFAULT_CAPACITY) == (100.0, 200)


def test_default_rules_and_bank_shapes():
    assert [r[0] for r in fixed.DEFAULT_RULES] == ["email_pattern", "phone_pattern", "url_pattern",
                                                   "credit_card_pattern"]
    assert all(len(r) == 5 for r in fixed.DEFAULT_RULES)
    assert len(fixed.DEFAULT_BANK) == 7 and all(len(r) == 4 for r in fixed.DEFAULT_BANK)
