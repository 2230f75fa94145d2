"""Fixed values that must equal the reference service's for equal results.

Everything here is data, stated plainly; the logic that uses it lives elsewhere.
"""

# --- fixed values: verdict actions, points, severities -----------------------
ACTION_PASS = "pass"
ACTION_BLOCK = "block"
ACTION_MASK = "mask"
POINT_INPUT = "input"
POINT_OUTPUT = "output"

# --- fixed values: severity weights of the weighted policy (anything else 0.0)
SEVERITY_WEIGHTS = {"high": 1.0, "medium": 0.5, "low": 0.2}

# --- fixed values: policy defaults --------------------------------------------
DEFAULT_MODE = "chain"
DEFAULT_THRESHOLD = 0.5
DEFAULT_FALLBACK = "pass"

# --- fixed values: rate limit defaults (tokens per second, bucket capacity) ---
DEFAULT_RATE = 100.0
DEFAULT_CAPACITY = 200
EXEMPT_PATHS = ("/health",)

# --- fixed values: error codes and messages -----------------------------------
ERR_CONFIG_LOAD = "E001"
ERR_WORD_BANK_LOAD = "E002"
ERR_INVALID_INPUT = "E003"
MSG_TEXT_REQUIRED = "text is required"
MSG_BAD_POINT = "point must be 'input' or 'output'"
MSG_UNSUPPORTED_POINT = "unsupported point type: "
MSG_MATCHER_NOT_FOUND = "matcher not found"

# --- fixed values: Dify moderation extension ----------------------------------
DIFY_POINT_INPUT = "app.moderation.input"
DIFY_POINT_OUTPUT = "app.moderation.output"
DIFY_ACTION = "direct_output"
DIFY_PRESET = "内容因违反政策被拦截"
# The documented (not coded) response style.
DIFY_DOC_ACTION_FLAGGED = "overridden"

# --- fixed values: default rule pack (name, pattern, type, severity, action) --
DEFAULT_RULES = [
    ("email_pattern", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "privacy", "medium", "review"),
    ("phone_pattern", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "privacy", "medium", "review"),
    ("url_pattern", r"https?://[^\s]+", "spam", "low", "review"),
    ("credit_card_pattern", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "privacy", "critical", "block"),
]

# --- fixed values: default word bank rows (word, type, severity, action) ------
DEFAULT_BANK = [
    ("fuck", "profanity", "high", "block"),
    ("shit", "profanity", "medium", "block"),
    ("damn", "profanity", "low", "review"),
    ("free money", "spam", "medium", "review"),
    ("click here", "spam", "low", "review"),
    ("act now", "spam", "low", "review"),
    ("hate you", "hate", "high", "block"),
]

# --- fixed values: normalisation (full-width block and two special spaces) ----
FULLWIDTH_FIRST = 0xFF01
FULLWIDTH_LAST = 0xFF5E
FULLWIDTH_OFFSET = 0xFEE0
IDEOGRAPHIC_SPACE = "　"
ZERO_WIDTH_SPACE = "​"

# Our own ranking of declared bank actions (not in the reference, which never
# reads the column): strongest first.
ACTION_RANK = {"block": 4, "mask": 3, "review": 2, "pass": 1}

# --- fixed values: request binding errors -------------------------------------
MSG_POINT_REQUIRED = "Key: 'Request.Point' Error:Field validation for 'Point' failed on the 'required' tag"
MSG_BAD_BODY = "invalid request body"
DIFY_DOC_PRESET = "内容包含敏感信息，请修改后重试"
