"""Word lists, tokens and constants that decide results and must not change."""

# --- Fixed values: column-name parts that suggest a date column
DATE_HINTS = (
    "date", "time", "datetime", "timestamp", "created", "updated", "modified",
    "at", "on", "day", "month", "year", "dob", "born",
)

# --- Fixed values: column-name parts that suggest a boolean flag
FLAG_HINTS = (
    "is_", "has_", "was_", "can_", "will_", "flag", "active", "enabled",
    "disabled", "deleted", "verified", "confirmed",
)

# --- Fixed values: column-name parts of quantities that cannot be negative
POSITIVE_DOMAIN_HINTS = (
    "age", "price", "cost", "fare", "salary", "wage", "income", "revenue", "count",
    "quantity", "qty", "amount", "size", "weight", "height", "width", "length",
    "duration", "distance", "score", "rating", "rank", "population", "value",
    "sales", "units",
)

# --- Fixed values: numbers commonly written in place of a missing value
SENTINEL_VALUES = (
    -1.0, -99.0, -999.0, -9999.0, -99999.0,
    99.0, 999.0, 9999.0, 99999.0, 999999.0,
)

# --- Fixed values: CSV cells read as missing, compared exactly
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- Fixed values: the characters Python's str.strip() removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: thresholds of the duplicate, missing and flag rules
DUPLICATE_CRITICAL_SHARE = 0.1
SPARSE_ROWS_CRITICAL_SHARE = 0.1
MISSING_WARNING_SHARE = 0.05
OUTLIER_CRITICAL_SHARE = 0.5
FLAG_MIN_ROWS = 50
MIN_VALUES_FOR_OUTLIERS = 4
MIN_VALUES_FOR_EXTREMES = 4
SAMPLE_ROWS = 10
EXAMPLE_VALUES = 5
TOP_VALUES = 3

# --- Fixed values: severities from worst to best
SEVERITIES = ("critical", "warning", "info", "ok")

# --- Fixed values: length of a token in characters, and the digest of a prompt
CHARS_PER_TOKEN = 3.5
