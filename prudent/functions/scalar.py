"""Scalar column functions (inventory family F).

All are built-in Spark expressions, so they stay inside whole-stage codegen;
none is a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F01 ---------------------------------------------------------------------
def extract_int(col, pattern: str, group: int = 1) -> Column:
    """Capture group as an integer key; NULL when the pattern misses."""
    s = F.regexp_extract(_c(col), pattern, group)
    return F.when(s == "", None).otherwise(s).try_cast("bigint")


# F02 ---------------------------------------------------------------------
def core_code(col, width: int = 10) -> Column:
    """Strip leading zeros, keep the first ``width`` characters."""
    return F.left(F.ltrim(_c(col), F.lit("0")), F.lit(width))


# F03 ---------------------------------------------------------------------
def safe_date(col, fmt: str = "yyyyMMdd") -> Column:
    """Parse text (or a yyyymmdd number) to a date; NULL on failure."""
    return F.try_to_date(_c(col).cast("string"), fmt)


# F04 ---------------------------------------------------------------------
def week_start(col) -> Column:
    """Monday of the ISO week, as a date."""
    return F.to_date(F.date_trunc("WEEK", _c(col)))


def day_of(col) -> Column:
    return F.to_date(_c(col))


# F05 ---------------------------------------------------------------------
def day_name(col) -> Column:
    return F.dayname(_c(col))


# F06 ---------------------------------------------------------------------
def minutes_between(a, b) -> Column:
    """Minute boundaries crossed from a to b (warehouse DATEDIFF semantics)."""
    return F.timestamp_diff("MINUTE", F.date_trunc("MINUTE", _c(a)), F.date_trunc("MINUTE", _c(b)))


# F07 ---------------------------------------------------------------------
def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(_c(num), _c(den))


def pct(num, den, digits: int = 2) -> Column:
    return F.round(F.try_divide(_c(num) * F.lit(100.0), _c(den)), digits)


# F08 / F09 ----------------------------------------------------------------
# Fixed values that must equal the reference's sanitiser: the control
# character class (keeps tab, newline and carriage return), the nine
# instruction-shaped patterns in their order, and the replacement marker.
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
INJECTION_PATTERNS = [
    r"(?i)\bignore (?:the )?(?:above|previous|prior) (?:instructions|prompts?)\b",
    r"(?i)\byou are (?:now |actually )?(?:a |an )?[a-z\s]{1,40}(?:assistant|bot|ai|model)\b",
    r"(?i)\bsystem:\s",
    r"(?i)\bassistant:\s",
    r"(?i)<\s*system\s*>",
    r"(?i)<\s*/?\s*instructions?\s*>",
    r"(?i)\bdisregard (?:the )?(?:above|previous|prior)\b",
    r"(?i)\bprint (?:the )?(?:full )?system prompt\b",
    r"(?i)\breveal (?:your |the )?(?:system|prompt|instructions?)\b",
]
REDACTION = "[REDACTED: injection-shape content]"


def strip_controls(col) -> Column:
    return F.regexp_replace(_c(col), CONTROL_CHARS, "")


def redact(col) -> Column:
    """Control characters removed, then the nine patterns replaced in order."""
    out = strip_controls(col)
    for p in INJECTION_PATTERNS:
        out = F.regexp_replace(out, p, REDACTION)
    return out


def redact_changed(col) -> Column:
    """True when sanitising changed a non-null value."""
    return _c(col).isNotNull() & (redact(col) != _c(col))


# F12 ---------------------------------------------------------------------
def norm_key(col, width: int = 120) -> Column:
    t = F.regexp_replace(F.lower(_c(col)), r"[^a-z0-9 ]+", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.left(t, F.lit(width))


# F14 ---------------------------------------------------------------------
# Severity spellings folded to the three canonical levels.
SEVERITY_HIGH = ["critical", "urgent", "blocker", "severe", "blocking"]
SEVERITY_MEDIUM = ["warning", "warn", "moderate"]
SEVERITY_LOW = ["info", "informational", "minor", "trivial", "note"]


def norm_severity(col) -> Column:
    c = _c(col)
    lc = F.lower(c)
    return (F.when(c.isNull(), None)
            .when(c.isin("low", "medium", "high"), c)
            .when(lc.isin(*SEVERITY_HIGH), "high")
            .when(lc.isin(*SEVERITY_MEDIUM), "medium")
            .when(lc.isin(*SEVERITY_LOW), "low")
            .otherwise("medium"))


# F15 ---------------------------------------------------------------------
# Word boundaries spelled as explicit Unicode classes, so that the JVM and
# other regex engines agree (a letter next to an accented letter is not a
# boundary, as in Python's Unicode-aware \b).
WB_L = r"(?:^|[^\p{L}\p{N}_])"
WB_R = r"(?:[^\p{L}\p{N}_]|$)"
GRADE_PATTERNS = [
    rf"(?i){WB_L}Grade\s+([A-F]){WB_R}",
    rf"(?i){WB_L}grade[-_\s]([A-F]){WB_R}",
    rf"{WB_L}([A-F]){WB_R}",
]


def grade_letter(col) -> Column:
    """'Grade X' first, then grade-X / grade_X, then the first lone A-F."""
    c = _c(col)

    def grab(p):
        s = F.regexp_extract(c, p, 1)
        return F.when(s == "", None).otherwise(F.upper(s))

    extracted = F.coalesce(*[grab(p) for p in GRADE_PATTERNS])
    return F.when(c.isin("A", "B", "C", "D", "F"), c).otherwise(extracted)


# F17 ---------------------------------------------------------------------
def norm_name(col, canonical: list[str], suffix: str = "-agent") -> Column:
    """Fold underscore / case / suffix variants to a canonical name set."""
    c = _c(col)
    canon = F.array(*[F.lit(x) for x in canonical])
    dashed = F.lower(F.regexp_replace(c, "_", "-"))
    cands = [c, dashed,
             F.when(c.endswith(suffix), F.regexp_replace(c, f"{suffix}$", "")).otherwise(F.concat(c, F.lit(suffix))),
             F.regexp_replace(dashed, f"{suffix}$", ""),
             F.concat(dashed, F.lit(suffix))]
    picks = [F.when(F.array_contains(canon, x), x) for x in cands]
    return F.coalesce(*picks, c)


# F19 ---------------------------------------------------------------------
def norm_technique(col) -> Column:
    lc = F.lower(_c(col))

    def any_of(words):
        return reduce(lambda a, b: a | b, [lc.contains(w) for w in words])

    return (F.when(any_of(["cluster", "kmeans", "k-means", "dbscan", "hierarchical"]), "clustering")
            .when(any_of(["dimensionality", "pca", "umap", "tsne", "t-sne"]), "dimensionality_reduction")
            .when(any_of(["outlier", "isolation", "mahalanobis", "anomaly"]), "outlier_characterization"))


def norm_correction(col) -> Column:
    lc = F.lower(_c(col))
    return (F.when(lc.contains("benjamini") | lc.contains("bh") | lc.contains("fdr"), "benjamini_hochberg")
            .when(lc.contains("bonferroni"), "bonferroni").otherwise("unspecified"))


# F20 ---------------------------------------------------------------------
def slug(col, default: str = "analysis") -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(_c(col), F.lit(default)))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", default).otherwise(s)


# F21 ---------------------------------------------------------------------
# Zero-width characters dropped, two space variants folded to a
# space, and the punctuation folding pairs (figure dash, en dash, em dash,
# horizontal bar, minus sign -> '-'; single quotes -> "'"; double quotes ->
# '"'; asterisk operator -> '*').
ZERO_WIDTH = "[\u200b-\u200f\u2060\ufeff]"
FOLD_FROM = "\u00a0\u202f\u2012\u2013\u2014\u2015\u2212\u2018\u2019\u201c\u201d\u2217"
FOLD_TO = "  -----''\"\"*"


def norm_text(col) -> Column:
    t = F.regexp_replace(_c(col), ZERO_WIDTH, "")
    return F.translate(t, FOLD_FROM, FOLD_TO)


# F22 ---------------------------------------------------------------------
def truncate(col, n: int = 8000) -> Column:
    c = _c(col)
    return F.when(F.length(c) <= n, c).otherwise(
        F.concat(F.left(c, F.lit(n)), F.lit("... [truncated "),
                 (F.length(c) - n).cast("string"), F.lit(" chars]")))


# F23 ---------------------------------------------------------------------
def token_estimate(col) -> Column:
    """floor(words x 1.3); blank text has no words."""
    t = F.trim(_c(col))
    words = F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))
    return F.floor(words * F.lit(1.3)).cast("bigint")


# F24 ---------------------------------------------------------------------
def surrogate_key(*cols) -> Column:
    """First 16 hex digits of SHA-256 over 'a|b|c', as an unsigned integer."""
    h = F.sha2(F.concat_ws("|", *[_c(c).cast("string") for c in cols]), 256)
    return F.conv(F.left(h, F.lit(16)), 16, 10).cast("decimal(20,0)")


# F25 ---------------------------------------------------------------------
# Substring signals for analytical questions, daily grain and
# delivery topics.
ANALYTICAL_SIGNALS = [
    "correlat", "relationship", "factor", "driv", "cause", "impact",
    "predict", "explain", "compar", "trend", "pattern", "anomal",
    "regress", "cluster", "segment", "outlier", "decompos", "forecast",
    "associat", "affect", "influenc", "contribut", "depend", "vary",
    "scatter", "distribut", "effect", "differ", "worst", "best",
]
DAILY_GRAIN_SIGNALS = [
    "daily", "day-of-week", "day of week", "dayofweek", "intra-week",
    "intraweek", "per day", "each day", "by day", "weekday", "weekend",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
    "sunday",
]
DELIVERY_SIGNALS = ["delivery", "delivered"]


def has_any(col, words: list[str]) -> Column:
    lc = F.lower(_c(col))
    return reduce(lambda a, b: a | b, [F.contains(lc, F.lit(w)) for w in words])


# F26 ---------------------------------------------------------------------
def run_ts(col) -> Column:
    """'YYYYMMDDTHHMMSSZ-xxxx' -> timestamp (NULL when malformed)."""
    return F.try_to_timestamp(F.substring_index(_c(col), "-", 1), F.lit("yyyyMMdd'T'HHmmss'Z'"))


# F28 ---------------------------------------------------------------------
def rel_diff(a, b) -> Column:
    return F.try_divide(F.abs(_c(b) - _c(a)), F.abs(_c(a)))


def values_match(a, b, kind_col=None, tol: float = 0.01) -> Column:
    """Exact for integers, relative difference below ``tol`` for floats."""
    exact = _c(a) == _c(b)
    close = exact | (rel_diff(a, b) < tol)
    if kind_col is None:
        return close
    return F.when(_c(kind_col) == "integer", exact).otherwise(close)


# F10 ---------------------------------------------------------------------
def long_share(col, min_len: int = 40) -> Column:
    """Share of non-null values longer than ``min_len`` (aggregate)."""
    c = _c(col)
    return F.try_divide(F.count_if(F.length(c) > min_len).cast("double"), F.count(c).cast("double"))
