"""Secrets in texts, found and replaced by column expressions.

The patterns are those of publicly documented token formats, and assignments of long literals to names
that say secret. They are joined into one alternation, so overlapping finds count once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "[REDACTED_SECRET]"
#: Fixed values: (type, whether confidence is high, pattern). Public token formats.
PATTERNS = [
    ("private_key", True, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("github_token", True, r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b"),
    ("gitlab_token", True, r"\bglpat-[A-Za-z0-9_-]{20,}"),
    ("aws_access_key", True, r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("slack_token", True, r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", True, r"\bAIza[A-Za-z0-9_-]{35}"),
    ("jwt", True, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("assignment", False, r"(?i:\b(?:api_?key|api_?token|access_?token|auth_?token|token|secret|password|passwd)\b\s*[:=]\s*[\"'][^\"'\n]{12,}[\"'])"),
]
#: Strings of which one stands in every find of the patterns above: as they are, and in lower case.
TELLTALES = ["-----BEGIN ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "AKIA", "ASIA", "xox", "AIza", "eyJ"]
ASSIGNED = ["api_key", "apikey", "token", "secret", "password", "passwd"]
ANY = "|".join(p for _, _, p in PATTERNS)


def secrets(text: Column) -> Column:
    """All secrets in a text, each once."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def secret_type(secret: Column) -> Column:
    """The type of one find: the first whose pattern it is. An assignment of a known token has the token's type."""
    out = None
    for kind, _, pattern in PATTERNS:
        hit = secret.rlike(pattern if kind != "assignment" else r"\A[\s\S]*\z")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def redact(text: Column) -> Column:
    return F.regexp_replace(text, ANY, PLACEHOLDER)


def may_hold_secrets(text: Column) -> Column:
    """Whether a text holds a string that each of the patterns needs; most texts don't and are passed by."""
    out = F.lit(False)
    for x in TELLTALES:
        out = out | F.contains(text, F.lit(x))
    low = F.lower(text)
    for x in ASSIGNED:
        out = out | F.contains(low, F.lit(x))
    return out


def findings(text: Column) -> Column:
    """struct(text, count, high, types): the redacted text, how many secrets, how many of high confidence, their sorted distinct types."""
    none = F.struct(text.alias("text"), F.size(F.array().cast("array<string>")).alias("count"), F.size(F.array().cast("array<string>")).alias("high"), F.array().cast("array<string>").alias("types"))
    return F.when(may_hold_secrets(text) | text.isNull(), _findings(text)).otherwise(none)


def _findings(text: Column) -> Column:
    types = F.transform(secrets(text), secret_type)
    sure = [k for k, high, _ in PATTERNS if high]
    return F.struct(
        redact(text).alias("text"),
        F.size(types).alias("count"),
        F.size(F.filter(types, lambda t: t.isin(sure))).alias("high"),
        F.array_sort(F.array_distinct(types)).alias("types"),
    )
