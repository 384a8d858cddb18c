"""Severity as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from timbrel.constants import LEVEL_LETTERS, LEVEL_WORDS, OOM_PHRASES, SEVERITY_ORDER


def any_phrase(text: Column, phrases: list[str]) -> Column:
    """Does a lower-cased text contain one of the phrases?"""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def level(word: Column, default: str = "info") -> Column:
    """Severity of a level word or letter."""
    low = F.lower(F.trim(word))
    out = F.lit(default)
    for letter, name in LEVEL_LETTERS.items():
        out = F.when(low == letter, name).otherwise(out)
    for name, words in LEVEL_WORDS.items():
        out = F.when(low.isin(words.split()), name).otherwise(out)
    return out


def http_status(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")


def rank(severity: Column) -> Column:
    """0 for critical, upwards in the final order."""
    out = F.lit(len(SEVERITY_ORDER) - 1)
    for i, name in enumerate(SEVERITY_ORDER):
        out = F.when(severity == name, i).otherwise(out)
    return out


def is_error(severity: Column) -> Column:
    return severity.isin("error", "critical")


def is_significant(severity: Column) -> Column:
    return severity.isin("warning", "error", "critical")


def tiers(text: Column, *rules: tuple[list[str], str], default: str = "info") -> Column:
    """The first tier of phrases that a lower-cased text contains."""
    low, out = F.lower(text), F.lit(default)
    for phrases, name in reversed(rules):
        out = F.when(any_phrase(low, phrases), name).otherwise(out)
    return out


#: A count before a word ("0 errors") or a code behind it ("error 404") is no level.
_COUNTED = r"(?<!\d\s{0,8})"
_ERRORS = r"(?:errors?|fail(?:ed|ure)?|fatal|critical|denied|refused)"
_WARNINGS = r"(?:warn(?:ing)?s?|timed? ?out|retry(?:ing)?|deprecated)"


def syslog(text: Column) -> Column:
    """Severity of a syslog line without a level."""
    return (
        F.when(any_phrase(F.lower(text), OOM_PHRASES), "critical")
        .when(text.rlike(rf"(?i)\b{_COUNTED}{_ERRORS}\b(?!\s*[:=]?\s*\d)"), "error")
        .when(text.rlike(rf"(?i)\b{_COUNTED}{_WARNINGS}\b"), "warning")
        .otherwise("info")
    )


def usage(text: Column) -> Column:
    """Severity of free text: a level word counts where it is used as a level."""
    critical = r"\b(?:CRITICAL|FATAL|EMERG(?:ENCY)?|PANIC|ALERT)\b|[\[(<:|=]\s{0,3}(?i:critical|fatal|emerg|panic)\b"
    return (
        F.when(text.rlike(critical), "critical")
        .when(text.rlike(rf"\bERROR\b(?!\s*\d)|\bSEVERE\b|(?i)\b{_COUNTED}(?:error|err|severe|exception|failed)\b(?!\s*\d)"), "error")
        .when(text.rlike(rf"(?i)\b{_COUNTED}(?:warn|warning)\b"), "warning")
        .when(text.rlike(r"(?i)\b(?:info|notice)\b"), "info")
        .when(text.rlike(r"(?i)\b(?:debug|trace)\b"), "debug")
        .otherwise("unknown")
    )
