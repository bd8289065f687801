"""Derived columns of a finding and the fixed severity scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names in ascending order, and their names in the report formats.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
GITLAB_SEVERITIES = {
    "CRITICAL": "blocker",
    "HIGH": "critical",
    "MEDIUM": "major",
    "LOW": "minor",
}


def severity_rank(severity: Column) -> Column:
    """0 for LOW up to 3 for CRITICAL, null for anything else; case is ignored."""
    name = F.upper(severity)
    rank = F.lit(None).cast("int")
    for i, known in enumerate(SEVERITIES):
        rank = F.when(name == known, F.lit(i)).otherwise(rank)
    return rank


def rank_of(severity: str) -> int:
    """Rank of a severity name given as an option."""
    try:
        return SEVERITIES.index(severity.upper())
    except ValueError:
        raise ValueError(f"unknown severity {severity!r}, expected one of {SEVERITIES}") from None


def _mapped(value: Column, names: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, name in names.items():
        out = F.when(value == key, F.lit(name)).otherwise(out)
    return out


def sarif_level(severity: Column) -> Column:
    return _mapped(severity, SARIF_LEVELS, "note")


def gitlab_severity(severity: Column) -> Column:
    return _mapped(severity, GITLAB_SEVERITIES, "minor")


def redacted(value: Column) -> Column:
    """First four characters and ``***``; nothing of a value that short."""
    return F.when(F.length(value) <= 4, F.lit("***")).otherwise(
        F.concat(F.substring(value, 1, 4), F.lit("***"))
    )


def fingerprint(rule_id: Column, path: Column, value: Column) -> Column:
    """Stable id of a finding; holds neither line number nor repository."""
    return F.sha2(F.concat_ws(":", rule_id, path, value), 256)


def short_commit(sha: Column, missing: str = "N/A") -> Column:
    return F.substring(F.coalesce(F.nullif(sha, F.lit("")), F.lit(missing)), 1, 8)


def safe_cell(value: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets a leading apostrophe."""
    return F.when(value.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def one_line(
    severity: Column,
    rule_name: Column,
    path: Column,
    line_number: Column,
    value: Column,
    sha: Column,
) -> Column:
    """A finding as one line of text, value redacted."""
    place = F.when(
        line_number.isNotNull(), F.concat(path, F.lit(":"), line_number.cast("string"))
    ).otherwise(path)
    return F.format_string(
        "[%s] %s in %s (%s) @ %s", severity, rule_name, place, redacted(value), short_commit(sha)
    )
