"""Allowlist and baseline files."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions.regex import LINE_BREAK, SPACE
from credsieve.functions.text import strip

ALLOWLIST = "pattern string, reason string, scope string, is_regex boolean"


def _is_missing(exc: AnalysisException) -> bool:
    return (exc.getCondition() or "").startswith("PATH_NOT_FOUND")


def parse_allowlist(lines: DataFrame, column: str = "value") -> DataFrame:
    """Allowlist entries of lines like ``scope:<glob> regex:<pattern>  # reason``.

    Blank lines, comment lines, a scope without pattern and empty patterns are dropped.
    """
    # filters do not move below a generator, so what it yields is computed once
    whole = lines.select(F.explode(F.array(strip(F.col(column)))).alias("_line")).where(
        (F.col("_line") != "") & ~F.startswith("_line", F.lit("#"))
    )
    has_reason = F.contains("_line", F.lit(" #")) | F.contains("_line", F.lit("\t#"))
    halves = F.when(has_reason, F.split("_line", f"[{SPACE}]+#", 2)).otherwise(F.array("_line"))
    entries = whole.select(F.explode(F.array(halves)).alias("_h")).select(
        F.inline(
            F.array(
                F.struct(
                    strip(F.col("_h")[0]).alias("_entry"),
                    F.coalesce(strip(F.get("_h", F.lit(1))), F.lit("")).alias("reason"),
                )
            )
        )
    )
    scoped = rf"\Ascope:[{SPACE}]*([^{SPACE}]+)[{SPACE}]+([^{SPACE}][\s\S]*)\z"
    is_scoped = F.startswith("_entry", F.lit("scope:"))
    entries = entries.where(~is_scoped | F.col("_entry").rlike(scoped)).select(
        "reason",
        F.when(is_scoped, F.regexp_extract("_entry", scoped, 1)).alias("scope"),
        F.when(is_scoped, F.regexp_extract("_entry", scoped, 2)).otherwise(F.col("_entry")).alias("_entry"),
    )
    is_regex = F.startswith("_entry", F.lit("regex:"))
    return entries.select(
        F.when(is_regex, strip(F.substr("_entry", F.lit(7)))).otherwise(F.col("_entry")).alias("pattern"),
        "reason",
        "scope",
        is_regex.alias("is_regex"),
    ).where(F.col("pattern") != "")


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an allowlist file; no entries if there is no such file."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as exc:
        if _is_missing(exc):
            return spark.createDataFrame([], ALLOWLIST)
        raise
    return parse_allowlist(lines.select(F.explode(F.split("value", LINE_BREAK, -1)).alias("value")))


def parse_baseline(documents: DataFrame, column: str = "value") -> DataFrame:
    """(fingerprint) of JSON documents whose ``findings`` are objects or plain strings."""
    items = documents.select(
        F.explode(F.from_json(column, "findings array<string>")["findings"]).alias("_item")
    )
    is_object = F.startswith("_item", F.lit("{"))
    return (
        items.select(
            F.when(is_object, F.get_json_object("_item", "$.fingerprint"))
            .otherwise(F.col("_item"))
            .alias("fingerprint")
        )
        .where(F.col("fingerprint").isNotNull())
        .distinct()
    )


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Known fingerprints of a baseline.

    ``path`` holds JSON documents.  Missing or corrupt ones give an empty baseline, the
    latter with a warning.
    """
    empty = spark.createDataFrame([], "fingerprint string")
    try:
        documents = spark.read.text(path, wholetext=True)
    except AnalysisException as exc:
        if _is_missing(exc):
            return empty
        raise
    bad = documents.where(F.from_json("value", "findings array<string>")["findings"].isNull())
    if not bad.isEmpty():
        warnings.warn(f"baseline {path!r} holds a document that cannot be read", stacklevel=2)
    return parse_baseline(documents)


def read_baseline_rows(spark: SparkSession, path: str) -> DataFrame:
    """(repo, fingerprint) of a baseline written as rows; empty if there is none."""
    schema = "repo string, fingerprint string"
    try:
        return spark.read.schema(schema).json(path).where(F.col("fingerprint").isNotNull())
    except AnalysisException as exc:
        if _is_missing(exc):
            return spark.createDataFrame([], schema)
        raise
