"""User rules as rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from credsieve.functions.findings import SEVERITIES, severity_rank
from credsieve.rules import Rule

# a pattern, or a part of it, that ignores case
_ANY_CASE = re.compile(r"\(\?[a-zA-Z]*i")


def regex_error(pattern: Column) -> Column:
    """Why a pattern is no valid regular expression; null if it is one."""

    def problem(text: str | None) -> str | None:
        try:
            re.compile(text or "")
        except re.error as exc:
            return f"invalid regex: {exc}"
        return None

    @F.pandas_udf(StringType())
    def problems(patterns: pd.Series) -> pd.Series:
        return patterns.map(problem)

    return problems(pattern)


def check_rules(raw: DataFrame) -> DataFrame:
    """Rule rows with defaults filled in and a ``problem`` column (null = usable).

    Missing columns count as missing values: name defaults to the id, severity to
    MEDIUM.  Rows without id or pattern are dropped.
    """
    for name in ("id", "name", "pattern", "severity", "description", "literal"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    severity = F.coalesce("severity", F.lit("MEDIUM"))
    bad_severity = F.when(
        severity_rank(severity).isNull(),
        F.concat(
            F.lit("invalid severity '"), severity, F.lit(f"', expected one of: {', '.join(SEVERITIES)}")
        ),
    )
    order = [c for c in raw.columns if c == "rule_idx"]
    return raw.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("pattern", F.lit("")) != "")).select(
        *order,
        "id",
        F.coalesce("name", "id").alias("name"),
        "pattern",
        F.upper(severity).alias("severity"),
        F.coalesce("description", F.lit("")).alias("description"),
        "literal",
        F.coalesce(regex_error(F.col("pattern")), bad_severity).alias("problem"),
    )


def split_rules(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rules, and rejected ones with the reason."""
    checked = check_rules(raw)
    return (
        checked.where(F.col("problem").isNull()).drop("problem"),
        checked.where(F.col("problem").isNotNull()),
    )


def as_rules(valid: DataFrame) -> list[Rule]:
    """Rules for the plan builder, in order of rule_idx if there is one, else of id.

    Rules are code: each is compiled into the plan, whatever their number.
    """
    order = "rule_idx" if "rule_idx" in valid.columns else "id"
    return [
        Rule(
            r.id, r.name, r.severity, r.pattern, [r.literal] if r.literal else [],
            bool(_ANY_CASE.search(r.pattern)), r.description,
        )
        for r in valid.orderBy(order).collect()
    ]
