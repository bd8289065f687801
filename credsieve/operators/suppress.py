"""Leaving findings out, and judging what remains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions.findings import SEVERITIES, rank_of


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of this severity or above."""
    return findings.where(F.col("sev_rank") >= rank_of(severity))


def _baseline_keys(findings: DataFrame, baseline: DataFrame) -> list[str]:
    """Known findings are told apart by repository where the baseline names one."""
    return [c for c in ("repo", "fingerprint") if c in baseline.columns and c in findings.columns]


def drop_known(findings: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Findings whose fingerprint is not in the baseline."""
    if baseline is None:
        return findings
    keys = _baseline_keys(findings, baseline)
    return findings.join(baseline.select(*keys), keys, "left_anti")


def only_known(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings the baseline suppresses."""
    keys = _baseline_keys(findings, baseline)
    return findings.join(baseline.select(*keys), keys, "left_semi")


def gate(findings: DataFrame, fail_on: str | None = None) -> DataFrame:
    """One row: does the scan fail, and with which exit code?

    Any finding fails a scan unless a level is given.
    """
    failing = F.count_if(F.col("sev_rank") >= (rank_of(fail_on) if fail_on else 0))
    return findings.agg(failing.alias("n_failing")).select(
        "n_failing",
        (F.col("n_failing") > 0).alias("failed"),
        F.when(F.col("n_failing") > 0, 1).otherwise(0).alias("exit_code"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """Number of findings per severity; all four levels are listed."""
    levels = findings.sparkSession.createDataFrame(
        list(enumerate(SEVERITIES)), "sev_rank int, severity string"
    )
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return levels.join(counts, "severity", "left").select(
        "severity", "sev_rank", F.coalesce("n", F.lit(0)).alias("n_findings")
    )
