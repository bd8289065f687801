"""Report rows and sinks.

All of them take a table of findings, best one that was written before (a report then
does not scan again).  No step gathers a repository in one task: report documents are
written as text files whose concatenation, in name order, is the document.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credsieve.functions.findings import (
    gitlab_severity,
    one_line,
    redacted,
    safe_cell,
    sarif_level,
    severity_rank,
    short_commit,
)
from credsieve.functions.text import normal_path
from credsieve.operators.joins import ROWS_PER_TASK, hot_keys, join_salted
from credsieve.storage import cut_lineage

# Columns of the CSV report and keys of the JSON report, in order.
CSV_COLUMNS = [
    "rule_id", "rule_name", "severity", "file_path", "line_number", "matched_text",
    "commit_sha", "commit_author", "commit_date", "detection_type",
]
JSON_COLUMNS = [
    "rule_id", "rule_name", "severity", "file_path", "line_content", "matched_text",
    "commit_sha", "detection_type", "line_number", "commit_author", "commit_date", "entropy",
    "redacted_value", "fingerprint",
]
# The published schema of SARIF documents.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/"
    "sarif-2.1/schema/sarif-schema-2.1.0.json"
)
TOOL_NAME, TOOL_VERSION = "credsieve", "0.1.0"

# The most tasks that list the folders of a path.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

_ORDER = ["commit_seq", "file_path", "det_rank", "rule_idx", "line_number", "pos", "matched_text"]


def report_order(findings: DataFrame) -> list[Column]:
    """Severity first, then the order of discovery."""
    known = [c for c in _ORDER if c in findings.columns]
    return [F.col("sev_rank").desc(), *[F.col(c).asc() for c in known]]


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*report_order(findings))


def with_position(findings: DataFrame) -> DataFrame:
    """Findings in report order, numbered from 1.

    They are sorted by ranges and written; the sizes of the ranges give each its first
    number, so no task sees more than its own range.
    """
    order = report_order(findings)
    ranged = findings.repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits of this number are the partition, the lower 33 the place in it
    written = cut_lineage(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = written.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.col("_place") - F.shiftleft(part, 33)
    return (
        written.join(F.broadcast(starts), part == F.col("_part"))
        .withColumn("position", F.col("_start") + at + 1)
        .drop("_part", "_start", "_place")
    )


def redact(findings: DataFrame, lines: bool = False) -> DataFrame:
    """Replace the value by its redacted form; with ``lines`` also inside the line."""
    hidden = redacted(F.col("matched_text"))
    if lines:
        findings = findings.withColumn(
            "line_content", F.replace("line_content", F.col("matched_text"), hidden)
        )
    return findings.withColumn("matched_text", hidden)


def lines_of_text(findings: DataFrame) -> DataFrame:
    """Every finding as one line for people."""
    return findings.select(
        "repo",
        one_line(
            F.col("severity"), F.col("rule_name"), F.col("file_path"), F.col("line_number"),
            F.col("matched_text"), F.col("commit_sha"),
        ).alias("line"),
    )


def csv_rows(findings: DataFrame, redacted_values: bool = False) -> DataFrame:
    """The CSV columns; text that a spreadsheet would run is made harmless."""
    rows = redact(findings) if redacted_values else findings
    return rows.select(
        *[
            F.col(c) if c == "line_number" else safe_cell(F.col(c)).alias(c)
            for c in CSV_COLUMNS
        ]
    )


def json_findings(findings: DataFrame, redacted_values: bool = False) -> DataFrame:
    """(repo, json): findings with null values kept as null."""
    rows = redact(findings) if redacted_values else findings
    return rows.select(
        "*",
        F.to_json(F.struct(*JSON_COLUMNS), {"ignoreNullFields": "false"}).alias("json"),
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(repo, rule_id, rule_name, rule_index) numbered by first appearance in the report."""
    known = [c for c in _ORDER if c in findings.columns]
    first = F.min(F.struct((-F.col("sev_rank")).alias("sev"), *known, "rule_name")).alias("_first")
    rules = findings.groupBy("repo", "rule_id").agg(first)
    # a group holds the rules of a repository, not its findings
    return rules.select(
        "repo",
        "rule_id",
        F.col("_first.rule_name").alias("rule_name"),
        (F.row_number().over(Window.partitionBy("repo").orderBy("_first", "rule_id")) - 1).alias(
            "rule_index"
        ),
    )


def sarif_results(findings: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Findings with their SARIF columns; ``json`` is the result object.

    Without a line number the region is left out.
    """
    hot = hot_keys(findings, ["repo", "rule_id"], rows_per_task)
    numbered = join_salted(
        findings, sarif_rules(findings).drop("rule_name"), ["repo", "rule_id"], hot=hot
    )
    rows = numbered.withColumns(
        {
            "level": sarif_level(F.col("severity")),
            "uri": normal_path(F.col("file_path")),
            "message": F.concat(
                F.lit("Potential secret detected: "), F.col("rule_name"), F.lit(" ("),
                redacted(F.col("matched_text")), F.lit(")"),
            ),
        }
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.col("rule_index").alias("ruleIndex"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct("uri").alias("artifactLocation"),
                    F.when(
                        F.col("line_number").isNotNull(),
                        F.struct(F.col("line_number").alias("startLine")),
                    ).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(
            F.coalesce("commit_sha", F.lit("")).alias("commitSha"),
            F.col("commit_author").alias("commitAuthor"),
            F.col("detection_type").alias("detectionType"),
        ).alias("properties"),
    )
    return rows.withColumn("json", F.to_json(result))


def gitlab_issues(findings: DataFrame) -> DataFrame:
    """Findings with their code-quality columns; ``json`` is the issue object."""
    rows = findings.withColumns(
        {
            "gitlab_severity": gitlab_severity(F.col("severity")),
            "path": normal_path(F.col("file_path")),
            "begin": F.when(F.col("line_number") > 0, F.col("line_number")).otherwise(1),
            "description": F.concat(
                F.lit("Secret detected: "), F.col("rule_name"), F.lit(" ("),
                redacted(F.col("matched_text")), F.lit(")"),
            ),
        }
    )
    issue = F.struct(
        F.lit("issue").alias("type"),
        F.col("rule_id").alias("check_name"),
        "description",
        F.col("gitlab_severity").alias("severity"),
        "fingerprint",
        F.array(F.lit("Security")).alias("categories"),
        F.struct("path", F.struct(F.struct("begin").alias("lines")).getField("lines").alias("lines")).alias(
            "location"
        ),
    )
    return rows.withColumn("json", F.to_json(issue))


def baseline_rows(findings: DataFrame) -> DataFrame:
    """One redacted row per fingerprint (and repository): the first finding of each."""
    keys = [c for c in ("repo", "fingerprint") if c in findings.columns]
    known = [c for c in _ORDER if c in findings.columns]
    shown = ["rule_id", "rule_name", "file_path", "severity", "redacted_value", "commit_sha"]
    first = F.min(F.struct((-F.col("sev_rank")).alias("_sev"), *known, F.struct(*shown).alias("_row")))
    return (
        findings.groupBy(*keys)
        .agg(first.alias("_first"))
        .select(*keys, "_first._row.*")
        .withColumn("commit_sha", short_commit(F.col("commit_sha"), ""))
    )


# ------------------------------------------------------------------------------------
# Sinks
# ------------------------------------------------------------------------------------


def write_findings(findings: DataFrame, path: str) -> None:
    """The findings table, one folder per repository."""
    findings.write.mode("overwrite").partitionBy("repo").parquet(path)


def write_csv(findings: DataFrame, path: str, redacted_values: bool = False) -> None:
    rows = csv_rows(sorted_findings(findings), redacted_values)
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def write_baseline(findings: DataFrame, path: str) -> None:
    """Baseline rows as JSON lines; ``sources.lists.read_baseline_rows`` reads them."""
    baseline_rows(findings).write.mode("overwrite").json(path)


def document_lines(
    elements: DataFrame, heads: DataFrame, tail: str, parts: int | None = None
) -> DataFrame:
    """Lines of one JSON document per repository, range-partitioned in document order.

    ``elements`` are rows (repo, json, order columns), ``heads`` (repo, head) opens the
    document up to the list, ``tail`` closes it.  Only the first element of a
    repository goes without a comma before it; it is found by one grouped minimum and
    matched by the whole sort key, so the size of a repository does not matter.
    """
    known = [c for c in _ORDER if c in elements.columns]
    keyed = elements.select(
        "repo", F.struct((-F.col("sev_rank")).alias("sev"), *known, "json").alias("_key"), "json"
    )
    first = keyed.groupBy("repo").agg(F.min("_key").alias("_key")).withColumn("_first", F.lit(True))
    body = keyed.join(first, ["repo", "_key"], "left").select(
        "repo",
        F.lit(1).alias("_part"),
        "_key",
        F.when(F.col("_first"), F.col("json")).otherwise(F.concat(F.lit(","), "json")).alias("value"),
    )
    no_key = F.lit(None).cast(keyed.schema["_key"].dataType).alias("_key")
    opened = heads.select("repo", F.lit(0).alias("_part"), no_key, F.col("head").alias("value"))
    closed = heads.select("repo", F.lit(2).alias("_part"), no_key, F.lit(tail).alias("value"))
    order = ["repo", "_part", "_key"]
    rows = body.unionByName(opened).unionByName(closed)
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).select("repo", "value")


def write_documents(lines: DataFrame, path: str) -> None:
    """One folder per repository; its part files in name order make the document."""
    lines.write.mode("overwrite").partitionBy("repo").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(repo, kind, json) of documents that ``write_documents`` wrote: their head, their
    elements one by one and their tail, so a document of any size is read in parallel.

    Folders are listed by a few tasks for every core; by default each folder is a task.
    """
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, 4 * spark.sparkContext.defaultParallelism)
    try:
        lines = spark.read.text(path).where("value != ''")
    finally:
        spark.conf.set(_LISTING, before)
    element = F.startswith("value", F.lit("{")) & F.endswith("value", F.lit("}"))
    later = F.startswith("value", F.lit(",{"))
    return lines.select(
        F.col("repo").cast("string").alias("repo"),
        F.when(later | element, "element").when(F.length("value") < 5, "tail").otherwise("head").alias("kind"),
        F.when(later, F.substr("value", F.lit(2))).otherwise(F.col("value")).alias("json"),
    )


def json_document(
    findings: DataFrame,
    summaries: DataFrame,
    redacted_values: bool = False,
    parts: int | None = None,
    duration_seconds: float = 0.0,
) -> DataFrame:
    """JSON report per repository: scan summary and all findings."""
    scan = F.to_json(
        F.struct(
            F.lit(round(duration_seconds, 3)).alias("duration_seconds"),
            "total_commits",
            "total_files",
            "total_findings",
            F.struct(
                *[F.col(f"n_{s.lower()}").alias(s) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL")]
            ).alias("counts_by_severity"),
        )
    )
    heads = summaries.select(
        "repo", F.concat(F.lit('{"scan":'), scan, F.lit(',"findings":[')).alias("head")
    )
    return document_lines(json_findings(findings, redacted_values), heads, "]}", parts)


def sarif_document(
    findings: DataFrame, repos: DataFrame, parts: int | None = None
) -> DataFrame:
    """SARIF report per repository in ``repos``; rules in order of first appearance."""
    rules = (
        sarif_rules(findings)
        .groupBy("repo")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rule_index", "rule_id", "rule_name"))
            ).alias("_rules")
        )
        .select(
            "repo",
            F.transform(
                "_rules",
                lambda r: F.struct(
                    r["rule_id"].alias("id"),
                    r["rule_name"].alias("name"),
                    F.struct(r["rule_name"].alias("text")).alias("shortDescription"),
                ),
            ).alias("_rules"),
        )
    )
    rule_list = F.coalesce(F.to_json("_rules"), F.lit("[]"))
    heads = repos.select("repo").distinct().join(rules, "repo", "left").select(
        "repo",
        F.concat(
            F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":'
                  f'{{"name":"{TOOL_NAME}","version":"{TOOL_VERSION}","rules":'),
            rule_list,
            F.lit('}},"results":['),
        ).alias("head"),
    )
    return document_lines(sarif_results(findings), heads, "]}]}", parts)


def gitlab_document(findings: DataFrame, repos: DataFrame, parts: int | None = None) -> DataFrame:
    """Code-quality report per repository: an array of issues."""
    heads = repos.select("repo").distinct().withColumn("head", F.lit("["))
    return document_lines(gitlab_issues(findings), heads, "]", parts)


def baseline_document(
    findings: DataFrame, repos: DataFrame, parts: int | None = None, generated_at: str | None = None
) -> DataFrame:
    """Baseline per repository as one JSON document: header and redacted entries.

    ``generated_at`` is the time of the run unless given, in ISO form.
    """
    at = json.dumps(generated_at or datetime.now(timezone.utc).isoformat())
    entries = baseline_rows(findings)
    shown = [c for c in entries.columns if c != "repo"]
    elements = entries.select(
        "repo",
        severity_rank(F.col("severity")).alias("sev_rank"),
        "file_path",
        F.to_json(F.struct(*shown)).alias("json"),
    )
    sizes = entries.groupBy("repo").agg(F.count("*").alias("_n"))
    heads = repos.select("repo").distinct().join(sizes, "repo", "left").select(
        "repo",
        F.concat(
            F.lit(f'{{"version":"{TOOL_VERSION}","generator":"{TOOL_NAME}","generated_at":{at},"total_findings":'),
            F.coalesce("_n", F.lit(0)).cast("string"),
            F.lit(',"findings":['),
        ).alias("head"),
    )
    return document_lines(elements, heads, "]}", parts)
