"""Scans: from tables of commits, file versions and contents to findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.functions.findings import SEVERITIES, fingerprint, redacted
from credsieve.operators.allowlist import drop_allowed
from credsieve.operators.detect import SEEN, detect, first_per_line, raw_hits
from credsieve.operators.history import select_commits, snapshot_at
from credsieve.operators.joins import ROWS_PER_TASK, join_salted
from credsieve.operators.paths import should_scan
from credsieve.operators.snapshots import snapshot_diff
from credsieve.operators.suppress import at_least, drop_known, gate, only_known
from credsieve.options import ScanOptions
from credsieve.plans.hits import HitStore
from credsieve.rules import Rule
from credsieve.sources.files import is_text, readable_texts
from credsieve.storage import cut_lineage

Keep = Callable[[DataFrame], DataFrame] | None
# (texts, keys, text column, options, custom rules) to hits: keys and HIT_COLUMNS
Engine = Callable[[DataFrame, list[str], str, ScanOptions, "list[Rule] | DataFrame"], DataFrame]
PathFilter = Callable[[Column], Column]

FINDING_COLUMNS = [
    "repo", "rule_id", "rule_name", "severity", "sev_rank", "file_path", "line_number",
    "line_content", "matched_text", "detection_type", "entropy", "commit_sha", "commit_author",
    "commit_date", "redacted_value", "fingerprint",
]
# what sorts a report, next to the severity
ORDER_COLUMNS = ["commit_seq", "file_path", "det_rank", "rule_idx", "line_number", "pos"]

COMMIT_COLUMNS = ["commit_sha", "commit_author", "commit_date"]

# What stands for the commit of changes that are not committed yet.
PENDING_COMMIT = {
    "commit_sha": "STAGED",
    "commit_author": "Current User (Staged)",
    "commit_date": "Working Tree",
}


def _as_is(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Scan:
    """Results of a scan.

    ``findings`` are new findings, ``suppressed`` the ones the baseline knows, ``commits``
    the selected revisions, ``files`` the distinct (repo, path, blob_sha) looked at with
    the commit that brought them, ``read`` (blob_sha, is_dirty) the contents that were
    readable and whether they have raw hits.
    """

    findings: DataFrame
    suppressed: DataFrame | None
    commits: DataFrame | None
    files: DataFrame
    read: DataFrame


def described(findings: DataFrame) -> DataFrame:
    """Add the derived columns of a finding."""
    return findings.withColumns(
        {
            "redacted_value": redacted(F.col("matched_text")),
            "fingerprint": fingerprint(F.col("rule_id"), F.col("file_path"), F.col("matched_text")),
        }
    )


def judged(
    findings: DataFrame, options: ScanOptions, baseline: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """Severity floor, then the baseline: new findings and suppressed ones."""
    serious = described(at_least(findings, options.min_severity))
    if baseline is None:
        return serious, None
    return drop_known(serious, baseline), only_known(serious, baseline)


def first_occurrences(
    file_versions: DataFrame,
    commits: DataFrame,
    options: ScanOptions,
    where: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    path_filter: PathFilter | None = None,
) -> DataFrame:
    """(repo, path, blob_sha) of scannable files with the earliest commit that has them.

    Of commits with one commit_seq, as on two branches, the smallest sha counts.  Sha,
    author and date come along, so findings need no look-up of their commit later.
    Contents play no part here; the key columns are all that is shuffled.
    """
    chosen = path_filter(F.col("path")) if path_filter else should_scan(F.col("path"), options)
    wanted = chosen & (F.col("change_type") != "D")
    if where is not None:
        wanted = wanted & where
    date = F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ssxxx")
    return (
        join_salted(
            file_versions.where(wanted).select("repo", "commit_sha", "path", "blob_sha"),
            commits.select(
                "repo", "commit_sha", "commit_seq", F.col("author").alias("commit_author"), date.alias("commit_date")
            ),
            ["repo", "commit_sha"],
            rows_per_task=rows_per_task,
        )
        .groupBy("repo", "path", "blob_sha")
        .agg(F.min(F.struct("commit_seq", *COMMIT_COLUMNS)).alias("c"))
        .select("repo", "path", "blob_sha", "c.*")
    )


def findings_of_files(
    files: DataFrame,
    hits: DataFrame,
    allowlist: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Give the hits of a blob to every file that holds it; keep first sightings.

    The allowlist comes after the blobs: what is allowed in one place is still found
    in a copy elsewhere.
    """
    placed = join_salted(files, hits, ["blob_sha"], rows_per_task=rows_per_task)
    placed = placed.withColumnRenamed("path", "file_path").drop("blob_sha")
    found = first_per_line(placed, ["repo", "file_path"], ["commit_seq", "commit_sha"])
    # hits of one line and text are allowed or not together
    return drop_allowed(found, allowlist)


def hits_of_contents(
    blobs: DataFrame,
    options: ScanOptions,
    custom_rules: list[Rule] | DataFrame,
    keep: Keep,
    store: HitStore | None,
    engine: Engine | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Hits of the contents, and which contents were readable: one pass over those that the
    store does not know."""
    if engine is not None:
        if store is not None:
            raise ValueError("a store holds hits of the own engine")
        texts = readable_texts(blobs, options)
        hits = keep(first_per_line(engine(texts, ["blob_sha"], "text", options, custom_rules), ["blob_sha"]))
        dirty = hits.select("blob_sha", F.lit(True).alias("is_dirty")).distinct()
        read = texts.select("blob_sha").join(dirty, "blob_sha", "left")
        return hits, read.select("blob_sha", F.coalesce("is_dirty", F.lit(False)).alias("is_dirty"))
    if store is None:
        every = keep(detect(readable_texts(blobs, options), ["blob_sha"], "text", options, custom_rules, seen=True))
    else:
        every = store.hits_of(blobs, options, custom_rules)
    hits = every.where(F.col("det_rank") != SEEN)
    read = every.groupBy("blob_sha").agg(F.max(F.col("det_rank") != SEEN).alias("is_dirty"))
    return hits, read


def scan_history(
    commits: DataFrame,
    file_versions: DataFrame,
    blobs: DataFrame,
    options: ScanOptions | None = None,
    allowlist: DataFrame | None = None,
    baseline: DataFrame | None = None,
    custom_rules: list[Rule] | DataFrame = (),
    head: DataFrame | None = None,
    where: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    keep: Keep = cut_lineage,
    store: HitStore | None = None,
    engine: Engine | None = None,
    path_filter: PathFilter | None = None,
) -> Scan:
    """Scan the history of one or many repositories.

    Every blob is read and searched once, in one narrow pass.  ``keep`` stores the two
    tables that several results are computed from, the distinct files and the hits; with
    ``keep=None`` they are computed wherever they are used and nothing runs here.  With
    head_only the whole tree of the head is scanned, not what its commit changed, and the
    head stands as the commit of all findings.  Contents that ``store`` knows are not read.
    ``engine`` finds hits in the place of the own detectors, ``path_filter`` chooses paths in
    the place of the options' globs.
    """
    options = options or ScanOptions()
    selected = select_commits(commits, options, head)
    keep = keep or _as_is
    if options.head_only:
        tree = snapshot_at(commits, file_versions, head)
        file_versions = tree.join(selected.select("repo", "commit_sha"), "repo").withColumn(
            "change_type", F.lit("A")
        )
    files = keep(first_occurrences(file_versions, selected, options, where, rows_per_task, path_filter))
    if options.head_only or options.diff_base or options.since_commit:
        # a part of the history: leave out contents it does not refer to
        blobs = blobs.join(files.select("blob_sha").distinct(), "blob_sha", "left_semi")
    hits, read = hits_of_contents(blobs, options, custom_rules, keep, store, engine)
    found = findings_of_files(files, hits, allowlist, rows_per_task)
    new, known = judged(found, options, baseline)
    return Scan(new, known, selected, files, read)


def scan_pending(
    pending: DataFrame,
    head_tree: DataFrame,
    blobs: DataFrame,
    options: ScanOptions | None = None,
    allowlist: DataFrame | None = None,
    baseline: DataFrame | None = None,
    custom_rules: list[Rule] | DataFrame = (),
    keep: Keep = cut_lineage,
    store: HitStore | None = None,
) -> Scan:
    """Scan what a pending tree changes against the head; all of it if there is no head."""
    options = options or ScanOptions()
    keep = keep or _as_is
    changes = snapshot_diff(pending, head_tree)
    files = keep(
        changes.where(should_scan(F.col("path"), options))
        .select("repo", "path", "blob_sha")
        .distinct()
        .withColumns({"commit_seq": F.lit(0).cast("bigint"), **{n: F.lit(v) for n, v in PENDING_COMMIT.items()}})
    )
    blobs = blobs.join(files.select("blob_sha").distinct(), "blob_sha", "left_semi")
    hits, read = hits_of_contents(blobs, options, custom_rules, keep, store)
    new, known = judged(findings_of_files(files, hits, allowlist), options, baseline)
    return Scan(new, known, None, files, read)


def scan_texts(
    texts: DataFrame,
    options: ScanOptions | None = None,
    allowlist: DataFrame | None = None,
    baseline: DataFrame | None = None,
    custom_rules: list[Rule] | DataFrame = (),
    engine: Engine = raw_hits,
    path_filter: PathFilter | None = None,
) -> DataFrame:
    """Findings of any table (repo, path, text), optionally with commit_seq, commit_sha,
    commit_author and commit_date; without contents shared between rows, nothing but
    findings is shuffled.

    ``engine`` finds hits in the place of the own detectors, ``path_filter`` chooses paths in
    the place of the options' globs.
    """
    options = options or ScanOptions()
    blank = {"commit_sha": "", "commit_author": "", "commit_date": ""}
    for name, value in blank.items():
        if name not in texts.columns:
            texts = texts.withColumn(name, F.lit(value))
    if "commit_seq" not in texts.columns:
        texts = texts.withColumn("commit_seq", F.lit(0).cast("bigint"))
    chosen = path_filter(F.col("path")) if path_filter else should_scan(F.col("path"), options)
    texts = texts.where(chosen & is_text(F.col("text"), options))
    texts = texts.withColumnRenamed("path", "file_path")
    carried = ["repo", "file_path", "commit_seq", *blank]
    hits = engine(texts, carried, "text", options, custom_rules)
    found = drop_allowed(first_per_line(hits, ["repo", "file_path"], ["commit_seq"]), allowlist)
    return judged(found, options, baseline)[0]


@dataclass(frozen=True)
class Result:
    """A scan as its options want it: findings (redacted if asked for) and the gate's row."""

    scan: Scan
    findings: DataFrame
    gate: DataFrame


def scan(
    commits: DataFrame,
    file_versions: DataFrame,
    blobs: DataFrame,
    options: ScanOptions | None = None,
    allowlist: DataFrame | None = None,
    baseline: DataFrame | None = None,
    custom_rules: list[Rule] | DataFrame = (),
    head: DataFrame | None = None,
    pending_tree: DataFrame | None = None,
    keep: Keep = cut_lineage,
    store: HitStore | None = None,
) -> Result:
    """Scan what the options name; the first one set wins: pending, head_only, diff_base,
    since_commit.  Without any of them it is the whole history.

    ``pending_tree`` (repo, path, blob_sha) is the tree whose changes against the head
    ``pending`` looks at.
    """
    options = options or ScanOptions()
    if options.pending:
        if pending_tree is None:
            raise ValueError("the option pending needs a pending_tree")
        tree = snapshot_at(commits, file_versions, head)
        done = scan_pending(pending_tree, tree, blobs, options, allowlist, baseline, custom_rules, keep, store)
    else:
        done = scan_history(
            commits, file_versions, blobs, options, allowlist, baseline, custom_rules, head, keep=keep, store=store
        )
    from credsieve.plans.reports import redact

    found = redact(done.findings, lines=True) if options.redact else done.findings
    return Result(done, found, gate(done.findings, options.fail_on_severity))


def summary(scan: Scan) -> DataFrame:
    """Commits, files, findings per severity and suppressed findings of each repository.

    A file counts if it was read, or if it repeats a blob with hits; repeats of clean
    blobs, binary and oversized files do not.  What was readable the scan has found out on
    its way; no content is read here.
    """
    state = scan.read.withColumnRenamed("is_dirty", "_dirty")
    seen = join_salted(scan.files, state, ["blob_sha"])
    # clean blobs are made distinct first, so that one with many copies costs one row
    clean = seen.where(~F.col("_dirty")).select("repo", "blob_sha").distinct()
    out = (
        clean.select("repo")
        .unionByName(seen.where("_dirty").select("repo"))
        .groupBy("repo")
        .agg(F.count("*").alias("total_files"))
    )
    counts = [
        F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in reversed(SEVERITIES)
    ]
    of_findings = scan.findings.groupBy("repo").agg(F.count("*").alias("total_findings"), *counts)
    out = out.join(of_findings, "repo", "full")
    none = F.lit(0).cast("bigint")
    if scan.commits is not None:
        of_commits = scan.commits.groupBy("repo").agg(F.count("*").alias("total_commits"))
        out = out.join(of_commits, "repo", "full")
    else:
        out = out.withColumn("total_commits", none)
    if scan.suppressed is not None:
        of_known = scan.suppressed.groupBy("repo").agg(F.count("*").alias("suppressed"))
        out = out.join(of_known, "repo", "full")
    else:
        out = out.withColumn("suppressed", none)
    return out.na.fill(0)


def totals(summaries: DataFrame) -> DataFrame:
    """One row over all repositories."""
    return summaries.agg(*[F.sum(c).alias(c) for c in summaries.columns if c != "repo"])
