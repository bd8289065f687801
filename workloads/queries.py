"""One query per operator of the engine, over the given tables with planted lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.functions.entropy import base64_entropy, encoding_class, hex_entropy, shannon_entropy
from credsieve.functions.findings import one_line
from credsieve.functions.text import base_name, normal_path
from credsieve.functions.values import is_noise_line, is_valid_secret
from credsieve.operators.allowlist import drop_allowed
from credsieve.operators.detect import assignments, detect, is_ignored, raw_hits, scan_lines
from credsieve.operators.history import commit_range, numbered, select_commits, snapshot_at
from credsieve.operators.reachability import CommitIndex
from credsieve.operators.paths import path_of_url, should_scan
from credsieve.operators.snapshots import directory_hashes, snapshot_diff, snapshot_diff_by_hashes
from credsieve.operators.suppress import (
    at_least,
    drop_known,
    gate,
    only_known,
    severity_counts,
)
from credsieve.options import EXCLUDED_PATHS, ScanOptions
from credsieve.plans import reports
from credsieve.plans.hits import HitStore
from credsieve.plans.scan import (
    described,
    scan,
    scan_history,
    scan_pending,
    scan_texts,
    summary,
    totals,
)
from credsieve.rules import Rule
from credsieve.sources.files import readable_texts
from credsieve.sources.lists import parse_allowlist, parse_baseline
from credsieve.sources.rules import check_rules
from credsieve.storage import cut_lineage, work_folder
from workloads import planted

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ONLY_RULES = ScanOptions(use_keywords=False, use_entropy=False)
ONLY_ENTROPY = ScanOptions(use_builtin_rules=False, use_keywords=False)
ONLY_KEYWORDS = ScanOptions(use_builtin_rules=False, use_entropy=False)
CUSTOM_KEYWORDS = ScanOptions(
    use_builtin_rules=False, use_entropy=False, keywords=["my_token", "PWD", "token", "the"],
    keyword_case_sensitive=True, min_value_length=10, extra_stop_values=["PROD_FFFF"],
)
CUSTOM_RULES = [
    Rule("prod-value", "Prod value", "HIGH", r"prod_[0-9a-f]{20}", ["prod_"]),
    Rule("phone", "Phone number", "LOW", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    Rule("same-value", "Value in a JSON pair", "MEDIUM", r'"api_key": "[0-9a-f]+"'),
]


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def whole(df: DataFrame, *names: str) -> DataFrame:
    """Integer columns as bigint, so that both engines have the same types."""
    return df.select(*[
        F.col(n).cast("bigint").alias(n) if dict(df.dtypes)[n] in ("int", "tinyint") else F.col(n)
        for n in (names or df.columns)
    ])


def doc_findings(spark: SparkSession, sf_dir: str, options: ScanOptions | None = None) -> DataFrame:
    return scan_texts(planted.documents(spark, sf_dir), options)


SHOWN = [
    "repo", "file_path", "line_number", "rule_id", "rule_name", "severity", "matched_text",
    "detection_type",
]


def shown(findings: DataFrame) -> DataFrame:
    return whole(findings.withColumn("entropy", F.round("entropy", 6)), *SHOWN, "entropy")


# ---- detectors --------------------------------------------------------------------


@query
def keyword_scan(spark, sf_dir):
    found = assignments(planted.documents(spark, sf_dir), ["doc_id"], "text", ONLY_KEYWORDS)
    return whole(found, "doc_id", "line_number", "line_content", "keyword", "value", "form")


@query
def keyword_options(spark, sf_dir):
    found = assignments(planted.documents(spark, sf_dir), ["doc_id"], "text", CUSTOM_KEYWORDS)
    return whole(found, "doc_id", "line_number", "keyword", "value", "form")


def words(spark, sf_dir) -> DataFrame:
    text = F.regexp_replace("text", r"[\s\"']+", " ")
    docs = planted.documents(spark, sf_dir)
    return docs.select(F.explode(F.split(text, " ")).alias("word")).distinct()


@query
def value_filter(spark, sf_dir):
    pairs = planted.documents(spark, sf_dir).select(
        F.explode(F.split("text", "\n")).alias("line")
    )
    values = pairs.select(F.explode(F.split("line", "[=,:] *")).alias("value"))
    values = values.unionByName(words(spark, sf_dir).select(F.col("word").alias("value")))
    return values.distinct().select("value", is_valid_secret(F.col("value")).alias("valid"))


@query
def noise_lines(spark, sf_dir):
    docs = planted.documents(spark, sf_dir)
    prefix = F.element_at(
        F.array(*[F.lit(p) for p in NOISE_STARTS]), (F.col("doc_id") % len(NOISE_STARTS) + 1).cast("int")
    )
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"), prefix.alias("p"))
    every = lines.select("line").unionByName(lines.select(F.concat("p", "line").alias("line")))
    return every.distinct().select("line", is_noise_line(F.col("line")).alias("noise"))


NOISE_STARTS = ["  // ", "#", "def f (x): ", "static  ", "import ", "x) -> ", "f(x): ", "class ", "  ", "-- "]


@query
def shannon(spark, sf_dir):
    return words(spark, sf_dir).select(
        "word", F.round(shannon_entropy(F.col("word")), 6).alias("bits")
    )


@query
def class_entropy(spark, sf_dir):
    word = F.col("word")
    return words(spark, sf_dir).select(
        "word",
        F.round(hex_entropy(word), 6).alias("hex_bits"),
        F.round(base64_entropy(word), 6).alias("base64_bits"),
        encoding_class(word).alias("encoding"),
    )


def _entropy_rows(found: DataFrame, *keys: str) -> DataFrame:
    bits = F.round("entropy", 6).alias("bits")
    return whole(found.select(*keys, "line_number", "rule_id", "matched_text", bits))


@query
def entropy_scan(spark, sf_dir):
    docs = planted.documents(spark, sf_dir).select("path", "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("text")
    )
    return _entropy_rows(detect(docs.unionByName(pages), ["path"], "text", ONLY_ENTROPY), "path")


@query
def entropy_overlap_low_threshold(spark, sf_dir):
    options = ScanOptions(use_builtin_rules=False, use_keywords=False, base64_threshold=3.8)
    docs = planted.documents(spark, sf_dir).select("path", "text")
    return _entropy_rows(detect(docs, ["path"], "text", options), "path")


def _rule_rows(found: DataFrame) -> DataFrame:
    return whole(found, "doc_id", "line_number", "line_content", "rule_id", "rule_name", "severity", "matched_text")


def _rule_scan(spark, sf_dir, multiline: bool) -> DataFrame:
    hits = raw_hits(planted.documents(spark, sf_dir), ["doc_id"], "text", ONLY_RULES)
    chosen = F.col("rule_id").isin(sorted(MULTILINE_RULES))
    return _rule_rows(hits.where(chosen if multiline else ~chosen))


MULTILINE_RULES = {
    "gcp-service-account", "google-oauth-client-secret", "azure-subscription-key",
    "azure-connection-string", "heroku-api-key",
}


@query
def pattern_scan_line(spark, sf_dir):
    return _rule_scan(spark, sf_dir, False)


@query
def pattern_scan_multiline(spark, sf_dir):
    return _rule_scan(spark, sf_dir, True)


@query
def custom_rules(spark, sf_dir):
    options = ScanOptions(use_keywords=False, use_entropy=False)
    found = detect(planted.documents(spark, sf_dir), ["doc_id"], "text", options, CUSTOM_RULES)
    return _rule_rows(found)


@query
def line_matches(spark, sf_dir):
    """Rules over single lines that bring their own numbers, with the places of the matches."""
    docs = planted.documents(spark, sf_dir)
    lines = docs.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select(
        "path", (F.col("i") * 10 + 7).alias("line_number"), "line"
    )
    found = scan_lines(lines, ["path", "line_number"])
    return whole(found, "path", "line_number", "rule_id", "severity", "line_content", "matched_text", "start", "end")


@query
def python_rules(spark, sf_dir):
    """A rule with a conditional group, which only Python can run."""
    options = ScanOptions(use_builtin_rules=False, use_keywords=False, use_entropy=False)
    rule = Rule("conditional", "Conditional", "LOW", r'(token)?(?(1) = "| note)')
    assert rule.java is None
    return _rule_rows(detect(planted.documents(spark, sf_dir), ["doc_id"], "text", options, [rule]))


def rule_table(spark, sf_dir) -> DataFrame:
    """A rule per document, most of them after a value planted in it; some are no rules."""
    docs = planted.documents(spark, sf_dir)
    n, h = F.col("doc_id"), F.sha2(F.col("doc_id").cast("string"), 256)
    kind = n % 8
    pattern = (
        F.when(n == 4, F.lit("[a-f0-9]{64}"))
        .when(kind == 0, F.concat(F.lit("prod_"), F.substring(h, 1, 6), F.lit("[0-9a-f]+")))
        .when(kind == 1, F.concat(F.lit("(?i)SUM "), F.upper(F.substring(h, 1, 8)), F.lit("[0-9A-F]{4}")))
        .when(kind == 2, F.lit("[unclosed"))
        .when(kind == 3, F.concat(F.lit("(~~)?(?(1)~|ghp_"), F.substring(h, 1, 6), F.lit(")")))
        .when(kind == 4, F.lit(""))
        .otherwise(F.concat(F.lit('db_password = "'), F.substring(h, 1, 2)))
    )
    return docs.select(
        n.alias("rule_idx"),
        F.when(kind != 6, F.concat(F.lit("rule-"), n.cast("string"))).alias("id"),
        pattern.alias("pattern"),
        F.when(kind == 5, F.lit("odd")).when(kind == 1, F.lit("low")).otherwise(F.lit("high")).alias("severity"),
    )


@query
def rule_rows(spark, sf_dir):
    """Rule rows that grow with the data, from the table to findings."""
    options = ScanOptions(use_builtin_rules=False, use_keywords=False, use_entropy=False)
    found = detect(planted.documents(spark, sf_dir), ["path"], "text", options, rule_table(spark, sf_dir))
    return whole(found, "path", "line_number", "rule_id", "rule_name", "severity", "matched_text")


@query
def rule_validation(spark, sf_dir):
    docs = planted.documents(spark, sf_dir)
    n = F.col("doc_id") % 7
    text = F.col("doc_id").cast("string")
    rows = docs.select(
        F.when(n != 3, F.concat(F.lit("rule-"), text)).alias("id"),
        F.when(n != 4, F.concat(F.lit("Rule "), text)).alias("name"),
        F.when(n == 1, F.lit("[unclosed")).when(n == 5, F.lit("")).otherwise(F.concat(F.lit("x{2}"), text)).alias("pattern"),
        F.when(n == 2, F.lit("odd")).when(n != 6, F.lit("high")).alias("severity"),
    )
    checked = check_rules(rows)
    return checked.select(
        "id", "name", "pattern", "severity", F.col("problem").isNull().alias("valid"),
        F.substring_index("problem", " ", 2).alias("reason"),
    )


@query
def detect_all(spark, sf_dir):
    return shown(doc_findings(spark, sf_dir))


def even_lengths(texts, keys, text, options, custom_rules):
    """An engine of one's own: the detectors' hits of even length."""
    return raw_hits(texts, keys, text, options, custom_rules).where(F.length("matched_text") % 2 == 0)


@query
def injected_engine(spark, sf_dir):
    """A scan with an engine and a path filter handed in."""
    english = lambda path: F.startswith(path, F.lit("en/"))
    return shown(scan_texts(planted.documents(spark, sf_dir), engine=even_lengths, path_filter=english))


def with_marker(docs: DataFrame) -> DataFrame:
    """The texts of paths with an inline marker in one of their texts.

    Of the others both passes find the same, so they are read for the marker only.  A null
    path equals no other, so all of its findings stay.
    """
    marked = docs.where(is_ignored(F.col("text"), ScanOptions()) & F.col("path").isNotNull())
    some = docs.join(marked.select("path").distinct(), "path", "left_semi").select(*docs.columns)
    return some.unionByName(docs.where(F.col("path").isNull()))


@query
def inline_ignore(spark, sf_dir):
    docs = with_marker(planted.documents(spark, sf_dir))
    every = detect(docs, ["path"], "text", ScanOptions(ignore_markers=[]))
    kept = detect(docs, ["path"], "text").select("path", "line_number", "matched_text")
    dropped = every.join(kept, ["path", "line_number", "matched_text"], "left_anti")
    return whole(dropped, "path", "line_number", "rule_id", "matched_text")


# ---- files and paths --------------------------------------------------------------


def paths(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = path_of_url(F.col("url"))
    endings = F.array(*[F.lit(e) for e in PATH_ENDINGS])
    heads = F.array(*[F.lit(h) for h in PATH_HEADS])
    return pages.select(
        F.concat(
            F.element_at(heads, (F.col("page_id") % len(PATH_HEADS) + 1).cast("int")),
            url,
            F.element_at(endings, (F.col("page_id") % len(PATH_ENDINGS) + 1).cast("int")),
        ).alias("path")
    ).unionByName(planted.documents(spark, sf_dir).select("path")).distinct()


PATH_ENDINGS = [".py", ".min.js", "/yarn.lock", ".png", "/.env.example", "/go.sum", ".txt", ".PNG", "/x.tar.gz",
                "\\b\\c.lock", "/poetry.lock"]
PATH_HEADS = ["", "node_modules/", "a/node_modules/", "vendor/", "src/", "build/", "x\\"]


@query
def path_filter(spark, sf_dir):
    path = F.col("path")
    return paths(spark, sf_dir).select(
        "path", base_name(normal_path(path)).alias("name"), should_scan(path).alias("scanned")
    )


@query
def path_filter_custom(spark, sf_dir):
    options = ScanOptions(exclude_paths=["*.txt", "src/*", "*.lock"], include_paths=["poetry.lock", "en/1*"])
    return paths(spark, sf_dir).select("path", should_scan(F.col("path"), options).alias("scanned"))


@query
def readable_files(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n, html = F.col("page_id"), F.encode("html", "utf-8")
    nul = F.lit(bytearray(b"\x00"))
    content = (
        F.when(n % 5 == 1, F.concat(html, nul))
        .when(n % 5 == 2, F.concat(F.substring(html, 1, 100), nul, html))
        .when(n % 5 == 3, F.concat(html, F.lit(bytearray(b" bad \xff\xfe end"))))
        .otherwise(html)
    )
    blobs = pages.select(n.cast("string").alias("blob_sha"), content.alias("content"))
    texts = readable_texts(blobs, ScanOptions(max_file_size=9000))
    return texts.select(
        F.col("blob_sha").alias("page"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("text", 256).alias("digest"),
    )


# ---- lists and judgement ----------------------------------------------------------


def allow_entries(spark, sf_dir) -> DataFrame:
    docs = planted.document_ids(spark, sf_dir)
    n, h = F.col("doc_id"), F.sha2(F.col("doc_id").cast("string"), 256)
    line = (
        F.when(n % 6 == 0, F.concat(F.lit("  # note "), h))
        .when(n % 6 == 1, F.concat(F.substring(h, 1, 12), F.lit("  # known value")))
        .when(n % 6 == 2, F.concat(F.lit("scope:en/* regex:^AC"), F.substring(h, 1, 8)))
        .when(n % 6 == 3, F.concat(F.lit("regex: "), F.substring(h, 1, 6), F.lit(".*$ #r")))
        .when(n % 6 == 4, F.concat(F.lit("scope:"), F.substring(h, 1, 6)))
        .otherwise(F.concat(F.lit("scope:*.txt "), F.substring(h, 1, 10)))
    )
    return docs.select(line.alias("value"))


@query
def allowlist_parse(spark, sf_dir):
    return parse_allowlist(allow_entries(spark, sf_dir))


ALLOW_ROWS = [
    ("known value", "de/*", False), ("prod_", None, False), ("^AKIA[0-9A-F]{4}", "en/*", True),
    ("deadbeef", None, False), ("[0-9a-f]{30,}$", "*7.txt", True), ("[broken", None, True), ("", None, False),
]


@query
def allowlist(spark, sf_dir):
    entries = spark.createDataFrame(ALLOW_ROWS, "pattern string, scope string, is_regex boolean")
    return shown(scan_texts(planted.documents(spark, sf_dir), allowlist=entries))


@query
def allowlist_long(spark, sf_dir):
    """An allowlist that grows with the data, with regexes only Python can run and bad ones."""
    odd = [(r"(a)?(?(1)b|zzzqqq)", "fr/*", True), ("[broken", None, True), ("(", "en/*", True), ("", None, False)]
    more = spark.createDataFrame(odd, "pattern string, scope string, is_regex boolean")
    entries = parse_allowlist(allow_entries(spark, sf_dir)).select("pattern", "scope", "is_regex").unionByName(more)
    return shown(drop_allowed(doc_findings(spark, sf_dir), entries))


@query
def min_severity(spark, sf_dir):
    return shown(doc_findings(spark, sf_dir, ScanOptions(min_severity="high")))


@query
def gates(spark, sf_dir):
    found = cut_lineage(doc_findings(spark, sf_dir).select("repo", "sev_rank"))
    rows = [
        gate(found.where(where), level).select(F.lit(name).alias("gate"), "*")
        for name, level, where in (
            ("any", None, "true"), ("critical", "critical", "true"), ("none", "critical", "sev_rank < 3")
        )
    ]
    return whole(rows[0].unionByName(rows[1]).unionByName(rows[2]))


def _known(findings: DataFrame) -> DataFrame:
    """A baseline of the findings whose fingerprint starts with a digit."""
    return findings.where(F.col("fingerprint") < "a").select("repo", "fingerprint").distinct()


@query
def baseline_filter(spark, sf_dir):
    found = cut_lineage(doc_findings(spark, sf_dir))
    baseline = _known(found)
    new = drop_known(found, baseline).select(F.lit("new").alias("state"), "repo", "file_path", "line_number", "fingerprint")
    old = only_known(found, baseline).select(F.lit("suppressed").alias("state"), "repo", "file_path", "line_number", "fingerprint")
    return whole(new.unionByName(old))


@query
def baseline_write(spark, sf_dir):
    found = cut_lineage(doc_findings(spark, sf_dir, ScanOptions(min_severity="MEDIUM")))
    return whole(reports.baseline_rows(drop_known(found, _known(found))))


# ---- histories --------------------------------------------------------------------


@query
def commit_ranges(spark, sf_dir):
    """Per conversation: commits after turn 1 that are not its ancestors."""
    commits = planted.commits(spark, sf_dir)
    bases = commits.where("commit_seq = 1").select("repo", "commit_sha")
    return whole(commit_range(commits, bases), "repo", "commit_sha", "commit_seq", "author")


@query
def commit_index(spark, sf_dir):
    """Several ranges of each repository from an index that was built and then extended."""
    commits = cut_lineage(planted.commits(spark, sf_dir))
    index = CommitIndex(spark, f"{work_folder(spark)}/index-{uuid.uuid4().hex}")
    for part in ("commit_seq < 2", "commit_seq < 4", "true"):
        index.extend(commits.where(part))
    # up to every third commit, from the start, from two and from four commits before
    name = commits.groupBy("repo").agg(F.max("commit_seq").alias("last"))
    asked = commits.join(name, "repo").where("commit_seq % 3 = 2 OR commit_seq = last").select(
        "repo", F.col("commit_seq").alias("to"), F.col("commit_sha").alias("head"), F.explode(F.array(F.lit(0), F.lit(2), F.lit(4))).alias("back")
    )
    at = commits.select("repo", F.col("commit_seq").alias("_seq"), F.col("commit_sha").alias("base"))
    asked = asked.withColumn("_seq", F.when(F.col("back") > 0, F.col("to") - F.col("back"))).join(at, ["repo", "_seq"], "left")
    asked = asked.withColumn("range_id", F.concat_ws("-", F.col("back").cast("string"), F.col("to").cast("string")))
    return index.ranges(asked)


@query
def commit_numbers(spark, sf_dir):
    """commit_seq of linear histories from their commit times."""
    commits = planted.commits(spark, sf_dir).drop("commit_seq")
    return whole(numbered(commits), "repo", "commit_sha", "commit_seq")


@query
def head_tree(spark, sf_dir):
    """Files of the newest commit, from the changes along its first-parent line."""
    return snapshot_at(planted.commits(spark, sf_dir), planted.file_versions(spark, sf_dir))


@query
def head_only(spark, sf_dir):
    commits = planted.commits(spark, sf_dir)
    return whole(select_commits(commits, ScanOptions(head_only=True)), "repo", "commit_sha", "commit_seq")


@query
def head_scan(spark, sf_dir):
    """The whole tree of the newest commit, by the options."""
    found = scan(
        planted.commits(spark, sf_dir), planted.file_versions(spark, sf_dir), planted.blobs(spark, sf_dir),
        ScanOptions(head_only=True, diff_base="none"),
    ).findings
    return whole(found, "repo", "file_path", "line_number", "rule_id", "severity", "matched_text", "commit_sha")


@query
def snapshot_changes(spark, sf_dir):
    return snapshot_diff(
        planted.tree(spark, sf_dir, 0), planted.tree(spark, sf_dir, 2), with_deleted=True
    )


@query
def tree_changes(spark, sf_dir):
    """Changes of one large tree, every second directory of which is as it was, by directory hashes."""
    before, after = planted.tree(spark, sf_dir, 2), planted.tree(spark, sf_dir, 0)
    even = F.substr("repo", F.lit(5)).cast("bigint") % 2 == 0
    new = after.where(even).unionByName(before.where(~even))

    def one(tree: DataFrame) -> DataFrame:
        return cut_lineage(tree.select(F.lit("all").alias("repo"), F.concat_ws("/", "repo", "path").alias("path"), "blob_sha"))

    new, old = one(new), one(before)
    return snapshot_diff_by_hashes(new, old, directory_hashes(new), directory_hashes(old), with_deleted=True)


@query
def pending(spark, sf_dir):
    scan = scan_pending(
        planted.tree(spark, sf_dir, 0), planted.tree(spark, sf_dir, 2), planted.blobs(spark, sf_dir)
    )
    return whole(
        scan.findings, "repo", "file_path", "line_number", "rule_id", "matched_text", "commit_author",
        "commit_date",
    )


def history(spark, sf_dir, **kw):
    kw.setdefault("options", ScanOptions(exclude_paths=["vendor/*"]))
    return scan_history(
        planted.commits(spark, sf_dir), planted.file_versions(spark, sf_dir), planted.blobs(spark, sf_dir),
        **kw,
    )


@query
def history_scan(spark, sf_dir):
    found = history(spark, sf_dir).findings
    return whole(
        found, "repo", "file_path", "line_number", "rule_id", "severity", "matched_text", "commit_sha",
        "commit_author", "commit_date", "redacted_value", "fingerprint",
    )


@query
def rescan(spark, sf_dir):
    """The history scanned a second time, when most of its contents are known already."""
    store = HitStore(spark, f"{work_folder(spark)}/hits-{uuid.uuid4().hex}")
    early = planted.commits(spark, sf_dir).where("commit_seq < 3")
    options = ScanOptions(exclude_paths=["vendor/*"])
    versions, blobs = planted.file_versions(spark, sf_dir), planted.blobs(spark, sf_dir)
    known = versions.join(early.select("repo", "commit_sha"), ["repo", "commit_sha"], "left_semi")
    some = blobs.join(known.select("blob_sha").distinct(), "blob_sha", "left_semi")
    scan_history(early, known, some, options, store=store)
    found = history(spark, sf_dir, store=store).findings
    return whole(found, "repo", "file_path", "line_number", "rule_id", "matched_text", "commit_sha", "fingerprint")


@query
def history_lines(spark, sf_dir):
    """Files a predicate chooses, each finding as one line with its short commit."""
    found = history(spark, sf_dir, where=F.startswith("path", F.lit("docs/"))).findings
    text = one_line(
        F.col("severity"), F.col("rule_name"), F.col("file_path"), F.col("line_number"),
        F.col("matched_text"), F.col("commit_sha"),
    )
    return whole(found.withColumn("summary", text), "repo", "summary", "fingerprint")


@query
def blob_reuse(spark, sf_dir):
    """What is allowed in the turn files is still found in copies under docs/."""
    entries = spark.createDataFrame([("-", "turn*", False), ("a", "turn*", False)], "pattern string, scope string, is_regex boolean")
    found = history(spark, sf_dir, allowlist=entries).findings
    return whole(found, "repo", "file_path", "line_number", "rule_id", "matched_text", "commit_sha")


@query
def range_scan(spark, sf_dir):
    """Only what conversation 1 added after its first turn."""
    commits = planted.commits(spark, sf_dir)
    first = commits.where("commit_seq = 0").select("repo", "commit_sha")
    selected = commit_range(commits, first)
    scan = scan_history(selected, planted.file_versions(spark, sf_dir), planted.blobs(spark, sf_dir))
    return whole(scan.findings, "repo", "file_path", "line_number", "rule_id", "matched_text", "commit_sha")


# ---- summaries and reports ---------------------------------------------------------


@query
def scan_summary(spark, sf_dir):
    scan = history(spark, sf_dir)
    return whole(summary(scan))


@query
def baseline_documents(spark, sf_dir):
    """Baselines read from JSON documents, entries as objects or plain strings."""
    found = cut_lineage(doc_findings(spark, sf_dir))
    known = found.where("fingerprint < '8'").groupBy("repo", F.substring("fingerprint", 1, 1).alias("first"))
    objects = F.to_json(F.struct(F.collect_list(F.struct("fingerprint", "rule_id")).alias("findings")))
    plain = F.to_json(F.struct(F.collect_list("fingerprint").alias("findings")))
    documents = known.agg(F.when(F.col("first") < "4", objects).otherwise(plain).alias("value"))
    left = drop_known(found, parse_baseline(documents))
    return whole(left, "repo", "file_path", "line_number", "fingerprint")


@query
def suppressed_summary(spark, sf_dir):
    """Findings and suppressed findings of each repository when a baseline knows some."""
    known = history(spark, sf_dir).findings.where("fingerprint < '4'").select("repo", "fingerprint")
    scan = history(spark, sf_dir, baseline=cut_lineage(known))
    return whole(summary(scan), "repo", "total_findings", "suppressed")


@query
def scan_totals(spark, sf_dir):
    scan = history(spark, sf_dir)
    return whole(totals(summary(scan)))


@query
def severities(spark, sf_dir):
    return whole(severity_counts(doc_findings(spark, sf_dir)))


@query
def findings_report(spark, sf_dir):
    found = doc_findings(spark, sf_dir)
    text: Column = one_line(
        F.col("severity"), F.col("rule_name"), F.col("file_path"), F.col("line_number"),
        F.col("matched_text"), F.col("commit_sha"),
    )
    rows = reports.with_position(found).withColumn("summary", text)
    return whole(rows, "position", "repo", "file_path", "line_number", "line_content", "sev_rank", "redacted_value", "fingerprint", "summary")


@query
def csv_report(spark, sf_dir):
    found = doc_findings(spark, sf_dir)
    # some values are made to look like formulas
    odd = found.withColumn(
        "matched_text",
        F.when(F.col("line_number") % 3 == 0, F.concat(F.lit("="), "matched_text")).otherwise(F.col("matched_text")),
    )
    return whole(reports.csv_rows(odd))


@query
def redacted_json(spark, sf_dir):
    found = reports.json_findings(doc_findings(spark, sf_dir), redacted_values=True)
    fields = ["rule_id", "file_path", "line_content", "matched_text", "redacted_value", "fingerprint", "line_number"]
    return found.select("repo", *[F.get_json_object("json", f"$.{f}").alias(f) for f in fields])


@query
def sarif_report(spark, sf_dir):
    rows = reports.sarif_results(cut_lineage(doc_findings(spark, sf_dir)))
    path = {
        "rule_id": "$.ruleId", "rule_index": "$.ruleIndex", "level": "$.level", "message": "$.message.text",
        "uri": "$.locations[0].physicalLocation.artifactLocation.uri",
        "start_line": "$.locations[0].physicalLocation.region.startLine",
        "detection_type": "$.properties.detectionType",
    }
    return rows.select("repo", *[F.get_json_object("json", p).alias(n) for n, p in path.items()])


@query
def gitlab_report(spark, sf_dir):
    rows = reports.gitlab_issues(doc_findings(spark, sf_dir))
    path = {
        "check_name": "$.check_name", "description": "$.description", "severity": "$.severity",
        "fingerprint": "$.fingerprint", "category": "$.categories[0]", "path": "$.location.path",
        "begin": "$.location.lines.begin",
    }
    return rows.select("repo", *[F.get_json_object("json", p).alias(n) for n, p in path.items()])


@query
def report_document_sizes(spark, sf_dir):
    """Lines of the code-quality document of every repository, and how many start with a comma."""
    found = cut_lineage(doc_findings(spark, sf_dir))
    lines = reports.gitlab_document(found, found.select("repo"))
    return lines.groupBy("repo").agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.startswith("value", F.lit(","))).alias("n_commas"),
        F.count_if(F.col("value").isin("[", "]")).alias("n_ends"),
    )


def _documents(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Documents written and read back."""
    path = f"{work_folder(spark)}/documents-{uuid.uuid4().hex}"
    reports.write_documents(lines, path)
    return cut_lineage(reports.read_documents(spark, path))


@query
def json_documents(spark, sf_dir):
    """JSON reports of a history written as documents, parsed again: each finding with its header."""
    scan = history(spark, sf_dir)
    # the summary counts the written findings, they are not computed again for it
    scan = replace(scan, findings=cut_lineage(scan.findings))
    rows = _documents(spark, reports.json_document(scan.findings, summary(scan), True))
    head = F.from_json(
        F.concat(F.substring_index("json", ',"findings":[', 1), F.lit("}")),
        "scan struct<duration_seconds:double,total_commits:bigint,total_files:bigint,total_findings:bigint,"
        "counts_by_severity:struct<LOW:bigint,MEDIUM:bigint,HIGH:bigint,CRITICAL:bigint>>",
    )
    heads = rows.where("kind = 'head'").select("repo", head["scan"].alias("scan")).select(
        "repo", "scan.total_commits", "scan.total_files", "scan.total_findings", F.col("scan.counts_by_severity.CRITICAL").alias("n_critical")
    )
    names = ["rule_id", "file_path", "matched_text", "commit_sha", "line_number", "fingerprint"]
    elements = rows.where("kind = 'element'").select("repo", *[F.get_json_object("json", f"$.{n}").alias(n) for n in names])
    return elements.join(heads, "repo")


@query
def sarif_documents(spark, sf_dir):
    """SARIF documents parsed again: the rules of each head and how many results name them."""
    found = cut_lineage(doc_findings(spark, sf_dir))
    rows = _documents(spark, reports.sarif_document(found, found.select("repo")))
    rules = F.from_json(F.concat(F.col("json"), F.lit("]}]}")), "version string, runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,name:string>>>>>>")
    heads = rows.where("kind = 'head'").select("repo", rules.alias("d")).select(
        "repo", F.col("d.version").alias("version"), F.posexplode(F.col("d.runs")[0]["tool"]["driver"]["rules"]).alias("rule_index", "rule")
    )
    results = rows.where("kind = 'element'").groupBy(
        "repo", F.get_json_object("json", "$.ruleIndex").cast("int").alias("rule_index"), F.get_json_object("json", "$.ruleId").alias("rule_id")
    ).agg(F.count("*").alias("n_results"))
    both = heads.join(results, ["repo", "rule_index"], "full")
    return whole(both.select("repo", "version", "rule_index", F.col("rule.id").alias("head_rule"), F.col("rule.name").alias("rule_name"), "rule_id", "n_results"))


@query
def baseline_written(spark, sf_dir):
    """Baseline documents with their header, read again as a baseline."""
    found = cut_lineage(doc_findings(spark, sf_dir))
    rows = _documents(spark, reports.baseline_document(found, found.select("repo"), generated_at="2024-05-06T07:08:09+00:00"))
    head = F.from_json(F.concat(F.col("json"), F.lit("]}")), "generator string, generated_at string, total_findings bigint")
    heads = rows.where("kind = 'head'").select("repo", head.alias("h")).select("repo", "h.generator", "h.generated_at", "h.total_findings")
    names = ["fingerprint", "rule_id", "file_path", "severity", "redacted_value"]
    elements = rows.where("kind = 'element'").select("repo", *[F.get_json_object("json", f"$.{n}").alias(n) for n in names])
    return elements.join(heads, "repo")


@query
def findings_table(spark, sf_dir):
    """The findings table written by repository and read again."""
    path = f"{work_folder(spark)}/findings-{uuid.uuid4().hex}"
    reports.write_findings(doc_findings(spark, sf_dir), path)
    return shown(spark.read.parquet(path).withColumn("repo", F.col("repo").cast("string")))


# ---- streams ----------------------------------------------------------------------


@query
def stream_scan(spark, sf_dir):
    """Turns arriving as a stream of several files, each secret reported at its first sighting."""
    from workloads.streams import stream_conversations

    found = stream_conversations(spark, sf_dir)
    return whole(found, "repo", "file_path", "line_number", "rule_id", "severity", "matched_text")


@query
def stream_severity(spark, sf_dir):
    """The same stream from a severity on."""
    from workloads.streams import stream_conversations

    found = stream_conversations(spark, sf_dir, ScanOptions(min_severity="medium"))
    return whole(found, "repo", "file_path", "line_number", "rule_id", "severity", "matched_text")


@query
def stream_baseline(spark, sf_dir):
    """The same stream with a baseline of known findings."""
    from workloads.streams import known_turns, stream_conversations

    found = stream_conversations(spark, sf_dir, baseline=known_turns(spark, sf_dir))
    return whole(found, "repo", "file_path", "line_number", "rule_id", "severity", "matched_text")


@query
def stream_late_contents(spark, sf_dir):
    """Versions and contents as two streams; a version waits for its content."""
    from workloads.streams import stream_two_sides

    found = stream_two_sides(spark, sf_dir)
    # which of two turns came first depends on the arrival of their contents
    return whole(found, "repo", "file_path", "line_number", "matched_text")


@query
def stream_incremental(spark, sf_dir):
    """The same stream with findings appended and the baseline rolled forward per batch."""
    from workloads.streams import incremental_conversations

    found = incremental_conversations(spark, sf_dir)
    return whole(found, "repo", "file_path", "line_number", "rule_id", "severity", "matched_text", "commit_seq")
