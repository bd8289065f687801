import csv
import glob
import json
import os

import pytest
from conftest import token
from pyspark.sql import functions as F

from credsieve.operators.detect import scan_lines
from credsieve.options import ScanOptions
from credsieve.plans import reports
from credsieve.plans.scan import scan_texts
from credsieve.rules import Rule
from credsieve.sources.rules import as_rules, split_rules
from credsieve.sources.lists import read_baseline, read_baseline_rows
from credsieve.streaming import scan as stream
from credsieve.streaming.scan import run_incremental, stream_findings


@pytest.fixture(scope="module")
def findings(spark):
    key = token("AKIA", "IOSFODNN7EXAMPLE")
    texts = spark.createDataFrame(
        [("r1", f"src\\d{i}.py", f'a\nKEY = "{key}"\npassword = "=hunter{i}"\n{"0a1b2c3d4e5f6789" * 2}') for i in range(40)]
        + [("r2", "x.py", "pwd = 'tab\tvalue9'")],
        "repo string, path string, text string",
    )
    return scan_texts(texts).cache()


def summaries(spark, findings):
    return findings.groupBy("repo").agg(
        F.lit(1).alias("total_commits"), F.lit(2).alias("total_files"), F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL")],
    ).unionByName(spark.sql("select 'empty' repo, 1 total_commits, 0 total_files, 0L total_findings, 0L n_low, 0L n_medium, 0L n_high, 0L n_critical"))


def documents(lines, path):
    reports.write_documents(lines, path)
    out = {}
    for folder in glob.glob(f"{path}/repo=*"):
        parts = sorted(glob.glob(f"{folder}/part-*"))
        out[folder.rsplit("=", 1)[1]] = (json.loads("".join(open(p).read() for p in parts)), len(parts))
    return out


def test_json_document(spark, findings, tmp_path):
    docs = documents(reports.json_document(findings, summaries(spark, findings), parts=5), str(tmp_path / "j"))
    doc, parts = docs["r1"]
    assert parts > 1  # a large repository is written by several tasks
    assert len(doc["findings"]) == doc["scan"]["total_findings"] == findings.where("repo = 'r1'").count()
    ranks = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    seen = [ranks.index(f["severity"]) for f in doc["findings"]]
    assert seen == sorted(seen)
    assert list(doc["findings"][0]) == reports.JSON_COLUMNS and doc["findings"][0]["entropy"] is None
    assert list(doc["scan"]["counts_by_severity"]) == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert docs["empty"][0]["findings"] == []
    hidden = documents(reports.json_document(findings, summaries(spark, findings), True), str(tmp_path / "h"))
    assert hidden["r1"][0]["findings"][0]["matched_text"] == "AKIA***"


def test_sarif_document(spark, findings, tmp_path):
    no_line = findings.where("repo = 'r2'").withColumn("line_number", F.lit(None).cast("int"))
    both = findings.where("repo = 'r1'").unionByName(no_line)
    repos = summaries(spark, findings)
    docs = documents(reports.sarif_document(both, repos, parts=3), str(tmp_path / "s"))
    run = docs["r1"][0]["runs"][0]
    rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert rules == ["aws-access-key-id", "keyword-password", "entropy-hex"]
    for result in run["results"]:
        assert rules[result["ruleIndex"]] == result["ruleId"]
    first = run["results"][0]
    assert first["level"] == "error" and first["message"]["text"].endswith("(AKIA***)")
    where = first["locations"][0]["physicalLocation"]
    assert where == {"artifactLocation": {"uri": "src/d0.py"}, "region": {"startLine": 2}}
    assert first["properties"] == {"commitSha": "", "commitAuthor": "", "detectionType": "PATTERN"}
    where = docs["r2"][0]["runs"][0]["results"][0]["locations"][0]["physicalLocation"]
    assert "region" not in where
    assert docs["empty"][0]["runs"][0]["results"] == []


def test_gitlab_document(spark, findings, tmp_path):
    docs = documents(reports.gitlab_document(findings, summaries(spark, findings)), str(tmp_path / "g"))
    issue = docs["r1"][0][0]
    assert issue["severity"] == "blocker" and issue["location"] == {"path": "src/d0.py", "lines": {"begin": 2}}
    prints = {r.fingerprint for r in findings.collect()}
    assert {i["fingerprint"] for d, _ in docs.values() for i in d} == prints


def test_csv(spark, findings, tmp_path):
    path = str(tmp_path / "c")
    reports.write_csv(findings, path)
    rows = []
    for part in sorted(glob.glob(path + "/part-*")):
        rows += list(csv.DictReader(open(part, newline="")))
    assert len(rows) == findings.count() and list(rows[0]) == reports.CSV_COLUMNS
    assert any(r["matched_text"].startswith("'=hunter") for r in rows)
    hidden = reports.csv_rows(findings, True).where("rule_id = 'keyword-password'").first()
    assert hidden.matched_text == "'=hun***"


def test_baseline_round_trip(spark, findings, tmp_path):
    path = str(tmp_path / "b")
    reports.write_baseline(findings, path)
    known = {r.fingerprint for r in read_baseline_rows(spark, path).collect()}
    assert read_baseline_rows(spark, path + "none").count() == 0
    docs = documents(reports.baseline_document(findings, summaries(spark, findings), 3), str(tmp_path / "d"))
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps(docs["r1"][0], indent=1))
    assert docs["r1"][0]["total_findings"] == read_baseline(spark, str(whole)).count()
    assert docs["empty"][0]["findings"] == []
    assert known == {r.fingerprint for r in findings.collect()}
    rows = reports.baseline_rows(findings)
    assert rows.count() == len(known) and "matched_text" not in rows.columns


def test_findings_table_and_lines(spark, findings, tmp_path):
    path = str(tmp_path / "t")
    reports.write_findings(findings, path)
    assert spark.read.parquet(path).count() == findings.count()
    assert os.path.isdir(path + "/repo=r1")
    lines = [r.line for r in reports.lines_of_text(findings.where("repo = 'r2'")).collect()]
    assert lines == ["[MEDIUM] Keyword: pwd in x.py:1 (tab\t***) @ N/A"]
    shown = reports.redact(findings.where("repo = 'r2'"), lines=True).first()
    assert shown.line_content == "pwd = 'tab\t***'"


def stream_rows(spark):
    key = token("AKIA", "IOSFODNN7EXAMPLE")
    return spark.createDataFrame(
        [("r", "a.py", f'K = "{key}"', "2024-01-01 00:00:00", 0), ("r", "a.py", f'K = "{key}"', "2024-01-01 01:00:00", 1),
         ("r", "b.py", f'K = "{key}"', "2024-01-01 02:00:00", 2), ("r", "z.png", f'K = "{key}"', "2024-01-01 02:00:00", 3)],
        "repo string, path string, text string, t string, commit_seq int",
    ).select("repo", "path", "text", F.col("t").cast("timestamp").alias("committed_at"), F.col("commit_seq").cast("bigint").alias("commit_seq"))


def test_stream(spark, tmp_path):
    rows = stream_rows(spark)
    source = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    query = (
        stream_findings(stream).writeStream.format("memory").queryName("seen")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.file_path, r.rule_id) for r in spark.table("seen").collect()}
    batch = {(r.file_path, r.rule_id) for r in scan_texts(rows).collect()}
    assert got == batch and spark.table("seen").count() == len(batch)


def test_incremental(spark, tmp_path):
    rows = stream_rows(spark)
    source, out, base = (str(tmp_path / n) for n in ("in", "out", "base"))

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        run_incremental(stream, out, base, str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(out).where("rule_id like 'aws%'")

    rows.where("commit_seq = 1").write.parquet(source)
    assert [(r.file_path, r.commit_seq) for r in run().collect()] == [("a.py", 1)]
    rows.where("commit_seq != 1").write.mode("append").parquet(source)
    assert {(r.file_path, r.commit_seq) for r in run().collect()} == {("a.py", 1), ("b.py", 2)}


def test_stream_keeps_what_the_batch_keeps(spark, tmp_path):
    """A token that a CRITICAL rule of Python's and the keyword detector both find."""
    rule = Rule("odd", "Odd token", "CRITICAL", r"(zz)?(?(1)[a-z]+|qq[0-9a-f]{20})", ["qq"])
    rows = spark.createDataFrame(
        [("r", f"f{i}.py", f"token = qq{i:020x}", f"2024-01-01 00:{i:02d}:00", i) for i in range(40)],
        "repo string, path string, text string, t string, commit_seq long",
    ).select("repo", "path", "text", F.col("t").cast("timestamp").alias("committed_at"), "commit_seq")
    source = str(tmp_path / "in")
    rows.repartition(4).write.parquet(source)
    options = ScanOptions(min_severity="HIGH", use_entropy=False)
    base = scan_texts(rows.where("commit_seq = 3"), options, custom_rules=[rule]).select("repo", "fingerprint")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream_findings(stream, horizon="30 days", options=options, baseline=base, custom_rules=[rule])
        .writeStream.format("memory").queryName("agree")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted((r.file_path, r.rule_id, r.severity) for r in spark.table("agree").collect())
    batch = scan_texts(rows, options, baseline=base, custom_rules=[rule]).collect()
    assert got == sorted((r.file_path, r.rule_id, r.severity) for r in batch) and len(got) == 39


def test_rules_as_rows(spark):
    raw = spark.createDataFrame([("acme", "(?i)acme-[0-9]{6}", "acme-")], "id string, pattern string, literal string")
    valid, rejected = split_rules(raw)
    texts = spark.createDataFrame([("r", "a", "ACME-123456"), ("r", "b", "acme-12")], "repo string, path string, text string")
    found = scan_texts(texts, ScanOptions(use_entropy=False), custom_rules=as_rules(valid)).collect()
    assert [(f.file_path, f.rule_id) for f in found] == [("a", "acme")] and rejected.count() == 0


def test_positions(spark, findings):
    rows = reports.with_position(findings.repartition(7)).collect()
    assert sorted(r.position for r in rows) == list(range(1, findings.count() + 1))
    key = [(r.position, -r.sev_rank, r.commit_seq, r.file_path, r.det_rank, r.rule_idx, r.line_number, r.pos) for r in rows]
    in_order = sorted(key)
    assert [k[1:] for k in in_order] == sorted(k[1:] for k in key)
    assert reports.with_position(findings.limit(0)).collect() == []


def test_documents_read_back(spark, findings, tmp_path):
    lines = reports.baseline_document(findings, findings.select("repo"), parts=3, generated_at='a "time"')
    reports.write_documents(lines, str(tmp_path / "b"))
    rows = reports.read_documents(spark, str(tmp_path / "b")).collect()
    assert {r.repo for r in rows} == {"r1", "r2"}
    assert sorted(r.kind for r in rows if r.repo == "r2") == ["element", "head", "tail"]
    assert all(json.loads(r.json)["fingerprint"] for r in rows if r.kind == "element")
    whole = documents(lines, str(tmp_path / "c"))["r1"][0]
    assert list(whole) == ["version", "generator", "generated_at", "total_findings", "findings"]
    assert whole["generated_at"] == 'a "time"' and whole["total_findings"] == len(whole["findings"])
    now = documents(reports.baseline_document(findings, findings.select("repo")), str(tmp_path / "d"))["r2"][0]
    assert now["generated_at"].endswith("+00:00")
    head = documents(reports.json_document(findings, summaries(spark, findings), duration_seconds=1.23456), str(tmp_path / "e"))["r1"][0]["scan"]
    assert head["duration_seconds"] == 1.235


def test_stream_settles_micro_batches(spark, tmp_path, monkeypatch):
    """Copies of one place in one micro-batch, in many Arrow batches: the earliest counts."""
    key = token("AKIA", "IOSFODNN7EXAMPLE")
    rows = spark.range(3000).selectExpr(
        "'r' AS repo", "concat('f', id % 7, '.py') AS path", f"'K = \"{key}\"' AS text",
        "timestamp_seconds(1700000000 + (id * 7919) % 3001) AS committed_at", "id AS commit_seq",
    )
    source = str(tmp_path / "in")
    rows.repartition(5).write.parquet(source)
    monkeypatch.setattr("credsieve.streaming.scan.SETTLED", 10)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "50")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(source)
        query = (
            stream_findings(stream).writeStream.format("memory").queryName("settled")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(size, before)
    got = {(r.file_path, r.rule_id, r.commit_seq) for r in spark.table("settled").where("rule_id like 'aws%'").collect()}
    first = {}
    for i in range(3000):
        at = (7919 * i % 3001, i)
        first[i % 7] = min(first.get(i % 7, at), at)
    assert got == {(f"f{k}.py", "aws-access-key-id", i) for k, (_, i) in first.items()}


def test_lines_with_given_numbers(spark):
    key = token("AKIA", "IOSFODNN7EXAMPLE")
    rules = [Rule("x", "X", "LOW", "x+"), Rule("c", "C", "HIGH", "(q)?(?(1)w|ee)")]
    lines = spark.createDataFrame(
        [("a", 40, f"é{key} xx {key} x"), ("a", 7, "qw ee"), ("b", 1, ""), ("b", 2, None)], "path string, n int, line string"
    )
    got = scan_lines(lines, ["path", "n"], custom_rules=rules).collect()
    assert sorted((r.path, r.n, r.rule_id, r.matched_text, r.start, r.end) for r in got) == sorted([
        ("a", 40, "aws-access-key-id", key, 1, 21), ("a", 40, "aws-access-key-id", key, 25, 45),
        ("a", 40, "x", "xx", 22, 24), ("a", 40, "x", "x", 46, 47), ("a", 7, "c", "qw", 0, 2), ("a", 7, "c", "ee", 3, 5),
    ])


def test_rolling_baseline_is_merged(spark, tmp_path, monkeypatch):
    """100 batches leave a bounded number of files; a merge that breaks off changes nothing."""
    monkeypatch.setattr(stream, "PARTS", 4)
    path = str(tmp_path / "base")
    base = stream.RollingBaseline(spark, path)
    columns = ["repo", "rule_id", "rule_name", "file_path", "severity", "redacted_value", "sev_rank", "fingerprint"]

    def findings(batch):
        rows = [(f"r{batch % 3}", "i", "n", "p", "HIGH", "***", 2, f"{batch}-{k}") for k in range(2)]
        return spark.createDataFrame(rows, columns).coalesce(1)

    def known(batch):
        return {(r.repo, r.fingerprint) for r in base.before(batch).collect()}

    for batch in range(100):
        if batch and batch % stream.GENERATION == 0:
            base.compact(batch)
        base.add(findings(batch), batch)
    expected = {(f"r{b % 3}", f"{b}-{k}") for b in range(100) for k in range(2)}
    assert known(100) == expected and base.generation() == 96
    # a batch that runs again sees what it saw before
    assert known(97) == {(r, f) for r, f in expected if int(f.split("-")[0]) < 97}
    files = [f for f in glob.glob(f"{path}/**/*.parquet", recursive=True)]
    assert len(files) <= 4 + 2 * stream.GENERATION
    broken = stream.RollingBaseline(spark, path)
    monkeypatch.setattr(broken, "_rows", lambda folder, schema: (_ for _ in ()).throw(OSError("lost")) if "batches" in folder else stream.RollingBaseline._rows(broken, folder, schema))
    with pytest.raises(OSError):
        broken.compact(100)
    os.makedirs(f"{path}/generations/generation=100/part=0")
    assert known(100) == expected and base.generation() == 96
    base.compact(100)
    base.compact(100)
    assert known(100) == expected and base.generation() == 100
    few = findings(5).union(spark.createDataFrame([("r0", "i", "n", "p", "HIGH", "***", 2, "new")], columns))
    assert {r.fingerprint for r in base.known_of(few, 100).collect()} >= {"5-0", "5-1"}
    monkeypatch.setattr(stream, "FEW", 1)
    assert {"5-0", "5-1"} <= {r.fingerprint for r in base.known_of(few, 100).collect()}


def test_versions_wait_for_their_contents(spark, tmp_path):
    key, other = token("AKIA", "IOSFODNN7EXAMPLE"), token("AKIA", "AAAABBBBCCCCDDDD")
    at = "timestamp_seconds(1700000000 + {})".format
    versions = spark.createDataFrame(
        [("r", "a.py", "k", 0), ("r", "b.py", "k", 60), ("r", "c.py", "o", 120), ("r", "a.py", "k", 180), ("r", "late.py", "z", 240),
         ("r", "logo.png", "k", 5), ("q", "a.py", "o", 10)], "repo string, path string, blob_sha string, n long",
    ).selectExpr("repo", "path", "blob_sha", f"{at('n')} AS committed_at", "n AS commit_seq")
    contents = spark.createDataFrame(
        [("k", f'K = "{key}"', 900), ("o", f'K = "{other}"', 0), ("z", f'K = "{other}"', 10**6), ("n", "a\0b", 0)], "blob_sha string, text string, n long"
    ).selectExpr("blob_sha", "text", f"{at('n')} AS arrived_at")
    sides = []
    for name, rows in (("v", versions), ("c", contents)):
        rows.repartition(3).write.parquet(str(tmp_path / name))
        sides.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    query = (
        stream.stream_history(*sides, horizon="1 hour", salts=3).writeStream.format("memory").queryName("waited")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted((r.repo, r.file_path, r.matched_text) for r in spark.table("waited").where("rule_id LIKE 'aws%'").collect())
    # z came days after its version
    assert got == sorted([("r", "a.py", key), ("r", "b.py", key), ("r", "c.py", other), ("q", "a.py", other)])


def test_batches_of_a_stream_are_read_by_many_tasks(spark, tmp_path):
    from workloads import streams

    rows = spark.range(3000).withColumn("key", F.col("id") % 1500)
    tasks, seen = [], []

    def look(batch, _):
        tasks.append(batch.rdd.getNumPartitions())
        seen.extend(batch.groupBy("key").agg(F.count("*").alias("n")).collect())

    stream = streams._arriving(rows, "key", f"{tmp_path}/rows")
    options = {"checkpointLocation": f"{tmp_path}/checkpoint"}
    stream.writeStream.foreachBatch(look).options(**options).trigger(availableNow=True).start().awaitTermination()
    # a few batches, each dealt to the cores; the rows of a key come together
    assert len(tasks) == streams.BATCHES and min(tasks) >= 4
    assert sorted(r.key for r in seen) == list(range(1500)) and {r.n for r in seen} == {2}


def test_many_documents_are_listed_by_few_tasks(spark, tmp_path):
    """A folder per repository, but not a task per folder; the setting is given back."""
    path, name = str(tmp_path / "d"), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    rows = spark.range(300).selectExpr("concat('r', id) AS repo", """concat('{"n":', id, '}') AS value""")
    reports.write_documents(rows.coalesce(2), path)
    before, context = spark.conf.get(name), spark.sparkContext
    context.setJobGroup("listing", "read_documents")
    try:
        read = reports.read_documents(spark, path)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and all(tracker.getStageInfo(s).numTasks <= 4 * context.defaultParallelism for s in stages)
    assert spark.conf.get(name) == before
    assert {(r.repo, r.kind, json.loads(r.json)["n"]) for r in read.collect()} == {(f"r{n}", "element", n) for n in range(300)}


def test_json_documents_count_written_findings(spark, monkeypatch):
    """The summary of the documents reads the findings that are written, as the documents do."""
    from dataclasses import dataclass

    from workloads import queries

    @dataclass(frozen=True)
    class Result:
        findings: object

    class Stop(Exception):
        pass

    def counted(scan):
        raise Stop(scan.findings)

    first = spark.range(1)
    monkeypatch.setattr(queries, "history", lambda *a: Result(first))
    monkeypatch.setattr(queries, "summary", counted)
    with pytest.raises(Stop) as seen:
        queries.json_documents(spark, "")
    assert "Scan parquet" in seen.value.args[0]._jdf.queryExecution().executedPlan().toString().replace("FileScan", "Scan")
