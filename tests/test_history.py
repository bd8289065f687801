import glob
import random
import shutil
from datetime import datetime, timedelta

import pytest
from conftest import token
from pyspark.sql import functions as F

from credsieve.operators.history import (
    UnknownRevision,
    ancestors,
    commit_range,
    head_of,
    numbered,
    select_commits,
    snapshot_at,
)
from credsieve.operators.reachability import CommitIndex
from credsieve.operators.snapshots import (
    changed_directories,
    changed_hashes,
    directory_hashes,
    file_versions_of,
    files_in,
    snapshot_diff,
    snapshot_diff_by_hashes,
)
from credsieve.operators.detect import raw_hits
from credsieve.options import ScanOptions
from credsieve.sources.files import read_folder, save_blobs
from credsieve.storage import cut_lineage
from credsieve.plans import hits
from credsieve.plans.hits import HitStore, rules_digest
from credsieve.plans.scan import scan, scan_history, scan_pending, summary, totals
from credsieve.rules import Rule

COMMITS = "repo string, commit_sha string, parents array<string>, commit_seq long, author string, committed_at timestamp, message string"
FILES = "repo string, commit_sha string, path string, blob_sha string, change_type string"
T0 = datetime(2024, 1, 1)


def commit(repo, sha, parents, seq, author="dev"):
    return (repo, sha, parents, seq, author, T0 + timedelta(minutes=seq), "m")


def shas(df):
    return {(r.repo, r.commit_sha) for r in df.collect()}


def random_graph(rng, repo, n):
    rows, parents = [], {}
    for i in range(n):
        k = 0 if i == 0 else rng.choice([1, 1, 1, 2, 2, 3])
        back = rng.choice([2, 5, i + 1])
        ps = list(dict.fromkeys(f"c{max(0, i - 1 - rng.randrange(back)):03d}" for _ in range(k)))
        parents[f"c{i:03d}"] = ps
        rows.append(commit(repo, f"c{i:03d}", ps, i))
    return rows, parents


def reachable(parents, start):
    seen, todo = set(), [start]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += parents[c]
    return seen


def test_ranges_on_random_graphs(spark):
    rng = random.Random(2)
    rows, graphs = [], {}
    for repo in ("a", "b", "c"):
        got, graphs[repo] = random_graph(rng, repo, 60)
        rows += got
    commits = spark.createDataFrame(rows, COMMITS).repartition(4).cache()
    starts = spark.createDataFrame([(r, "c055") for r in graphs], "repo string, commit_sha string")
    expected = {(r, c) for r, g in graphs.items() for c in reachable(g, "c055")}
    assert shas(ancestors(commits, starts)) == expected
    assert shas(ancestors(commits, starts, rows_per_task=5)) == expected
    bases = spark.createDataFrame([(r, "c030") for r in graphs], "repo string, commit_sha string")
    expected = {(r, c) for r, g in graphs.items() for c in reachable(g, "c059") - reachable(g, "c030")}
    assert shas(commit_range(commits, bases)) == expected


def test_long_line_needs_few_rounds(spark):
    rows = [commit("a", f"c{i:04d}", [f"c{i - 1:04d}"] if i else [], i) for i in range(600)]
    commits = spark.createDataFrame(rows, COMMITS)
    got = shas(commit_range(commits, "c0100"))
    assert got == {("a", f"c{i:04d}") for i in range(101, 600)}


def test_selection(spark):
    rows = [commit("a", "x", [], 0), commit("a", "y", ["x"], 1), commit("a", "z", ["y"], 2)]
    commits = spark.createDataFrame(rows, COMMITS)
    assert shas(select_commits(commits, ScanOptions())) == {("a", "x"), ("a", "y"), ("a", "z")}
    assert shas(select_commits(commits, ScanOptions(head_only=True, diff_base="x"))) == {("a", "z")}
    assert shas(select_commits(commits, ScanOptions(since_commit="y"))) == {("a", "z")}
    assert shas(select_commits(commits, ScanOptions(diff_base="x", since_commit="y"))) == {("a", "y"), ("a", "z")}
    with pytest.raises(UnknownRevision):
        select_commits(commits, ScanOptions(diff_base="nope"))
    shuffled = numbered(commits.drop("commit_seq"))
    assert [r.commit_sha for r in shuffled.orderBy("commit_seq").collect()] == ["x", "y", "z"]
    assert [r.commit_seq for r in shuffled.orderBy("commit_seq").collect()] == [1, 2, 3]


def test_snapshot_diff(spark):
    tree = "repo string, path string, blob_sha string"
    old = spark.createDataFrame(
        [("r", "same", "b1"), ("r", "mod", "b2"), ("r", "moved", "b3"), ("r", "kept", "b4"), ("r", "gone", "b9")], tree
    )
    new = spark.createDataFrame(
        [("r", "same", "b1"), ("r", "mod", "b5"), ("r", "moved2", "b3"), ("r", "kept", "b4"), ("r", "copy", "b4"),
         ("r", "new", "b6"), ("q", "same", "b1")], tree,
    )
    expected = {("r", "mod", "M"), ("r", "moved2", "R"), ("r", "copy", "C"), ("r", "new", "A"), ("q", "same", "A")}
    for rows in (1, 100):
        got = snapshot_diff(new, old, rows_per_task=rows)
        assert {(r.repo, r.path, r.change_type) for r in got.collect()} == expected
    got = snapshot_diff(new, old, with_deleted=True)
    assert {(r.path) for r in got.where("change_type = 'D'").collect()} == {"moved", "gone"}
    empty = old.limit(0)
    assert {r.change_type for r in snapshot_diff(new, empty).collect()} == {"A"}


def history(spark):
    """alice adds a key in tests/, bob touches a readme, carol copies the content and adds another."""
    key, other = token("AKIA", "AAAABBBBCCCCDDDD"), token("AKIA", "SCOPEDBLOB123456")
    blobs = spark.createDataFrame(
        [("k", bytearray(f'T = "{key}"\n'.encode())), ("r", bytearray(b"# docs\n")), ("n", bytearray(b"x\0y")),
         ("o", bytearray(f'K = "{other}"\n'.encode())), ("big", bytearray(b"a" * 3000))],
        "blob_sha string, content binary",
    )
    commits = spark.createDataFrame(
        [commit("a", "c1", [], 1, "Alice"), commit("a", "c2", ["c1"], 2, "Bob"), commit("a", "c3", ["c2"], 3, "Carol")],
        COMMITS,
    )
    files = spark.createDataFrame(
        [("a", "c1", "tests/f.py", "k", "A"), ("a", "c1", "x.dat", "n", "A"), ("a", "c2", "README", "r", "A"),
         ("a", "c2", "README2", "r", "A"), ("a", "c3", "src/p.py", "k", "A"), ("a", "c3", "src/o.py", "o", "A"),
         ("a", "c3", "tests/f.py", "k", "M"), ("a", "c3", "tests/f.py", "k", "D"), ("a", "c3", "big.txt", "big", "A"),
         ("a", "c3", "logo.png", "k", "A")], FILES,
    )
    return key, other, commits, files, blobs


def test_history_scan(spark):
    key, other, commits, files, blobs = history(spark)
    options = ScanOptions(max_file_size=2000)
    for rows in (1, 1000):
        scan = scan_history(commits, files, blobs, options, rows_per_task=rows)
        got = {(f.file_path, f.matched_text, f.commit_sha, f.commit_author, f.commit_date)
               for f in scan.findings.collect() if f.rule_id == "aws-access-key-id"}
        assert got == {
            ("tests/f.py", key, "c1", "Alice", "2024-01-01T00:01:00+00:00"),
            ("src/p.py", key, "c3", "Carol", "2024-01-01T00:03:00+00:00"),
            ("src/o.py", other, "c3", "Carol", "2024-01-01T00:03:00+00:00"),
        }
    row = summary(scan).first()
    # three dirty (path, blob), one clean blob under two paths; binary and oversized do not count
    assert (row.total_commits, row.total_files, row.suppressed) == (3, 4, 0)
    assert row.n_critical == 3 and row.total_findings == scan.findings.count()
    assert totals(summary(scan)).first().total_files == 4


def test_history_scan_with_lists(spark):
    key, other, commits, files, blobs = history(spark)
    allow = spark.createDataFrame([(key, "tests/*", False)], "pattern string, scope string, is_regex boolean")
    first = scan_history(commits, files, blobs, allowlist=allow)
    aws = first.findings.where("rule_id = 'aws-access-key-id'")
    assert {f.file_path for f in aws.collect()} == {"src/p.py", "src/o.py"}
    base = first.findings.where("file_path = 'src/p.py'").select("repo", "fingerprint")
    second = scan_history(commits, files, blobs, ScanOptions(min_severity="HIGH"), allow, base)
    assert {f.file_path for f in second.findings.collect()} == {"src/o.py"}
    assert second.suppressed.count() == 1
    assert summary(second).first().suppressed == 1


def test_range_and_head_scans(spark):
    key, other, commits, files, blobs = history(spark)
    since = scan_history(commits, files, blobs, ScanOptions(since_commit="c2"))
    assert since.commits.count() == 1
    assert {f.file_path for f in since.findings.where("rule_id like 'aws%'").collect()} == {
        "src/p.py", "src/o.py", "tests/f.py"}
    quiet = scan_history(commits.where("commit_seq < 3"), files, blobs, ScanOptions(diff_base="c1"))
    assert quiet.findings.count() == 0 and quiet.commits.count() == 1
    tree = snapshot_at(commits, files.where("change_type != 'M'"))
    assert {r.path for r in tree.collect()} >= {"src/p.py", "README"} and "tests/f.py" not in {
        r.path for r in tree.collect()}
    listing = tree.select("repo", F.lit("c3").alias("commit_sha"), "path", "blob_sha", F.lit("A").alias("change_type"))
    head = scan_history(commits, listing, blobs, ScanOptions(head_only=True))
    assert {f.file_path for f in head.findings.where("rule_id like 'aws%'").collect()} == {"src/p.py", "src/o.py"}
    assert {f.commit_sha for f in head.findings.collect()} == {"c3"}


def test_pending_scan(spark):
    key, other, commits, files, blobs = history(spark)
    tree = "repo string, path string, blob_sha string"
    head = spark.createDataFrame([("a", "existing.py", "r"), ("a", "old.py", "k")], tree)
    pending = spark.createDataFrame([("a", "existing.py", "o"), ("a", "new.py", "k"), ("a", "old.py", "k")], tree)
    scan = scan_pending(pending, head, blobs)
    aws = scan.findings.where("rule_id like 'aws%'").collect()
    assert {(f.file_path, f.commit_author, f.commit_date) for f in aws} == {
        ("existing.py", "Current User (Staged)", "Working Tree"), ("new.py", "Current User (Staged)", "Working Tree")}
    assert scan_pending(pending, head.limit(0), blobs).findings.select("file_path").distinct().count() == 3
    assert summary(scan).first().total_commits == 0


def test_versions_from_trees(spark):
    commits = spark.createDataFrame([commit("a", "c1", [], 1), commit("a", "c2", ["c1", "zz"], 2)], COMMITS)
    trees = spark.createDataFrame(
        [("a", "c1", "p", "1"), ("a", "c1", "q", "2"), ("a", "c2", "p", "1"), ("a", "c2", "q", "3"), ("a", "c2", "s", "2")],
        "repo string, commit_sha string, path string, blob_sha string",
    )
    got = {(r.commit_sha, r.path, r.change_type) for r in file_versions_of(commits, trees).collect()}
    assert got == {("c1", "p", "A"), ("c1", "q", "A"), ("c2", "q", "M"), ("c2", "s", "C")}


def test_many_forks_need_few_rounds(spark, monkeypatch):
    """A main line with a merged branch at every second commit."""
    from credsieve.operators import history as module

    rows, last = [], None
    for i in range(500):
        name = f"m{i:04d}"
        parents = [last] if last else []
        if i % 2 and i > 1:
            # the branch sorts after the main line
            rows.append(commit("a", f"z{i:04d}", [f"m{i - 2:04d}"], 10 * i))
            parents.append(f"z{i:04d}")
        rows.append(commit("a", name, parents, 10 * i + 5))
        last = name
    rows += [commit("b", "only", [], 0)]
    commits = spark.createDataFrame(rows, COMMITS).cache()
    written = []
    monkeypatch.setattr(module, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    base = spark.createDataFrame([("a", "m0003")], "repo string, commit_sha string")
    got = shas(commit_range(commits, base))
    below = {"m0000", "m0001", "m0002", "m0003", "z0003"}
    assert got == {("a", r[1]) for r in rows if r[0] == "a" and r[1] not in below} | {("b", "only")}
    assert len(written) < 45


def test_equal_numbers_on_two_branches(spark):
    keys = [token("AKIA", f"AAAABBBBCCCC000{i}") for i in range(3)]
    blobs = spark.createDataFrame([(f"k{i}", f"T = {k}\n") for i, k in enumerate(keys)], "blob_sha string, text string")
    commits = spark.createDataFrame(
        [commit("a", "c1", [], 1, "A"), commit("a", "c2", ["c1"], 2, "B"), commit("a", "c3", ["c1"], 2, "C")], COMMITS
    )
    files = spark.createDataFrame(
        [("a", f"c{i + 1}", f"f{i}.py", f"k{i}", "A") for i in range(3)] + [("a", "c3", "f1.py", "k1", "A")], FILES
    )
    found = scan_history(commits, files, blobs).findings.where("rule_id = 'aws-access-key-id'").collect()
    assert sorted((f.file_path, f.commit_sha, f.commit_author) for f in found) == [
        ("f0.py", "c1", "A"), ("f1.py", "c2", "B"), ("f2.py", "c3", "C")]
    assert head_of(commits).first().commit_sha == "c3"


def test_numbers_when_all_commits_have_one_time(spark):
    rows = [commit("a", f"{(i * 37) % 256:02x}{i:03d}", [], 0) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, COMMITS).drop("commit_seq")).collect()
    assert [r.commit_seq for r in sorted(got, key=lambda r: r.commit_sha)] == list(range(1, 301))


def test_options_have_an_order(spark):
    key, other, commits, files, blobs = history(spark)
    tree = spark.createDataFrame([("a", "new.py", "k")], "repo string, path string, blob_sha string")

    def paths(**options):
        done = scan(commits, files, blobs, ScanOptions(**options), pending_tree=tree)
        return {f.file_path for f in done.findings.where("rule_id like 'aws%'").collect()}

    everything = {"tests/f.py", "src/p.py", "src/o.py"}
    assert paths() == everything
    assert paths(pending=True, head_only=True, diff_base="c2") == {"new.py"}
    # what an earlier commit brought is part of the head's tree
    alone = scan(commits.where("commit_seq < 3"), files, blobs, ScanOptions(head_only=True, diff_base="c1"))
    assert {f.file_path for f in alone.findings.where("rule_id like 'aws%'").collect()} == {"tests/f.py"}
    assert {f.commit_sha for f in alone.findings.collect()} == {"c2"}
    assert paths(diff_base="c2", since_commit="c1") == everything
    with pytest.raises(ValueError):
        scan(commits, files, blobs, ScanOptions(pending=True))
    strict = scan(commits, files, blobs, ScanOptions(fail_on_severity="CRITICAL", redact=True))
    assert strict.gate.first().exit_code == 1
    assert all(key not in f.line_content and f.matched_text.endswith("***") for f in strict.findings.collect())


def test_read_folder(spark, tmp_path):
    root = tmp_path / "src"
    (root / "lib" / "src").mkdir(parents=True)
    (root / "lib" / "src" / "y.py").write_text("y")
    (root / "x.py").write_text("xx")
    (root / "big").write_text("z" * 100)
    for place in (str(root), str(root) + "/", f"file://{root}"):
        got = {(r.path, r.size) for r in read_folder(spark, place, "r", 50).collect()}
        assert got == {("lib/src/y.py", 1), ("x.py", 2)}


def counting(spark, column):
    """The column as it is, and how often it was computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    return F.udf(count, "binary").asNondeterministic()(column), seen


def as_rows(scan):
    columns = ["repo", "file_path", "line_number", "matched_text", "rule_id", "commit_sha"]
    return sorted(tuple(r[c] for c in columns) for r in scan.findings.collect())


def test_summary_reads_no_contents(spark):
    key, other, commits, files, blobs = history(spark)
    content, seen = counting(spark, F.col("content"))
    scan = scan_history(commits, files, blobs.withColumn("content", content), ScanOptions(max_file_size=2000))
    assert seen.value == blobs.count()
    row = summary(scan).first()
    assert (row.total_commits, row.total_files, row.n_critical) == (3, 4, 3)
    assert {(r.blob_sha, r.is_dirty) for r in scan.read.collect()} == {("k", True), ("r", False), ("o", True)}
    assert seen.value == blobs.count()


def test_rescan_reads_new_contents_only(spark, tmp_path, monkeypatch):
    searched = []
    detect = hits.detect
    monkeypatch.setattr(hits, "detect", lambda texts, *a, **k: searched.append(texts.count()) or detect(texts, *a, **k))
    key, other, commits, files, blobs = history(spark)
    store = HitStore(spark, f"{tmp_path}/hits")
    options = ScanOptions(max_file_size=2000)
    early, first = commits.where("commit_seq < 3"), blobs.where("blob_sha IN ('k', 'r', 'n')")
    before = scan_history(early, files, first, options, store=store)
    assert as_rows(before) == as_rows(scan_history(early, files, first, options))
    again = scan_history(commits, files, blobs, options, store=store)
    full = scan_history(commits, files, blobs, options)
    assert as_rows(again) == as_rows(full) and summary(again).collect() == summary(full).collect()
    # what the store knows is not even looked at
    other_content = blobs.withColumn("content", F.lit(bytearray(b"password = 'x9y8z7w6'")))
    third = scan_history(commits, files, other_content, options, store=store)
    assert as_rows(third) == as_rows(full) and searched == [2, 1, 0]
    # other rules know nothing of these hits
    rule = Rule("t", "T", "HIGH", "T = .{3}")
    with_rule = scan_history(commits, files, blobs, options, custom_rules=[rule], store=store)
    assert as_rows(with_rule) == as_rows(scan_history(commits, files, blobs, options, custom_rules=[rule]))
    assert rules_digest(options, [rule]) != rules_digest(options, []) == rules_digest(ScanOptions(max_file_size=2000, min_severity="HIGH"), [])
    rows = spark.createDataFrame([("t", "x"), ("u", "y")], "id string, pattern string")
    assert rules_digest(options, rows) == rules_digest(options, rows.orderBy("pattern", ascending=False)) != rules_digest(options, rows.limit(1))


def test_a_batch_that_broke_off_does_not_count(spark, tmp_path, monkeypatch):
    key, other, commits, files, blobs = history(spark)
    store, options = HitStore(spark, f"{tmp_path}/hits"), ScanOptions()
    expected = as_rows(scan_history(commits, files, blobs, options))
    rules = rules_digest(options, [])
    # hits without the write that commits them, and one content committed by two scans
    store.hits_of(blobs, options)
    batch = glob.glob(f"{tmp_path}/hits/hits/rules={rules}/batch=*")[0]
    shutil.copytree(batch, f"{tmp_path}/hits/hits/rules={rules}/batch=broken")
    shutil.copytree(batch, f"{tmp_path}/hits/hits/rules={rules}/batch=twice")
    shutil.copytree(batch.replace("/hits/hits/", "/hits/seen/"), f"{tmp_path}/hits/seen/rules={rules}/batch=twice")
    assert as_rows(scan_history(commits, files, blobs, options, store=store)) == expected


def random_trees(rng):
    files = {}
    for i in range(300):
        depth = rng.randrange(4)
        files["/".join([f"d{rng.randrange(4)}" for _ in range(depth)] + [f"f{i}"])] = f"b{rng.randrange(200)}"
    old = dict(files)
    for path in rng.sample(sorted(files), 12):
        if path.startswith("d1"):
            continue
        act = rng.randrange(4)
        if act == 0:
            files[path] = f"n{rng.randrange(99)}"
        elif act == 1:
            files[path + "x"] = files.pop(path)
        elif act == 2:
            files["d2/new/" + path] = files[path]
        else:
            del files[path]
    return files, old


@pytest.mark.parametrize("seed", [1, 2])
def test_diff_by_directory_hashes(spark, seed):
    rng = random.Random(seed)
    pairs = {"a": random_trees(rng), "b": ({"x": "1"}, {"x": "1"}), "c": ({}, {"d/e/f": "1"}), "d": ({"d/e/f": "1"}, {})}
    new, old = (
        cut_lineage(spark.createDataFrame([(r, p, b) for r, t in pairs.items() for p, b in t[k].items()], "repo string, path string, blob_sha string"))
        for k in (0, 1)
    )
    new_hashes, old_hashes = cut_lineage(directory_hashes(new)), cut_lineage(directory_hashes(old))
    got = snapshot_diff_by_hashes(new, old, new_hashes, old_hashes, with_deleted=True)
    expected = snapshot_diff(new, old, with_deleted=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    # a tenth of the files changed, so most are left out before paths are compared
    changed = changed_directories(new_hashes, old_hashes)
    assert 0 < files_in(new, changed).count() < 0.8 * new.count()
    assert not changed.where("repo = 'b' OR dir LIKE 'd1%'").count()
    # hashes carried on are those made anew
    came, went = (x.join(y, ["repo", "path", "blob_sha"], "left_anti") for x, y in ((new, old), (old, new)))
    order = ["repo", "dir", "parent", "depth", "n", "h1", "h2"]
    carried = changed_hashes(old_hashes, came, went).select(*order).collect()
    assert sorted(map(str, carried)) == sorted(map(str, new_hashes.select(*order).collect()))
    same = snapshot_diff_by_hashes(old, old, old_hashes, old_hashes)
    assert same.count() == 0


def test_commit_index(spark, tmp_path):
    rng = random.Random(4)
    rows, parents = random_graph(rng, "a", 60)
    more, others = random_graph(rng, "b", 12)
    commits = cut_lineage(spark.createDataFrame(rows + more, COMMITS))
    index = CommitIndex(spark, f"{tmp_path}/i")
    added = [index.extend(commits.where(f"commit_seq < {n}")) for n in (7, 31, 31, 60)]
    assert added[0] == 14 and added[2] == 0 and sum(added) == 72
    whole = CommitIndex(spark, f"{tmp_path}/j")
    whole.extend(commits)
    asked = [("a", f"r{i}", rng.choice([None, f"c{rng.randrange(60):03d}"]), f"c{rng.randrange(60):03d}") for i in range(25)]
    asked += [("b", "r0", "c002", "c011"), ("b", "r1", None, "c004")]
    table = spark.createDataFrame(asked, "repo string, range_id string, base string, head string")
    expected = set()
    for repo, name, base, head in asked:
        graph = parents if repo == "a" else others
        gone = reachable(graph, base) if base else set()
        expected |= {(repo, name, c) for c in reachable(graph, head) - gone}
    for built in (index, whole):
        rows = [tuple(r) for r in built.ranges(table).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == expected
    with pytest.raises(UnknownRevision):
        index.ranges(spark.createDataFrame([("b", "x", "c059", "c001")], "repo string, range_id string, base string, head string"))
    # edges whose places were never written do not count
    shutil.copytree(f"{tmp_path}/i/edges/batch=1", f"{tmp_path}/i/edges/batch=9")
    assert {tuple(r) for r in index.ranges(table).collect()} == expected


def test_engine_and_path_filter_of_ones_own(spark):
    key, other, commits, files, blobs = history(spark)

    def engine(texts, keys, text, options, custom_rules):
        return raw_hits(texts, keys, text, options, custom_rules).where(F.col("matched_text") == key)

    done = scan_history(commits, files, blobs, ScanOptions(max_file_size=2000), engine=engine, path_filter=lambda p: ~F.endswith(p, F.lit("f.py")))
    assert {(r.file_path, r.matched_text) for r in done.findings.where("rule_id LIKE 'aws%'").collect()} == {("src/p.py", key), ("logo.png", key)}
    assert {(r.blob_sha, r.is_dirty) for r in done.read.collect()} == {("k", True), ("r", False), ("o", False)}
    with pytest.raises(ValueError):
        scan_history(commits, files, blobs, engine=engine, store=HitStore(spark, "x"))


def test_bucketed_contents_are_not_shuffled(spark):
    """A part of a bucketed table of contents is read without an exchange of contents."""
    key, other, commits, files, blobs = history(spark)
    save_blobs(blobs, "bucketed_blobs", 8)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        table, wanted = spark.table("bucketed_blobs"), files.select("blob_sha").distinct()
        plan = table.join(wanted, "blob_sha", "left_semi")._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("FileScan parquet") - 400 : plan.index("FileScan parquet")]
        assert "Bucketed: true" in plan and "Exchange" not in side
        found = scan_history(commits, files, table, ScanOptions(since_commit="c2", max_file_size=2000)).findings
        assert as_rows_of(found) == as_rows(scan_history(commits, files, blobs, ScanOptions(since_commit="c2", max_file_size=2000)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_blobs")


def as_rows_of(findings):
    columns = ["repo", "file_path", "line_number", "matched_text", "rule_id", "commit_sha"]
    return sorted(tuple(r[c] for c in columns) for r in findings.collect())
