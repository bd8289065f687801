import fnmatch
import json
import random
import re

import pytest
from conftest import token
from pyspark.sql import functions as F

from credsieve.functions.findings import fingerprint
from credsieve.functions.regex import required
from credsieve.operators import allowlist, suppress
from credsieve.operators.joins import hot_keys, join_salted
from credsieve.operators.paths import path_of_url, should_scan
from credsieve.options import ScanOptions
from credsieve.plans.scan import described, scan_texts
from credsieve.sources.lists import parse_allowlist, read_allowlist, read_baseline
from credsieve.sources.rules import as_rules, split_rules


def scanned(spark, paths, **options):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in df.where(should_scan(F.col("path"), ScanOptions(**options))).collect()}


def test_paths(spark):
    paths = ["package-lock.json", "frontend/yarn.lock", "node_modules/pkg/index.js", "assets/logo.png",
             "config/.env.example", "src/main.py", "a/node_modules/x.js", "a\\b\\c.min.js", "poetry.lock"]
    assert scanned(spark, paths) == {"src/main.py", "a/node_modules/x.js"}
    assert "poetry.lock" in scanned(spark, paths, include_paths=["*.lock"])
    assert scanned(spark, paths, exclude_paths=["src/*"]) == set(paths) - {"src/main.py"}
    urls = spark.createDataFrame([("http://a.b/fr/8?p=1#x",), ("https://a.b",), ("https://a.b/x#t",)], "u string")
    assert [r[0] for r in urls.select(path_of_url(F.col("u"))).collect()] == ["fr/8", "", "x"]


ALLOW = """
# Comment line
ALLOWED_EXACT # safe test value
regex:TEST_KEY_[0-9]{4}   # regex entry
scope:test_*.py SCOPED_VALUE
scope:src/* regex:^sc.ped$
scope:alone
regex:[broken
regex:
with#hash
"""


def findings(spark, rows):
    df = spark.createDataFrame(
        [(v, p, "r", "HIGH", 2) for v, p in rows],
        "matched_text string, file_path string, rule_id string, severity string, sev_rank int",
    )
    return described(df)


VALUES = [("xALLOWED_EXACTy", "a"), ("p_TEST_KEY_1234_s", "a"), ("SCOPED_VALUE", "tests/unit/test_auth.py"),
          ("SCOPED_VALUE", "src/prod.py"), ("REAL_SECRET", "a"), ("scoped", "src\\x"), ("scoped", "x/src/x"),
          ("awith#hash", "a")]
KEPT = {("SCOPED_VALUE", "src/prod.py"), ("REAL_SECRET", "a"), ("scoped", "x/src/x")}


def test_allowlist(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([(line,) for line in ALLOW.splitlines()], "value string")
    entries = parse_allowlist(lines)
    rows = {(r.pattern, r.reason, r.scope, r.is_regex) for r in entries.collect()}
    assert rows == {
        ("ALLOWED_EXACT", "safe test value", None, False),
        ("TEST_KEY_[0-9]{4}", "regex entry", None, True),
        ("SCOPED_VALUE", "", "test_*.py", False),
        ("^sc.ped$", "", "src/*", True),
        ("[broken", "", None, True),
        ("with#hash", "", None, False),
    }
    def kept(entries):
        out = allowlist.drop_allowed(findings(spark, VALUES), entries)
        return {(r.matched_text, r.file_path) for r in out.collect()}

    assert kept(entries) == KEPT
    # harmless entries, however many, change nothing
    many = spark.range(700).selectExpr(
        "CASE WHEN id % 3 = 0 THEN concat('zz', id, 'q+$') ELSE concat('none-', id) END AS pattern",
        "CASE WHEN id % 5 = 0 THEN concat('dir', id % 7, '/*') END AS scope", "id % 3 = 0 AS is_regex",
    )
    odd = [(r"(zzz)?(?(1)b|zzzqqq)", None, True), (r"(x)\1zz", None, True), ("(", None, True), ("", None, False)]
    more = spark.createDataFrame(odd, "pattern string, scope string, is_regex boolean")
    assert kept(entries.select("pattern", "scope", "is_regex").unionByName(many).unionByName(more)) == KEPT
    # a table of entries means the same as predicates
    monkeypatch.setattr(allowlist, "FEW", 0)
    monkeypatch.setattr(allowlist, "ALTERNATIVES", 1)
    assert kept(entries) == KEPT
    assert kept(entries.where("pattern = 'none'")) == {v for v in VALUES}
    monkeypatch.undo()
    valid, rejected = allowlist.split_allowlist(entries.unionByName(more.withColumn("reason", F.lit(""))))
    assert valid.count() == 7
    assert {(r.pattern, r.problem.split(":")[0]) for r in rejected.collect()} == {
        ("[broken", "invalid regex"), ("(", "invalid regex"), ("", "empty pattern")}
    plan = allowlist.drop_allowed(findings(spark, VALUES), entries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    only_python = spark.createDataFrame(
        [(r"(RE)?(?(1)AL_)", None, True), ("SCOPED", "*.py", False)],
        "pattern string, scope string, is_regex boolean",
    )
    # the conditional pattern can match the empty string, so it allows everything
    assert kept(only_python) == set()
    path = tmp_path / "allow"
    path.write_text(ALLOW.replace("\n", "\r\n"))
    assert {(r.pattern, r.reason, r.scope, r.is_regex) for r in read_allowlist(spark, str(path)).collect()} == rows
    assert read_allowlist(spark, str(tmp_path / "none")).count() == 0


def model_allows(entries, value, path):
    path = path.replace("\\", "/")
    for pattern, scope, is_regex in entries:
        try:
            found = re.search(pattern, value) if is_regex else pattern in value
        except re.error:
            continue
        names = (path, path.rsplit("/", 1)[-1])
        if pattern and found and (not scope or any(fnmatch.fnmatchcase(n, scope) for n in names)):
            return True
    return False


def test_many_regexes_stay_a_table(spark, monkeypatch):
    """50,000 regexes: no entry in the plan, and what the plain loop allows."""
    rng = random.Random(3)
    values = [("".join(rng.choice("abcXYZ019_-é") for _ in range(rng.randrange(1, 40))), f"d{i % 5}/f{i}.{'py' if i % 3 else 'js'}") for i in range(400)]
    odd = [(r"^[a-c]{2}X", "*.py", True), ("9", "d1/*", False), (r"(?i)ABC0", None, True), (r"(a)\1\1", None, True), ("xyz9|zzz|(cab){2}", None, True),
           (r"(?i)kiss", None, True), (r"(X)?(?(1)Yc|00a)", "d2/*", True), ("[", None, True), (None, None, False), ("", None, True), (r"-$", "f?.js", True)]
    made = [(f"{v[5:9]}.*{v[-2:]}$" if len(v) > 11 and n % 2 else v[:6], None if n % 3 else "*.js", len(v) > 11 and bool(n % 2)) for n, (v, _) in enumerate(values[:120])]
    made = [(re.escape(p) if r else p, s, r) for p, s, r in made]
    rest = spark.range(50_000).selectExpr("concat('q', id, 'w[0-9]+', id % 13, '(u|v)?')  AS pattern", "CAST(NULL AS string) AS scope", "true AS is_regex")
    entries = spark.createDataFrame(odd + made, "pattern string, scope string, is_regex boolean").unionByName(rest)
    expected = {v for v in values if not model_allows([e for e in odd if e[0]] + made, *v)}
    monkeypatch.setattr(allowlist, "BLOCK", 90)
    collected = []
    real = type(entries).collect
    monkeypatch.setattr(type(entries), "collect", lambda self: collected.append(real(self)) or collected[-1])
    out = allowlist.drop_allowed(findings(spark, values), entries)
    monkeypatch.undo()
    assert max(map(len, collected)) <= allowlist.FEW + 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "w[0-9]" not in plan and len(plan) < 60_000
    got = {(r.matched_text, r.file_path) for r in out.collect()}
    assert got == expected and 0 < len(got) < len(values)


def test_texts_are_searched_once(spark, monkeypatch):
    """With an allowlist of any size the texts are in one scan."""
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    # else a filter and what stands behind it would both compute it
    counted = F.udf(count, "string").asNondeterministic()
    texts = spark.range(40).selectExpr("'r' AS repo", "concat('f', id, '.txt') AS path", "concat('api_key = \"zq81', id, 'hh\"') AS text")
    entries = spark.createDataFrame([(f"zq81{i}", None, i % 2 == 0) for i in range(9)], "pattern string, scope string, is_regex boolean")
    rows = {}
    for few in (0, 50):
        monkeypatch.setattr(allowlist, "FEW", few)
        before = seen.value
        found = scan_texts(texts.withColumn("text", counted("text").cast("string")), allowlist=entries)
        rows[few] = {(r.file_path, r.matched_text) for r in found.collect()}
        assert seen.value - before == 40
    assert rows[0] == rows[50] and len(rows[0]) < 40


@pytest.mark.parametrize(
    "pattern,strings",
    [("abC", ["abc"]), ("a.bcd", ["bcd"]), ("(?i)xKy", ["x"]), ("(foo|barx)zz", ["barx", "foo"]), ("a|b*", []), ("x(?:yz){2}w?", ["yz"]),
     (r"^\bAKIA[0-9]+$", ["akia"]), ("(?=q)ab(?!c)d", ["abd"]), ("é+x", ["x"]), ("", []), ("(a(b)c)d", ["abcd"])],
)
def test_required_strings(pattern, strings):
    found = required(pattern)
    assert found == strings or (not strings and not found) or min(map(len, found)) >= min(map(len, strings))


def test_baseline(spark, tmp_path):
    both = findings(spark, [("SECRET_ONE", "a.py"), ("SECRET_TWO", "b.py")])
    prints = [r.fingerprint for r in both.orderBy("file_path").collect()]
    path = tmp_path / "base.json"
    path.write_text(json.dumps({"findings": [{"fingerprint": prints[0], "x": 1}, {"no": 1}, "abc"]}, indent=1))
    known = read_baseline(spark, str(path))
    assert {r[0] for r in known.collect()} == {prints[0], "abc"}
    assert [r.fingerprint for r in suppress.drop_known(both, known).collect()] == prints[1:]
    assert suppress.only_known(both, known).count() == 1
    path.write_text("{not valid json")
    with pytest.warns(UserWarning, match="cannot be read"):
        assert read_baseline(spark, str(path)).count() == 0
    assert read_baseline(spark, str(tmp_path / "none")).count() == 0


def test_baseline_of_several_repositories(spark):
    both = findings(spark, [("S", "a.py")]).crossJoin(spark.createDataFrame([("r1",), ("r2",)], "repo string"))
    known = both.where("repo = 'r1'").select("repo", "fingerprint")
    assert [r.repo for r in suppress.drop_known(both, known).collect()] == ["r2"]


def test_fingerprint_has_no_line(spark):
    df = spark.range(1).select(fingerprint(F.lit("r"), F.lit("p"), F.lit("v")).alias("f"))
    import hashlib

    assert df.first().f == hashlib.sha256(b"r:p:v").hexdigest()


def test_gate_and_counts(spark):
    df = spark.createDataFrame([("MEDIUM", 1), ("LOW", 0)], "severity string, sev_rank int")
    assert tuple(suppress.gate(df).first()) == (2, True, 1)
    assert tuple(suppress.gate(df, "critical").first()) == (0, False, 0)
    assert tuple(suppress.gate(df.limit(0)).first()) == (0, False, 0)
    counts = {r.severity: r.n_findings for r in suppress.severity_counts(df).collect()}
    assert counts == {"LOW": 1, "MEDIUM": 1, "HIGH": 0, "CRITICAL": 0}
    assert suppress.at_least(df, "medium").count() == 1
    with pytest.raises(ValueError):
        suppress.at_least(df, "odd")


def test_rule_rows(spark):
    raw = spark.createDataFrame(
        [(0, "custom-token", None, "CUST_[0-9]{8}", "high"), (1, "bad-regex", "n", "[unclosed", "LOW"),
         (2, "bad-severity", None, "FOO_[0-9]+", "ODD"), (3, None, None, "x", None), (4, "no-pattern", None, "", None),
         (5, "plain", "Plain", "abc", None)],
        "rule_idx int, id string, name string, pattern string, severity string",
    )
    valid, rejected = split_rules(raw)
    rules = as_rules(valid)
    assert [(r.id, r.name, r.severity) for r in rules] == [
        ("custom-token", "custom-token", "HIGH"), ("plain", "Plain", "MEDIUM")]
    problems = {r.id: r.problem for r in rejected.collect()}
    assert problems["bad-regex"].startswith("invalid regex") and "ODD" in problems["bad-severity"]
    texts = spark.createDataFrame([("r", "a.txt", "val = CUST_12345678")], "repo string, path string, text string")
    found = scan_texts(texts, ScanOptions(use_builtin_rules=False), custom_rules=rules).collect()
    assert ("custom-token", "CUST_12345678") in {(f.rule_id, f.matched_text) for f in found}


def test_salted_join(spark):
    rng = random.Random(1)
    many = spark.createDataFrame([(rng.choice("aaaaaabcd"), i) for i in range(500)], "k string, i int")
    few = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("z", 4)], "k string, x int")
    hot = {r.k: r._parts for r in hot_keys(many, ["k"], 50).collect()}
    assert hot["a"] > 4
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = join_salted(many, few, ["k"], how, rows_per_task=50)
        plain = many.join(few, ["k"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())), how


def test_ignored_lines_and_copies(spark):
    key = token("AKIA", "IOSFODNN7EXAMPLE")
    texts = spark.createDataFrame(
        [("r", "tests/f.py", f'T = "{key}"'), ("r", "src/p.py", f'T = "{key}"'),
         ("r", "c.py", f'K = "{key}"  # credsieve:ignore\nK = "{key}"  // pragma: allowlist secret\n')],
        "repo string, path string, text string",
    )
    allow = spark.createDataFrame([(key, "tests/*", False)], "pattern string, scope string, is_regex boolean")
    assert {f.file_path for f in scan_texts(texts, allowlist=allow).collect()} == {"src/p.py"}


def test_texts_for_the_inline_marker(spark):
    """Texts whose path has a marker, in whichever of its rows, and those without a path."""
    from workloads.queries import with_marker

    rows = [("a", "x = 1"), ("b", "x\ny # credsieve:ignore"), ("b", "z"), ("c", None), (None, "n"), ("d", "// pragma: allowlist secret")]
    got = with_marker(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame(
        [rows[1], rows[2], rows[4], rows[5]], "path string, text string").collect())


def test_long_allowlist_is_spread(spark, tmp_path):
    """Entries are parsed by all cores, and made of ids without reading the documents' texts."""
    from workloads.queries import allow_entries

    rows = [(n, f"text {n}", "en", "web", 6) for n in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    lines = allow_entries(spark, str(tmp_path))
    assert lines.count() == 60
    assert "text" not in lines._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1]
    entries = allowlist.prepared(parse_allowlist(lines))
    sizes = [n for n in entries.rdd.glom().map(len).collect() if n]
    assert sum(sizes) == 40 and len(sizes) > 3


def test_long_allowlist_with_hot_grams(spark, monkeypatch):
    """Grams in many texts are cut into parts by the counts there are; the index is counted once."""
    texts = [(f"{n % 3}.py", f"common-prefix-{n:04d}") for n in range(300)]
    values = spark.createDataFrame(texts, "file_path string, matched_text string")
    patterns = [("common-prefix", "1.py", False), ("prefix-00[0-4]", None, True), ("fix-0299", None, False), ("absent-string", None, False)]
    entries = allowlist.prepared(spark.createDataFrame(patterns, allowlist.ENTRY))
    counted = []
    monkeypatch.setattr("credsieve.operators.joins.hot_keys", lambda many, *a: counted.append(many.columns) or hot_keys(many, *a))
    got = {tuple(r) for r in allowlist.allowed_texts(values, entries, rows_per_task=20).collect()}
    assert got == {
        (p, t) for p, t in texts if p == "1.py" or re.search("prefix-00[0-4]", t) or "fix-0299" in t
    }
    assert not [c for c in counted if "matched_text" in c]
