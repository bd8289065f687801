"""Rule rows against rules compiled into the plan, and against a plain loop."""

import random
import re
import time

from pyspark.sql import functions as F

from credsieve.functions.regex import required
from credsieve.operators import rule_table
from credsieve.operators.detect import detect
from credsieve.options import ScanOptions
from credsieve.plans.scan import scan_texts
from credsieve.sources.rules import as_rules, split_rules

ONLY = ScanOptions(use_builtin_rules=False, use_keywords=False, use_entropy=False)
RULES = "rule_idx int, id string, name string, pattern string, severity string"
ROWS = [
    (9, "late", None, "zed[0-9]+", "low"),
    (1, "word", "Word", r"\bzed", None),
    (2, "any-case", None, "(?i)KEY_é?x", "high"),
    (3, "python", None, r"(q)?(?(1)w|ee)[0-9]", "critical"),
    (4, "cross", None, r"begin\s+end", "high"),
    (5, "free", None, "[0-9]{3}$", "medium"),
    (6, "bad", None, "[x", "high"),
    (7, "worse", None, "x", "odd"),
    (8, None, None, "y", "high"),
    (10, "kelvin", None, "(?i)kis", "low"),
    (11, "either", None, "alpha|beta+", "low"),
    (12, "", None, "z", None),
]
TEXTS = [
    "zed1 zed1 zed22\nxzed3", "KEY_x key_Éx key_éX", "qw5 ee7 w5", "begin\n\n end begin end", "tail 123", "12\n345",
    "KIS kis KiS kIſ", "alpha betaaa", "zed9 # credsieve:ignore", "", None, "x" * 5000 + " zed4", "one\r\ntwo zed5\r\n",
]


def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)


def shown(found):
    columns = ["id", "line_number", "rule_id", "rule_name", "severity", "matched_text", "line_content", "detection_type"]
    return sorted(tuple(r[c] for c in columns) for r in found.select(*columns).collect())


def test_rows_mean_what_compiled_rules_mean(spark, monkeypatch):
    rules = spark.createDataFrame(ROWS, RULES)
    expected = shown(detect(texts(spark), ["id"], "text", ONLY, as_rules(split_rules(rules)[0])))
    assert shown(detect(texts(spark), ["id"], "text", ONLY, rules)) == expected
    assert {"word", "any-case", "python", "cross", "free", "kelvin", "either"} <= {r[2] for r in expected}
    # in slices of a rule each
    monkeypatch.setattr(rule_table, "SLICE", 1)
    sets = list(rule_table.rule_sets(rules, 5, 1))
    assert [list(s.rows) for s in sets] == [[5 + n] for n in range(8)]
    found = rule_table.table_hits(texts(spark).where("text IS NOT NULL").withColumnRenamed("text", "_text"), ["id"], rules, 0, 1)
    whole = rule_table.table_hits(texts(spark).where("text IS NOT NULL").withColumnRenamed("text", "_text"), ["id"], rules)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


def test_beside_the_other_detectors(spark):
    rules = spark.createDataFrame(ROWS, RULES)
    table = texts(spark).selectExpr("'r' AS repo", "concat(id, '.py') AS path", "concat(text, '\\napi_key = \"zed77aa41\"') AS text")
    columns = ["file_path", "line_number", "matched_text", "rule_id"]
    rows = sorted(map(tuple, scan_texts(table, custom_rules=rules).select(*columns).collect()))
    assert rows == sorted(map(tuple, scan_texts(table, custom_rules=as_rules(split_rules(rules)[0])).select(*columns).collect()))
    assert any(r[3] == "keyword-api_key" for r in rows) and any(r[3] == "word" for r in rows)


def test_thousands_of_rules(spark):
    """5,000 rules are ready in seconds and do not lengthen the plan."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5000)]
    rules = spark.createDataFrame([(i, f"r{i}", None, f"{w}[0-9]*", "low") for i, w in enumerate(words)], RULES)
    rows = [(i, " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(20))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, text string")
    began = time.time()
    found = detect(df, ["id"], "text", ONLY, rules)
    assert time.time() - began < 20
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {(r.id, r.matched_text) for r in found.collect()}
    assert got == {(i, m) for i, t in rows for w in set(re.findall("[a-h]+", t)) for m in re.findall(f"{w}[0-9]*", t)}


def test_no_rules(spark):
    assert detect(texts(spark), ["id"], "text", ONLY, spark.createDataFrame([], RULES)).collect() == []
    only_bad = spark.createDataFrame([(1, "a", None, "[", None)], RULES)
    assert detect(texts(spark), ["id"], "text", ONLY, only_bad).collect() == []
    assert rule_table.RuleSet([]).candidates("x") == []
    assert split_rules(spark.createDataFrame(ROWS, RULES))[0].where(F.col("id") == "late").count() == 1


def test_conditional_groups_name_their_strings():
    assert required("(~~)?(?(1)~|ghp_abc)") == ["ghp_abc", "~~"]
    assert required("(?:x(ab)|y)?(?(1)q|zzz)") == ["ab", "zzz"]
    assert required("(a)?(?(1)b)") == [] and required("(?=(ab))?(?(1)|zz)") == []
    rng = random.Random(2)
    for p in ("(~~)?(?(1)~|ghp_abc)", "(?:x(ab)|y)?(?(1)q|zzz)", "((ab)?c)?(?(2)d|(?(1)ca|bb))", "(?i)(AB)?(?(1)Q|zz)"):
        for _ in range(2000):
            text = "".join(rng.choice(["~", "ab", "AB", "x", "q", "zz", "z", "c", "d", "ghp_abc", "b"]) for _ in range(6))
            assert not re.search(p, text) or not required(p) or any(s in text.lower() for s in required(p)), (p, text)


def test_rules_that_share_a_pattern(spark):
    """They are tried once, and a finding needs the first of them only."""
    rows = [(i, f"r{i}", None, ["abb+", "(~~)?(?(1)~|abb)"][i % 2], "low") for i in range(40)]
    rules = spark.createDataFrame(rows, RULES)
    one = next(rule_table.rule_sets(rules))
    assert one.always == [] and one.candidates("none") == [] and one.candidates("xabb") == [0, 1]
    df = spark.createDataFrame([(1, "abb abb\nabbb")], "id int, _text string")
    assert rule_table.table_hits(df, ["id"], rules).count() == 80
    assert rule_table.table_hits(df, ["id"], rules, first_only=True).count() == 3
    got = shown(detect(df.withColumnRenamed("_text", "text"), ["id"], "text", ONLY, rules))
    assert [r[1:3] for r in got] == [(1, "r0"), (2, "r0"), (2, "r1")]
