"""The Spark detectors against the plain-Python model on random texts."""

import random
import string

import model
import pytest
from conftest import token
from pyspark.sql import functions as F

from credsieve.operators.detect import detect
from credsieve.options import ScanOptions
from credsieve.rules import Rule

HEXES = "0123456789abcdef"


def rand(rng, chars, low, high):
    return "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))


def provider_token(rng):
    h = rand(rng, HEXES, 128, 128)
    uuid = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"
    return rng.choice([
        token("AKIA", h[:16].upper()), token("ASIA", h[:16].upper()), token("amzn.mws.", uuid),
        token("sk-proj-", h[:24]), token("sk-ant-api03-", h[:84]), token("hf_", h[:34]),
        token("ghp_", h[:36]), token("github_pat_", h[:82]), token("ghs_", h[:36]),
        token("glpat-", h[:20]), token("xoxb-1234567890-1234567890-", h[:24]),
        token("https://hooks.slack.com/services/T", h[:8] + "/B" + h[8:16] + "/" + h[16:40]),
        token("sk_live_", h[:24]), token("AIza", h[:35]), '"type" : "service_account"',
        '"client_secret":\n "' + h[:24] + '"', token("Azure_Key = ", h[:32]),
        "DefaultEndpointsProtocol=https;AccountName=a\nb;AccountKey=" + h[:40] + ";",
        token("dop_v1_", h[:64]), token("hvs.", h[:24]), token("dapi", h[:32]),
        token("PMAK-", h[:24] + "-" + h[:34]), token("AC", h[:32]), token("SK", h[:32]),
        token("SG.", h[:22] + "." + h[:43]), token("key-", h[:32]), token("npm_", h[:36]),
        token("pypi-", h[:100]), token("dckr_pat_", h[:20]),
        "-----BEGIN RSA " + "PRIVATE KEY-----", token("eyJ", h[:12] + ".eyJ" + h[:12] + "." + h[:12]),
        token("HEROKU_API_KEY = ", uuid), token("123456789:", h[:35]),
        token("M", h[:23] + "." + h[23:29] + "." + h[29:56]), token("shpat_", h[:32]),
        token("sq0atp-", h[:22]),
    ])


def fragment(rng):
    kind = rng.randrange(14)
    if kind == 0:
        return provider_token(rng)
    if kind == 1:
        return rand(rng, HEXES, 6, 40)
    if kind == 2:
        return rand(rng, string.ascii_letters + string.digits + "+/=_-", 8, 60)
    if kind == 3:
        word = rng.choice(["password", "API_KEY", "db_pass", "toKen", "ſecret", "Secret_key", "pwd", "apiKey"])
        value = rng.choice([rand(rng, string.ascii_letters + "#/;, ", 3, 12), "changeme", "os.getenv('X')",
                            "hunter2xyz", "https://a.b/c", "1000:1000", "this is a sentence", "aaaaaa", "f(x)|g"])
        quote = rng.choice(["'", '"', ""])
        sign = rng.choice([" = ", "=", ": ", " => ", ":", "="])
        head = rng.choice(["", "export ", "'", '"', "my_", "x."])
        close = head if head in ("'", '"') else ""
        return f"{head}{word}{close}{sign}{quote}{value}{rng.choice([quote, quote, ''])}"
    if kind == 4:
        return rng.choice(["# ", "// ", "def f(x): ", "import ", "class X", "static ", ") -> str"])
    if kind == 5:
        return rng.choice(["https://", "http://", "HTTPS://x.y/", "https://" + "z" * rng.randint(0, 70) + "/", "https:"])
    if kind == 6:
        return rng.choice(["credsieve:ignore", "pragma : allowlist  secret", "Pragma: Allowlist Secret"])
    if kind == 7:
        return rng.choice(["\n", "\n", "\n", "\r\n", "\r", "\x0b", " ", "\x85", "\x01", "\x1c"])
    if kind == 8:
        return rng.choice([" ", "\t", " ", '"', "'", "<", ">", ",", ";", ".", ":", "=", "　"])
    if kind == 9:
        return rng.choice(["é", "ß", "😀😀😀", "日本", "\u0131", "\u212a"])
    if kind == 10:
        return "deadbeef" + rand(rng, HEXES, 0, 12) + rng.choice(["-", "_", "g", "/"])
    return rng.choice([" ", "\n", rand(rng, string.ascii_lowercase, 1, 9)])


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(fragment(rng) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def spark_findings(spark, rows, **kw):
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(8)
    found = {i: {} for i in range(len(rows))}
    for r in detect(df, ["id"], **kw).collect():
        value = (r.rule_id, r.line_content, None if r.entropy is None else round(r.entropy, 9))
        assert found[r.id].setdefault((r.line_number, r.matched_text), value) == value
    return found


def compare(rows, found, **kw):
    n = 0
    for i, text in enumerate(rows):
        expected = model.detect(text, **kw)
        assert found[i] == expected, repr(text)
        n += len(expected)
    return n


def test_default_options(spark):
    rows = texts(1, 3000) + ["", "\n", "a\n"]
    assert compare(rows, spark_findings(spark, rows)) > 3000


@pytest.mark.parametrize("hexes,base64s", [(2.0, 3.0), (3.5, 2.5), (3.0, 4.0)])
def test_other_thresholds(spark, hexes, base64s):
    rows = texts(int(hexes * 10), 800)
    options = ScanOptions(hex_threshold=hexes, base64_threshold=base64s)
    assert compare(
        rows, spark_findings(spark, rows, options=options), hex_threshold=hexes, base64_threshold=base64s
    )


def test_custom_rules_incl_python_only(spark):
    rules = [
        Rule("words", "Words", "HIGH", r"(?P<a>\b\w{5})\s+(?P=a)?\d*$"),
        Rule("lines", "Lines", "LOW", r"(?m)^[a-c]+.*$"),
        Rule("dots", "Dots", "LOW", r"(?s)dead.{3}[^\W\d]?"),
        Rule("cond", "Conditional", "LOW", r"(<)?beef(?(1)>|\w)"),
        Rule("ci", "Ignore case", "MEDIUM", r"(?i)secret|\bkey"),
    ]
    assert [r.java is None for r in rules] == [False, False, False, True, False]
    rows = texts(7, 1500)
    options = ScanOptions(use_builtin_rules=False)
    found = spark_findings(spark, rows, options=options, custom_rules=rules)
    assert compare(rows, found, rules=rules) > 500


def test_detectors_can_be_switched_off(spark):
    rows = texts(9, 200)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    off = ScanOptions(use_keywords=False, use_entropy=False)
    types = detect(df, ["id"], options=off).select("detection_type").distinct().collect()
    assert [t[0] for t in types] == ["PATTERN"]
    off = ScanOptions(use_builtin_rules=False, use_entropy=False)
    types = detect(df, ["id"], options=off).select("detection_type").distinct().collect()
    assert [t[0] for t in types] == ["KEYWORD"]
    off = ScanOptions(use_builtin_rules=False, use_entropy=False, use_keywords=False)
    assert detect(df, ["id"], options=off).count() == 0


def test_many_matches_in_one_text(spark):
    key = token("AKIA", "ABCDEFGHIJKLMNOP")
    text = "\n".join(f"{key} {key}" for _ in range(20000))
    df = spark.createDataFrame([(1, text)], "id long, text string")
    found = detect(df, ["id"]).agg(F.count("*"), F.max("line_number")).first()
    assert tuple(found) == (20000, 20000)


def test_detection_reads_texts_once_and_does_not_shuffle_them(spark):
    from credsieve.operators.detect import raw_hits

    df = spark.createDataFrame([(1, "x")], "id long, text string")
    plan = raw_hits(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan ") == 1
