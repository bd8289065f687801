"""Brute-force model of the detectors in plain Python, for comparison on small texts."""

import math
import re
from collections import Counter

from credsieve.functions import values as V
from credsieve.operators.keywords import FORMS, _QUOTED
from credsieve.options import IGNORE_MARKERS, KEYWORDS
from credsieve.rules import BUILTIN_RULES

MARKER = re.compile("|".join(IGNORE_MARKERS), re.I)
HEX = set("0123456789abcdefABCDEF")
B64 = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")


def bits(s):
    n = len(s)
    return sum(-c / n * math.log2(c / n) for c in Counter(s).values())


def valid(value, least=4, extra=()):
    v = value.strip()
    while v and v[0] in "'\"` ":
        v = v[1:]
    while v and v[-1] in "'\"` ":
        v = v[:-1]
    low = v.lower()
    checks = [
        len(v) < least,
        low in V.STOP_VALUES or low in {e.lower() for e in extra},
        any(low.startswith(p) for p in V.FALSE_STARTS + V.ARTICLES),
        any(low.endswith(e) for e in V.FALSE_ENDS),
        re.match("https?://", low) and "@" not in low,
        "".join(c for c in v if c not in ":-").isdigit(),
        len(Counter(v)) < 2,
        sum(v.count(c) for c in "<>(){}|&;") > 1,
        len(v.split()) > 2,
    ]
    return not any(checks)


def noise(line):
    bare = line.strip()
    starts = (V.COMMENT_LINE, V.IMPORT_LINE, V.TYPE_LINE)
    return (
        not bare or any(re.match(p, bare) for p in starts) or bool(re.search(V.SIGNATURE_LINE, bare))
    )


def patterns(text, rules=BUILTIN_RULES):
    for i, rule in enumerate(rules):
        for pos, m in enumerate(re.finditer(rule.pattern, text)):
            before = text[: m.start()]
            n = before.count("\n")
            yield (0, i, pos), n + 1, text.split("\n")[n].rstrip("\r\n"), m.group(), rule.id, None


def keywords(text, words=KEYWORDS, flags=re.I, least=4):
    alternatives = "|".join(map(re.escape, words))
    for number, line in enumerate(text.splitlines(), 1):
        if noise(line):
            continue
        for form, (_, shape) in enumerate(FORMS):
            rx = shape.replace("QUOTED", _QUOTED).replace("KEYWORD", alternatives)
            for pos, m in enumerate(re.finditer(rx, line, flags)):
                if m.group(2):
                    value = m.group(3).strip()
                else:
                    value = m.group(4).strip()
                    value = re.split("#|//", value, maxsplit=1)[0].strip()
                    value = re.sub("['\"`,;]+$", "", value)
                if valid(value, least):
                    yield (1, form, pos), number, line, value, "keyword-" + m.group(1).lower(), None


def runs(text, charset, least):
    start = None
    for i, c in enumerate(text + "\0"):
        if c in charset:
            start = i if start is None else start
        elif start is not None:
            if i - start >= least:
                yield start, i
            start = None


def entropy(text, hex_threshold=3.0, base64_threshold=4.5):
    found = []
    for name, charset, least, threshold in (
        ("hex", HEX, 8, hex_threshold),
        ("base64", B64, 12, base64_threshold),
    ):
        for a, b in runs(text, charset, least):
            t = text[a:b]
            line_start = text.rfind("\n", 0, a) + 1
            seen = text[max(line_start, a - 60) : b]
            if name == "base64" and set(t) <= HEX or bits(t) < threshold - 1e-9:
                continue
            if re.search(r"https?://[^\s'\"<>]*\Z", seen, re.I):
                continue
            if t.count("/") > 1 or t.count("-") > 1:
                continue
            found.append((a, b, name, bits(t)))
    kept = []
    for a, b, name, h in sorted(found, key=lambda f: (-round(f[3], 12), f[0] - f[1])):
        if all(b <= c or d <= a for c, d, _, _ in kept):
            kept.append((a, b, name, h))
    for a, b, name, h in sorted(kept):
        n = text[:a].count("\n")
        yield (2, 0, a), n + 1, text.split("\n")[n].rstrip("\r\n"), text[a:b], "entropy-" + name, h


def detect(text, rules=BUILTIN_RULES, hex_threshold=3.0, base64_threshold=4.5):
    """{(line, matched text): (rule id, line content, entropy)}"""
    hits = [*patterns(text, rules), *keywords(text), *entropy(text, hex_threshold, base64_threshold)]
    out = {}
    for _, number, line, match, rule, h in sorted(hits, key=lambda x: x[0]):
        if not MARKER.search(line):
            out.setdefault((number, match), (rule, line, None if h is None else round(h, 9)))
    return out
