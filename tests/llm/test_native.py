import math
import re
from collections import Counter

import pytest

from llm.cases import SCHEMA, awkward_documents, sentence, with_clashing
from pyspark.sql import functions as F

from credsieve.llm import decontaminate, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def slow_contamination(rows, items, window):
    grams = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for doc_id, text, *_ in rows:
        w = words(text)
        hit, found = set(), set()
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                own = grams.get(tuple(w[i : i + m]))
                if own:
                    hit |= set(range(i, i + m))
                    found |= own
        out.append((str(doc_id), len(w), len(hit), sorted(found)))
    return sorted(out)


def benchmark_rows():
    rows = awkward_documents()
    w = rows[9][1].split()
    return [
        (1, " ".join(w[10:40]).upper()), (2, " ".join(w[30:60])), (3, "ONE!"), (4, None), (5, ""), (6, " ".join(w[5:11])),
        (7, "words, again. Same words"), (8, " ".join(rows[14][1].split()[2040:2060])), (2, " ".join(w[70:90])),
    ]


def test_contamination_against_brute_force(spark):
    rows = awkward_documents()
    docs = with_clashing(spark, rows)
    items = benchmark_rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = decontaminate.contamination(docs, benchmark).collect()
    expected = slow_contamination(rows, items, 13)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in got) == expected
    assert sum(e[2] > 0 for e in expected) >= 6
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    clean = [e[0] for e in expected if not (e[2] and 20 * e[2] >= e[1])]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(clean)


def test_shuffled_lookup_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(awkward_documents(), SCHEMA)
    benchmark = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    first = sorted(map(str, decontaminate.contamination(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(str, decontaminate.contamination(docs, benchmark).collect())) == first


def test_cut_spans(spark):
    docs = spark.createDataFrame([(1, "A b-c, d e. f"), (2, "x"), (3, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "C D")], "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark)
    assert {r.doc_id: r.text for r in decontaminate.cut_spans(docs, found).collect()} == {1: "A b-e. f", 2: "x", 3: ""}


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.contamination(docs, none).first()
    assert (row.n_words, row.n_hit, row.item_ids, row.spans) == (2, 0, [], [])
    assert decontaminate.drop_contaminated(docs, none).count() == 1
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_licences(spark):
    text = sentence(__import__("random").Random(1), 40)
    files = spark.createDataFrame(
        [
            ("a/LICENSE", "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software."),
            ("a/x/one.c", f"# Licensed under the Apache License, Version 2.0.\n{text}"),
            ("a/x/two.c", text), ("a/x/y/three.c", text), ("a/x/y/COPYING", "GNU General Public License version 3"),
            ("b/four.c", text), ("b/five.c", None), (None, None), ("a/x/two.c", text), ("top.c", "All rights reserved."),
            ("c/z.c", "the license of this is not any known one at all, really"),
        ],
        "path string, text string",
    ).withColumn("score", F.lit("clash")).withColumn("above", F.lit(1))
    rows = licenses.scan(files).collect()
    got = {(r.path, r.license, r.origin, r.from_dir) for r in rows}
    assert len(rows) == 11
    assert got == {
        ("a/LICENSE", "MIT", "header", None), ("a/x/one.c", "Apache-2.0", "header", None),
        ("a/x/two.c", "MIT", "inherited", "a"), ("a/x/y/three.c", "GPL-3.0", "inherited", "a/x/y"),
        ("a/x/y/COPYING", "GPL-3.0", "header", None), ("b/four.c", "none", "none", None), ("b/five.c", "none", "none", None),
        ("", "none", "none", None), ("top.c", "LicenseRef-proprietary", "header", None), ("c/z.c", "none", "none", None),
    }
    assert licenses.scan(files.limit(0)).count() == 0
    assert {r.origin for r in licenses.scan(files, licenses.template_table(spark, [("X", "")])).collect()} == {"none"}


def test_notice_in_a_longer_licence_file(spark):
    """The notice is under half of the file, so that the whole text is like no template."""
    text = sentence(__import__("random").Random(2), 25)
    rows = [("d/LICENSE", f"{text}\nLicensed under the Apache License, Version 2.0.\n{text}"), ("d/e/one.c", text)]
    rows += [(f"x/{i}.c", f"# {n}\n{text}") for i, n in enumerate(["Released under the MIT License.", "All rights reserved."])]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert (got["d/LICENSE"].license, got["d/LICENSE"].score, got["d/LICENSE"].origin) == ("Apache-2.0", 1.0, "header")
    assert (got["d/e/one.c"].license, got["d/e/one.c"].from_dir) == ("Apache-2.0", "d")


def named(name):
    """The longest template of a licence, as a file with a title and an owner."""
    text = max((t for n, t in licenses.TEMPLATES if n == name), key=len)
    words = text.split()
    lines = [" ".join(words[i : i + 11]) for i in range(0, len(words), 11)]
    return "\n".join(["Copyright (c) 2019, A. Person and others", "All rights reserved.", "", *lines])


def slow_scores(files, templates):
    """Best (score, licence) of each file by plain Python, from the stated rule."""
    token, cue = re.compile(licenses.TOKEN), re.compile(licenses.CUES)
    is_license = {p: bool(re.search(licenses.LICENSE_FILE, p.rsplit("/", 1)[-1])) for p, _ in files}
    headers = {}
    for p, t in files:
        lines = [x for x in t.split("\n") if cue.search(x.lower())]
        headers[p] = [Counter(token.findall(x.lower())) for x in ([t, *lines] if is_license[p] else lines)]
    counted = [h for p, hs in headers.items() for i, h in enumerate(hs) if h and (not is_license[p] or i == 0)]
    vectors = [(n, Counter(token.findall(t.lower()))) for n, t in templates]
    vocabulary = {w for _, v in vectors for w in v}
    total = len(counted) + len(templates)
    idf = {w: math.log((1 + total) / (1 + sum(w in h for h in counted) + sum(w in v for _, v in vectors))) + 1 for w in vocabulary}
    new = math.log(1 + total) + 1

    def cosine(a, b):
        weight = lambda c: {w: n * idf.get(w, new) for w, n in c.items()}
        x, y = weight(a), weight(b)
        norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        return round(min(1.0, sum(v * y.get(w, 0) for w, v in x.items()) / norm), 6) if norm else 0

    out = {}
    for p, hs in headers.items():
        found = [(n in licenses.GENERIC, -cosine(h, v), n) for h in hs for n, v in vectors]
        found = [f for f in found if -f[1] >= licenses.LEAST]
        out[p] = (min(found)[2], -min(found)[1]) if found else None
    return out


def test_licenses_against_a_plain_version(spark):
    known = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0"]
    files = [(f"{n}/LICENSE", named(n)) for n in known]
    files += [(f"{n}/src/a.py", "import os") for n in known]
    files += [("own/LICENSE.txt", "All rights reserved."), ("own/b.c", "x\nCopyright me. All rights reserved.\n"), ("c.c", "Released under the MIT License.\nbody " * 3)]
    files += [("short/LICENSE", "Our notes\nLicensed under CC BY 4.0.\n" + "some other words of a note " * 4)]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for n in known:
        assert (got[f"{n}/LICENSE"].license, got[f"{n}/LICENSE"].origin) == (n, "header")
        assert (got[f"{n}/src/a.py"].license, got[f"{n}/src/a.py"].from_dir) == (n, n)
    assert got["own/LICENSE.txt"].license == got["own/b.c"].license == "LicenseRef-proprietary"
    assert got["short/LICENSE"].license == "CC-BY-4.0"
    expected = slow_scores(files, licenses.TEMPLATES)
    for p, best in expected.items():
        if best:
            assert got[p].license == best[0] and got[p].score == pytest.approx(best[1], abs=2e-6)
        else:
            assert got[p].origin != "header"
