"""Small tables with every awkward case, and brute-force versions to hold results against."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use themselves.
CLASHING = {
    "score": 1.5, "_found": "x", "text_key": 7, "spans": "y", "fp": 3, "ids": "z", "node": 4, "_kept": 5,
    "component_id": 6, "rejected": "r", "path": "p", "license": "l", "_doc_id": 8,
}


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


def awkward_documents():
    """Nulls everywhere, empty and long texts, ties, repeated rows, shared passages."""
    rng = random.Random(5)
    passage = sentence(rng, 120)
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 4),
        (4, "one", None, "a", 3),
        (5, "One two é\U0001f600 three", "fr", None, 9),
        (None, sentence(rng, 30), "en", "a", 1),
        (None, sentence(rng, 30), None, "a", 1),
        (6, sentence(rng, 50) + " " + passage + " " + sentence(rng, 40), "en", "b", 1),
        (7, sentence(rng, 10) + "\n" + passage, "en", "b", 1),
        (8, passage, "en", "c", 1),
        (9, passage, "en", "c", 1),
        (9, passage, "en", "c", 1),
        (10, "same words again " * 200, "en", "c", 1),
        (11, "x" * 3000, "de", "c", 1),
        (12, sentence(rng, 30_000, 10**6), "en", "c", 1),
    ]
    rows += [(100 + i, sentence(rng, rng.randrange(1, 90)), rng.choice(["en", "de", None]), "d", 1) for i in range(20)]
    return rows


def with_clashing(spark, rows, schema=SCHEMA):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(v).alias(c) for c, v in CLASHING.items() if c not in df.columns])


def kept_words(rows, window):
    """Words left when windows that start earlier are cut; repeated rows are one document."""
    seen, out = set(), {}
    keys = sorted({(-1 if d is None else d, t or "", d) for d, t in rows})
    for _, text, doc_id in keys:
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            mark = tuple(words[i : i + window])
            if mark in seen:
                gone[i : i + window] = [True] * window
            seen.add(mark)
        left = b" ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id, text] = (len(words), sum(gone), hashlib.sha256(left).hexdigest())
    return out


def kept_bytes(rows, length):
    """Bytes left when strings that occur twice are cut, and how many runs went."""
    counts = {}
    for _, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            mark = data[i : i + length]
            counts[mark] = counts.get(mark, 0) + 1
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if counts[data[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(data, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(data), sum(gone), runs, left))
    return out


def kept_first_bytes(rows, length):
    """Bytes left when strings that an earlier document or place has are cut; null ids come
    first, rows that repeat are one document."""
    seen, out = set(), {}
    for d, text in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            mark = data[i : i + length]
            if mark in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(mark)
        out[d, text] = bytes(b for b, g in zip(data, gone) if not g)
    return [(d, out[d, t or ""]) for d, t in rows]


def groups(keys, linked):
    """Smallest index of the group of each key, groups being closed under ``linked``."""
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]
