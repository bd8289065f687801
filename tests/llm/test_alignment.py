"""Alignment of two tokenizers against a plain version over byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from credsieve.llm import alignment
from llm.cases import SCHEMA, awkward_documents, with_clashing

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


def ranges(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def both(text):
    """(id, start, end) of the tokens of both, None without tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a = [(i, bytes(BYTES[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        piece = B.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return None
    return ranges(a), ranges(b)


def expected(rows):
    counts, found = Counter(), []
    for doc_id, text in rows:
        tokens = both(text)
        if tokens is None:
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = tokens
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 400 else near(a, b)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, low = [], 0
        ia = ib = 0
        for end in ends:
            ja, jb = ia, ib
            while ja < len(a) and a[ja][2] <= end:
                ja += 1
            while jb < len(b) and b[jb][2] <= end:
                jb += 1
            groups.append(",".join(str(x[0]) for x in a[ia:ja]) + "|" + ",".join(str(y[0]) for y in b[ib:jb]))
            ia, ib = ja, jb
        counts.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        ((d, na, nb, ng, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), g) for d, na, nb, ng, ls, g in found),
        key=str,
    )


def near(a, b):
    """The same links for long texts: only tokens that are not behind can overlap."""
    out, j = [], 0
    for x in a:
        while b[j][2] <= x[1]:
            j += 1
        k = j
        while k < len(b) and b[k][1] < x[2]:
            out.append((x[0], b[k][0]))
            k += 1
    return out


def texts():
    rng = random.Random(8)
    letters = list("abcdeéß ,.'\n\t 0123") + ["the", "ing", " ", "  ", " ", "中", "\U0001f600", "\r\n", " ", "\x00", "\x1c"]
    odd = [
        "<|endoftext|> is text", "</s> <s> <unk>", "a▁b", "▁", " ", "  lead", "trail  ", "\n", "<0x41>", "ﬁ ½ Å",
        "é", "x" * 5000, "中" * 3000, "can't won't  I'll\t\tgo", "﻿bom", "0" * 40, "​ zero",
    ]
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    return odd + made


def figures(rows):
    return sorted(((r.doc_id, *(r[c] for c in alignment.FIGURES), r.groups_sha256) for r in rows), key=str)


def test_query(spark, tmp_path):
    rows = awkward_documents() + [(1000 + i, t, None, None, 0) for i, t in enumerate(texts())]
    with_clashing(spark, rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op13_cross_tokenizer_alignment"](spark, str(tmp_path)).collect()
    assert figures(got) == expected([r[:2] for r in rows])
    assert sum(r.n_a == 0 for r in got) == 4


def test_slices_shards_and_levels_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "PAIRS_HELD", 50)
    monkeypatch.setattr(alignment, "ROWS", 7)
    monkeypatch.setattr(alignment, "WORDS_KEPT", 20)
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = alignment.align(docs, shard_keys=60, broadcast_bytes=20_000).collect()
    assert figures(got) == expected(rows)


def test_empty_table_and_no_tokens(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = alignment.align(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect()
    assert figures(got) == [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 31, n))
    f = alignment.PerfectHash.of(keys)
    assert sorted(f.look_up(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(5000) * 7919, keys)
    assert (f.look_up(others) == -1).all()
    again = alignment.PerfectHash.unpacked(*f.packed())
    assert (again.look_up(keys) == f.look_up(keys)).all()
