import hashlib
import random

import numpy as np
import pytest
from llm.cases import SCHEMA, awkward_documents, kept_bytes, kept_first_bytes, kept_words, with_clashing

from credsieve.llm import relative_lz, rolling, suffix


def test_anchors_follow_content():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd ") for _ in range(5000))
    a = rolling.byte_anchors(data, 20, 60)
    b = rolling.byte_anchors(b"xyz" * 50 + data[1000:3000] + b"q" * 70, 20, 60)

    def windows(found):
        return {int(p - s): (int(s), int(h)) for p, lo, hi, h in zip(*found) for s in range(lo, hi + 1)}

    one, two = windows(a), windows(b)
    assert len(one) == len(data) - 59
    for start in range(1000, 3000 - 59):
        assert one[start] == two[start - 1000 + 150]


def test_blocks_of_anchors_do_not_change_them(monkeypatch):
    values = rolling.mix(np.arange(3000, dtype=np.uint64) % np.uint64(700))
    whole = rolling.anchors(values, 5, 20)
    monkeypatch.setattr(rolling, "BLOCK", 256)
    parts = rolling.anchors(values, 5, 20)

    def windows(found):
        return {int(p - s): (int(s), int(h)) for p, lo, hi, h in zip(*found) for s in range(lo, hi + 1)}

    assert windows(whole) == windows(parts)


def test_deep_shallow_sorts():
    rng = random.Random(2)
    for _ in range(400):
        known = rng.choice([0, 5, 20])
        base = bytes(rng.choice(b"ab") for _ in range(60))
        strings = []
        for _ in range(rng.randint(1, 12)):
            text = bytearray(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(known, 60)] = rng.choice(b"abc")
            strings.append(bytes(text[: rng.choice([60, 60, known + rng.randint(0, 40)])]))
        order, lcp = suffix.deep_shallow(strings, known)
        assert [strings[i] for i in order] == sorted(strings)
        assert lcp[1:] == [suffix.common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]


@pytest.mark.parametrize("group", [2000, 2])
def test_bytes_against_brute_force(spark, monkeypatch, group):
    """Also with groups so small that their windows are counted by hash."""
    monkeypatch.setattr(suffix, "GROUP", group)
    rows = awkward_documents()
    docs = with_clashing(spark, rows).repartition(4)
    spans = suffix.repeated_spans(docs, 60, 20)
    got = sorted(
        (str(r.doc_id), r.n_bytes, sum(s.hi - s.lo for s in r.spans or []), len(r.spans or []), bytes(r.kept))
        for r in suffix.without_spans(docs, spans).collect()
    )
    assert got == sorted((str(d), *rest) for d, *rest in kept_bytes([r[:2] for r in rows], 60))


@pytest.mark.parametrize("group", [2000, 1])
def test_first_copy_stays(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rng = random.Random(9)
    parts = [bytes(rng.choice(b"abcdef \xc3") for _ in range(90)).decode("latin-1") for _ in range(6)]
    mixed = [(200 + i, "".join(rng.choice(parts)[rng.randrange(30) :] for _ in range(rng.randrange(1, 5)))) for i in range(40)]
    rows = [r[:2] for r in awkward_documents()] + mixed + [(d + 100, t) for d, t in mixed[:9]] + mixed[3:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spans = suffix.repeated_spans(docs, 60, 20, keep_first=True)
    got = sorted((str(r.doc_id), bytes(r.kept)) for r in suffix.without_spans(docs, spans).collect())
    assert got == sorted((str(d), kept) for d, kept in kept_first_bytes(rows, 60))


def test_cut_texts_keep_their_columns(spark):
    docs = with_clashing(spark, awkward_documents())
    cut = suffix.remove_repeats(docs, 60, 20)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] is None and texts[2] == "" and texts[8] == "" and texts[4] == "one"


def test_words_against_brute_force(spark):
    rows = awkward_documents()
    docs = with_clashing(spark, rows).repartition(4)
    found = relative_lz.factors(docs)
    expected = kept_words([r[:2] for r in rows], 20)
    got = relative_lz.without_copies(docs, found).collect()
    assert len(got) == len(rows)
    by_result = sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got)
    assert by_result == sorted((str(r[0]), *expected[r[0], r[1] or ""]) for r in rows)


def test_factors_name_their_source(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"a b c {passage}"), (2, f"d {passage} e")], "doc_id long, text string")
    found = relative_lz.factors(docs).collect()
    assert [r.doc_id for r in found] == [2]
    assert [tuple(s) for s in found[0].spans] == [(1, 81)]
    assert all(f.ref_id == 1 and f.lo - f.ref_lo == -2 for f in found[0].factors)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert suffix.without_spans(docs, suffix.repeated_spans(docs)).count() == 0
    assert relative_lz.without_copies(docs, relative_lz.factors(docs)).count() == 0
