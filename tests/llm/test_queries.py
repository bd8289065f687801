"""The registered queries and the pipeline on a small folder of tables, by brute force."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import pytest
from llm.cases import SCHEMA, awkward_documents, groups, kept_bytes, kept_first_bytes, kept_words
from llm.test_models import prose
from llm.test_native import benchmark_rows, slow_contamination
from llm.test_near import slow_simhash
from llm.test_packing import encode

import __spark_entry__ as entry
import corpus_pipeline
from credsieve.llm import langid, suffix
from credsieve.llm.common import remainder
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    rows = [r for r in awkward_documents() if r[0] is not None]
    passage = prose(rng, "aa", 90)
    long = prose(rng, "bb", 3000)
    rows += [(500 + i, f"{prose(rng, 'aa', 30)} {passage} {prose(rng, 'aa', 20 + i)}", "aa", "s", 1) for i in range(5)]
    rows += [(520, long, "bb", "s", 1), (521, long + " autre", "bb", "s", 1), (522, long, "bb", "s", 1)]
    rows += [(600 + i, prose(rng, lang, 60), lang, "s", 1) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s, _ in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = benchmark_rows() + [(20, " ".join(rows[-1][1].split()[5:30]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_every_query_is_registered():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_op2(spark, folder):
    path, rows, _ = folder
    texts = defaultdict(list)
    for d, t, *_ in rows:
        texts[d].append(encode(t))
    for r in entry.queries()["op2_packing"](spark, path).collect():
        assert any(len(ids) == r.doc_tokens and crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in texts[r.doc_id])
        assert 0 <= r.offset and r.offset + r.length <= 4096


def test_op3(spark, folder):
    path, rows, _ = folder
    expected = kept_words([r[:2] for r in rows], 20)
    got = entry.queries()["op3_substring_dedup"](spark, path).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(
        (r[0], *expected[r[0], r[1] or ""]) for r in rows
    )


def test_op7(spark, folder):
    path, rows, _ = folder
    got = entry.queries()["op7_simhash_near_dedup"](spark, path).collect()
    fps = [slow_simhash(r[1]) for r in rows]
    roots = groups(fps, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    least = defaultdict(lambda: 1 << 60)
    for root, r in zip(roots, rows):
        least[root] = min(least[root], r[0])
    expected = sorted((r[0], f"{fp % (1 << 64):016x}", least[root]) for r, fp, root in zip(rows, fps, roots))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected


def test_op10(spark, folder):
    path, rows, _ = folder
    got = entry.queries()["op10_suffix_array_dedup"](spark, path).collect()
    expected = sorted((d, n, gone, runs, hashlib.sha256(left).hexdigest()) for d, n, gone, runs, left in kept_bytes([r[:2] for r in rows], suffix.LENGTH))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected
    assert sum(e[2] > 0 for e in expected) >= 8


def test_pipeline(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    left = [r for r in rows if not model.nearest(r[1])[2]]
    assert len(left) >= len(rows) - 6
    fps = [slow_simhash(r[1]) for r in left]
    roots = groups(fps, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    least = {}
    for root, r in zip(roots, left):
        least[root] = min(r[0], least.get(root, r[0]))
    left = sorted({(r[0], r[1]) for r, root in zip(left, roots) if r[0] == least[root]})
    left = [(d, kept.decode("utf-8", "ignore")) for d, kept in kept_first_bytes(left, corpus_pipeline.PASSAGE)]
    dirty = {e[0] for e in slow_contamination(left, items, 13) if e[2] and 20 * e[2] >= e[1]}
    assert dirty
    expected = sorted((d, len(encode(t))) for d, t in left if str(d) not in dirty)
    got = defaultdict(int)
    ends = {}
    for r in corpus_pipeline.run(spark, path).collect():
        got[r.doc_id] += r.length
        ends[r.doc_id] = r.doc_tokens
    assert sorted(got.items()) == expected and got == ends
