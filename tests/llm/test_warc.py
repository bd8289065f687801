"""WARC round trip against a plain reading of the pages."""

import glob
import gzip
import hashlib
import random

import pytest

import __spark_entry__ as entry
from credsieve.llm import warc
from llm.cases import CLASHING
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def pages():
    rng = random.Random(4)
    big = "<p>" + "wörd " * 400 + "</p>"
    rows = [
        (1, "http://www.a.example/x?q=1#top", "<p>small</p>"),
        (2, "http://a.example/x?q=1", "<p>small</p>"),
        (3, None, None),
        (4, "", ""),
        (5, "https://b.example:443/\r\nWARC/1.1\r\n bad", big),
        (6, "https://b.example/é", big),
        (6, "https://b.example/é", big),
        (7, "ftp://user:pw@c.example", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 20),
        (8, "no scheme", "y" * 999),
        (9, "no scheme", "y" * 999),
        (10, "z", "y" * 1000),
        (11, "z", "y" * 1000),
        (None, "z", "y" * 1000),
        (None, "q", "v" * 2000),
        (None, "q", "v" * 2000),
        (12, "http://long.example", "é" * 700_000),
    ]
    rows += [(100 + i, "http://hot.example/", f"<p>{rng.random()}</p>") for i in range(60)]
    rows += [(200 + i, f"http://h{rng.randrange(9)}.example/{rng.randrange(5)}", "t" * 1500) for i in range(40)]
    return rows


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    largest = {}
    for i, b in data:
        if len(b) >= 1000 and i is not None:
            largest[b] = max(i, largest.get(b, i))
    out = []
    for i, b in data:
        best = largest.get(b)
        kind = "response" if best is None or best == i else "revisit"
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), kind, best if kind == "revisit" else None))
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(v).alias(c) for c, v in CLASHING.items()], F.lit(1).alias("digest"), F.lit(2).alias("captured"))
    df.repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["op11_warc"](spark, str(tmp_path)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    order = sorted(got, key=lambda r: r.position)
    keys = [(r.url_key, r.captured_at) for r in order]
    assert keys == sorted(keys)
    seen = {}
    for r in order:
        assert r.capture_no == seen.get(r.url_key, 0)
        seen[r.url_key] = r.capture_no + 1
    assert seen["example,hot)/"] == 60 and seen["example,a)/x?q=1"] == 2


def test_archives_are_plain_warc(spark, tmp_path):
    rows = pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/out")
    found, kinds = [], {"response": 0, "revisit": 0}
    for name in glob.glob(f"{tmp_path}/out/part-*"):
        with gzip.open(name) as file:
            data = file.read()
        at = 0
        for offset, fields, block in warc.read_records(open(name, "rb").read()):
            assert offset == at and data[at:].startswith(b"WARC/1.1\r\nWARC-Type: ")
            head = data.index(b"\r\n\r\n", at) + 4
            assert data[head : head + len(block)] == block
            at = head + len(block) + 4
            assert data[at - 4 : at] == b"\r\n\r\n"
            kinds[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "response":
                found.append(block.split(b"\r\n\r\n", 1)[1])
            else:
                assert block.endswith(b"\r\n\r\n") and fields["WARC-Refers-To"]
        assert at == len(data)
    assert kinds["revisit"] == sum(e[3] == "revisit" for e in expected(rows)) and sum(kinds.values()) == len(rows)
    assert {hashlib.sha1(p).hexdigest() for p in found} == {e[2] for e in expected(rows)}


@pytest.mark.parametrize("count", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(count):
    rng = random.Random(count)
    lists = [sorted(f"{rng.randrange(50):03d}-{i}-{j}" for j in range(rng.randrange(0, 30))) for i in range(count)]
    merged = [lists[i][at] for i, at in warc.LoserTree(lists)]
    assert merged == sorted(x for xs in lists for x in xs)


def test_members_and_small_steps(monkeypatch):
    monkeypatch.setattr(warc.Bytes, "STEP", 7)
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for content in (record * 3, b"".join(gzip.compress(record) for _ in range(3)), gzip.compress(record * 3)):
        assert [(o, b) for o, _, b in warc.read_records(content)] == [(k * len(record), b"ab\r\nc") for k in range(3)]
    with pytest.raises(ValueError):
        list(warc.read_records(record[:-8]))


def test_empty_table_and_many_ranges(spark, tmp_path, monkeypatch):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
    monkeypatch.setattr(warc, "RANGE", 7)
    rows = [(i, "http://one.example/", f"{i}") for i in range(100)]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(6), captured=F.lit(5)).collect()
    # equal URL and time: the pages by their numbers
    assert [r.page_id for r in sorted(got, key=lambda r: r.position)] == list(range(100))
    assert [r.capture_no for r in sorted(got, key=lambda r: r.position)] == list(range(100))


def test_url_key():
    assert warc.url_key("http://www.A.Example:80/P?x=1#f") == "example,a)/P?x=1"
    assert warc.url_key("https://u:p@b.example?x") == "example,b)?x"
    assert warc.url_key("") == ""
