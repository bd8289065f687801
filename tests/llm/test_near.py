import random

import numpy as np
from llm.cases import SCHEMA, awkward_documents, groups, with_clashing
from pyspark.sql import functions as F

from credsieve.llm import collisions, simhash
from credsieve.llm.components import components
from credsieve.storage import Steps


def slow_simhash(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (value >> 63 << 64)


def test_fingerprints_against_brute_force(spark):
    rows = [r for r in awkward_documents() if len(r[1] or "") < 10_000]
    got = simhash.fingerprints(with_clashing(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fp) for r in got) == sorted((str(r[0]), slow_simhash(r[1])) for r in rows)


def test_native_hash_is_the_same(spark):
    import xxhash

    got = spark.range(1).select(F.xxhash64(F.lit("a b é")).alias("h")).first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest("a b é".encode(), 42)


def test_pigeonring_finds_every_pair(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(6):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = sorted(f - (f >> 63 << 64) for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {tuple(r) for r in simhash.pigeonring_pairs(df).collect()}
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert got == expected and len(expected) > 50


def test_near_copies_share_a_component(spark):
    rows = awkward_documents()
    rows += [(200, rows[14][1] + " tail", "en", "z", 1)]
    docs = with_clashing(spark, rows)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    fps = [r.fp for r in found]
    roots = groups(fps, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    ids = {}
    for root, r in zip(roots, found):
        if r.doc_id is not None:
            ids[root] = min(r.doc_id, ids.get(root, r.doc_id))
    assert [r.component_id for r in found] == [ids.get(root) for root in roots]
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert left.count(8) == 1 and 9 not in left and 12 in left and 200 not in left


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(1000, 1200)] + [(7, 7), (3, 900), (900, 3)]
    found = components(spark.createDataFrame(edges, "u long, v long"), Steps(spark)).collect()
    got = {r.node: r.component for r in found}
    assert len(found) == len(got)
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in range(1000, 1200)} == {5} and got[900] == 3 and 7 not in got
    assert components(spark.createDataFrame([], "u long, v long"), Steps(spark)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(seed=4, n=900):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 64))
    base[300:600] = base[0] + rng.normal(size=(300, 64)) * 0.12 * np.linalg.norm(base[0]) / 8
    base[600:620] = base[1]
    base[620:640] = base[1] * 3
    rows = [(i, [float(x) for x in v], i % 2 if i < 300 else 0) for i, v in enumerate(base)]
    rows += [
        (2000, None, 0), (2001, [0.0] * 64, 0), (2002, [float("nan")] * 64, 0), (2003, [1.0, None] * 32, 0),
        (2004, rows[0][1], None), (2005, rows[0][1], 1), (2006, [1.0, 2.0], 0), (2007, [], 0), (None, rows[3][1], 1),
        (2008, [float("inf")] * 64, 0), rows[5], rows[5],
    ]
    return rows


def test_vectors_against_brute_force(spark, monkeypatch):
    """With cells so small that they are cut into parts."""
    monkeypatch.setattr(collisions, "CELL", 32)
    monkeypatch.setattr(collisions, "HOME", 40)
    monkeypatch.setattr(collisions, "VISITORS", 64)
    rows = vector_rows()
    df = with_clashing(spark, rows, VECTORS).repartition(4)
    got = collisions.near_duplicates(df).collect()

    def sound(r):
        return r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    units = {i: np.float32(r[1]).astype(float) / np.linalg.norm(np.float32(r[1]).astype(float)) for i, r in enumerate(rows) if sound(r)}
    links = [[] for _ in rows]
    for i in units:
        for j in units:
            if i != j and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                links[i].append(j)
    linked = [set(x) for x in links]
    roots = groups(range(len(rows)), lambda a, b: b in linked[a])
    least = {}
    for i, root in enumerate(roots):
        if rows[i][0] is not None:
            least[root] = min(rows[i][0], least.get(root, rows[i][0]))
    expected = sorted(
        (str(r[0]), len(links[i]), least.get(roots[i]), r[0] == least.get(roots[i])) for i, r in enumerate(rows)
    )
    result = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got)
    missed = sum(len(x) for x in links) - sum(r.n_links for r in got)
    assert missed == 0
    assert result == expected


def test_tables_without_links(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert collisions.near_duplicates(empty).count() == 0
    alone = spark.createDataFrame([(1, None, 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)], VECTORS)
    assert all(r.n_links == 0 and r.kept for r in collisions.near_duplicates(alone).collect())
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one_of_each(docs).count() == 0


def test_cells_and_count_lose_no_pair_at_the_threshold():
    """A million pairs at the threshold in 64 dimensions, with and without a common mean direction."""
    rng = np.random.default_rng(12)
    n, lines, r = 50_000, collisions.lines(64), collisions.radius(collisions.COSINE)
    mean = collisions.unit(rng.normal(size=(1, 64)))
    for share, bits in ((0.0, 8), (0.8, 8), (0.8, 14)):
        def drawn():
            return collisions.unit(share * mean + np.sqrt(1 - share**2) * collisions.unit(rng.normal(size=(n, 64))))

        split, reach = collisions.cuts(drawn()[: collisions.SAMPLE], bits, collisions.COSINE)
        lost = 0
        for _ in range(20 if bits == 14 else 7):
            x = drawn()
            other = rng.normal(size=x.shape)
            other = collisions.unit(other - (other * x).sum(1, keepdims=True) * x)
            y = collisions.COSINE * x + np.sqrt(1 - collisions.COSINE**2) * other
            p, q = x @ lines - split, y @ lines - split
            met = np.zeros(n, bool)
            for t in range(collisions.TABLES):
                cut = slice(t * (64 // collisions.TABLES), t * (64 // collisions.TABLES) + bits)
                met |= (((p[:, cut] >= 0) == (q[:, cut] >= 0)) | (np.abs(q[:, cut]) <= reach)).all(1)
            lost += int((~met | ((np.abs(p - q) <= collisions.WINDOW * r).sum(1) < collisions.needed_collisions())).sum())
        assert lost <= 1, (share, bits, lost)
