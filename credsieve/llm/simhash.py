"""Near-duplicates by SimHash with pigeonring filtering.

Fingerprints: 64 bits over all shingles of three words, repeats included.

Candidates: a fingerprint is a ring of ``SEGMENTS`` segments of equal width.  If two differ
in at most ``BUDGET`` bits, some segment starts a chain in which, for every length l, the
first l segments differ in at most floor(l * BUDGET / SEGMENTS) bits.  As long as that
bound is 0 the segments are equal, so they are an equi-join key; the rest of the chain is
tested inside the join, before the full distance.  Of a run of valid starts only the first
one, whose preceding segment differs, gives the pair.

Only distinct fingerprints are joined, so exact copies never meet as pairs.  A fingerprint
has at most 2080 others within two bits, so links stay linear in the fingerprints.

Defined results: texts of fewer than three words have one shingle, wordless and null texts
fingerprint 0, linked like any other; null ids never become a component's id unless all
are null; rows that repeat an id are rows of their own; a very long text is hashed in slices,
whole; an empty table gives an empty result.  Other columns are left behind by
``near_duplicates`` and kept by ``keep_one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from credsieve.llm.common import fresh
from credsieve.llm.components import components
from credsieve.storage import Steps

SEED = 42
BUDGET = 2
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
# Segments that must be equal: the longest chain whose budget is still 0.
EQUAL = max(n for n in range(1, SEGMENTS + 1) if n * BUDGET // SEGMENTS == 0)
# Hashes are counted in blocks of this many, so that a count fits into eight bits.
LANE = 255
# Shingles held as numbers at a time.
BATCH = 1 << 19


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits."""
    counts = np.zeros(64, np.int64)
    lanes = np.uint64(0x0101010101010101)
    starts = np.arange(0, len(hashes), LANE)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, starts)
        counts[bit::8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return counts


def simhash(text: str | None) -> int:
    """Signed 64-bit fingerprint."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    # bytes.lower and bytes.split know A-Z and the six white space bytes only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        hashes = np.array([digest(b" ".join(words), SEED)], np.uint64)
        n, counts = 1, _bit_counts(hashes)
    else:
        n, counts = len(words) - 2, np.zeros(64, np.int64)
        for low in range(0, n, BATCH):
            part = words[low : low + BATCH + 2]
            spaced = [w + b" " for w in part]
            shingles = [a + b + c for a, b, c in zip(spaced, spaced[1:], part[2:])]
            hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
            counts += _bit_counts(hashes)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _rotated(fp: Column, bits: int) -> Column:
    if bits == 0:
        return fp
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits))


def pigeonring_pairs(fps: DataFrame) -> DataFrame:
    """(u, v), u < v: all pairs of the distinct values of ``fp`` within BUDGET bits."""
    starts = F.array(
        *[F.struct(F.lit(i).alias("i"), _rotated(F.col("fp"), i * WIDTH).alias("ring")) for i in range(SEGMENTS)]
    )
    rings = fps.select("fp", F.inline(starts)).withColumn("key", F.shiftrightunsigned("ring", 64 - EQUAL * WIDTH))
    a, b = rings.alias("a"), rings.alias("b")
    apart = F.col("a.ring").bitwiseXOR(F.col("b.ring"))
    chain = F.lit(True)
    for n in range(EQUAL + 1, SEGMENTS):
        budget = n * BUDGET // SEGMENTS
        if (n + 1) * BUDGET // SEGMENTS > budget or n == SEGMENTS - 1:  # implies shorter chains of equal budget
            chain &= F.bit_count(F.shiftrightunsigned(apart, 64 - n * WIDTH)) <= budget
    first = apart.bitwiseAND((1 << WIDTH) - 1) != 0
    found = a.join(
        b,
        (F.col("a.i") == F.col("b.i"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & first
        & chain
        & (F.bit_count(apart) <= BUDGET),
    )
    return found.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_duplicates(docs: DataFrame, steps: Steps | None = None) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    steps = steps or Steps(docs.sparkSession)
    prints = steps.write(fingerprints(docs))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(pigeonring_pairs(groups.select("fp")), steps)
    joined = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = joined.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp.cast(LongType())), 16, "0"))


def keep_one_of_each(docs: DataFrame, steps: Steps | None = None) -> DataFrame:
    """The rows whose id is the smallest of their group.

    A row without an id stays only if its whole group has none.  Of rows that repeat both
    id and text one stays; rows that repeat an id with another text are told apart by it.
    """
    found = near_duplicates(docs, steps).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    own = fresh(docs, "_kept")
    kept = found.groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("n"))
    repeats = kept.where("n > 1").limit(1).count()
    rows = docs.join(kept.select(own), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"]) if repeats else rows
