"""Substring deduplication by parsing against a reference index.

A word goes when a window of ``WINDOW`` consecutive words covers it whose words also start
earlier: in a document of smaller id, or earlier in the same one.

1. Every window has an anchor (see ``rolling``); a block is an anchor with all words of the
   windows it stands for.  Blocks whose anchor gram occurs once are copies of nothing.
2. The reference index holds every block once, at its first place.
3. A document is parsed into factors: its blocks that the index has at an earlier place.
   Neighbouring blocks on the same stretch of the reference join into one long factor.
4. Factor boundaries: where a copy begins or ends inside a block, the block as a whole is
   new.  Of anchor grams with several blocks the single windows are compared, again with
   the first place of each, and the windows found there lengthen the factors.

This is relative Lempel-Ziv parsing with blocks in the place of greedy longest matches: a
factor may be shorter than a greedy one, the words removed are the same.

Texts travel compressed, and only twice.  Counts and first places are combined before the
shuffle, so a passage that very many documents share is one row per task.

Defined results: words are the runs without the six ASCII white space characters; a null
text has none; texts of fewer words than a window keep all.  Null ids come first.  Rows
that repeat (doc_id, text) are one document and share its result; texts that share an id
are ordered by a hash of the text.  A very long text is hashed in slices, whole; an empty
table gives an empty result.  Other columns are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import attach, keyed, merged
from credsieve.llm.rolling import BLOCK, MULTIPLIER, anchors, gram_hashes, mix
from credsieve.storage import Steps

WINDOW = 20
GRAM = 5
# Blocks a task remembers having described, and texts it looks at together.
SENT = 500_000
TEXTS = 128


def words_of(text: str) -> list[bytes]:
    # bytes.split knows exactly the six white space bytes
    return text.encode("utf-8", "surrogatepass").split()


def word_values(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(values: np.ndarray, window: int) -> np.ndarray:
    """Hash of every window, computed a slice at a time."""
    parts = [
        gram_hashes(values[low : low + BLOCK + window - 1], window)
        for low in range(0, len(values) - window + 1, BLOCK)
    ]
    return np.concatenate(parts).view(np.int64)


def _packed(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """An anchor's place in one number: position, then the range of its windows."""
    return at << 16 | low << 8 | high


def _anchor_rows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, grams = [], [], []
            for i, text in enumerate(batch.column(2)):
                words = words_of(text.as_py())
                if len(words) >= window:
                    at, low, high, hashes = anchors(word_values(words), gram, window)
                    rows.append(np.full(len(at), i))
                    places.append(_packed(at, low, high))
                    grams.append(hashes)
            if rows:
                index = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(index),
                        batch.column(1).take(index),
                        pa.array(np.concatenate(places), pa.int64()),
                        pa.array(np.concatenate(grams), pa.int64()),
                    ],
                    names=["doc_id", "text_key", "place", "gram"],
                )

    return texts.mapInArrow(run, f"doc_id {kind}, text_key long, place long, gram long")


def compressed(texts: DataFrame) -> DataFrame:
    """doc_id, text_key, body: the text compressed for the shuffle."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            bodies = [shrink(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bodies, pa.binary())],
                names=["doc_id", "text_key", "body"],
            )

    return texts.mapInArrow(run, f"doc_id {kind}, text_key long, body binary")


def _block_hashes(marks: np.ndarray, first: np.ndarray, last: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hash of each block from its first and its last window.

    The windows of a block share the gram of its anchor, so these two cover all its words.
    """
    ranges = (places & 0xFFFF).astype(np.uint64) * np.uint64(MULTIPLIER)
    return mix(mix(marks[first]) + marks[last] * np.uint64(MULTIPLIER) + ranges).view(np.int64)


def _blocks(texts: DataFrame, lists: DataFrame, window: int) -> DataFrame:
    """Blocks at the anchors in ``lists``; a task sends the windows of each only once."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = attach(compressed(texts), lists).where("anchors IS NOT NULL")
    names = ["doc_id", "text_key", "place", "gram", "block", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        sent: set[int] = set()
        for batch in batches:
            for piece in (batch.slice(low, TEXTS) for low in range(0, batch.num_rows, TEXTS)):
                anchors_of = piece.column(3)
                edges = np.asarray(anchors_of.offsets) - anchors_of.offsets[0].as_py()
                flat = anchors_of.flatten()
                places, grams = (flat.field(c).to_numpy() for c in ("place", "gram"))
                first, last = (places >> 16) - (places & 255), (places >> 16) - (places >> 8 & 255)
                hashes, starts = [], [0]
                for body in piece.column(2):
                    hashes.append(window_hashes(word_values(grow(body.as_py()).split()), window))
                    starts.append(starts[-1] + len(hashes[-1]))
                marks = np.concatenate([*hashes, np.zeros(0, np.int64)])
                base = np.repeat(np.array(starts[:-1], np.int64), np.diff(edges))
                blocks = _block_hashes(marks.view(np.uint64), base + first, base + last, places)
                # the first of each block here, if the task has not described it before
                different, at = np.unique(blocks, return_index=True)
                fresh = np.array([b not in sent for b in different.tolist()], bool)
                if len(sent) >= SENT:
                    sent.clear()
                sent.update(different[fresh].tolist())
                new = np.zeros(len(blocks), bool)
                new[at[fresh]] = True
                sizes = np.where(new, last - first + 1, 0)
                ends = np.cumsum(sizes)
                index = np.repeat(base + first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
                windows = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(marks[index]), mask=pa.array(~new)
                )
                rows = pa.array(np.repeat(np.arange(piece.num_rows), np.diff(edges)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(rows), piece.column(1).take(rows), pa.array(places), pa.array(grams), pa.array(blocks), windows],
                    names=names,
                )

    return rows.select("doc_id", "text_key", "body", "anchors").mapInArrow(
        run, f"doc_id {kind}, text_key long, place long, gram long, block long, windows array<long>"
    )


def _at(place: Column) -> Column:
    return F.shiftright(place, 16)


def _low(place: Column) -> Column:
    return F.shiftright(place, 8).bitwiseAND(255)


def _high(place: Column) -> Column:
    return place.bitwiseAND(255)


def factors(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, steps: Steps | None = None
) -> DataFrame:
    """doc_id, text_key, factors, spans of documents that repeat earlier words.

    A factor (lo, hi, ref_id, ref_lo) says that words lo..hi-1 also start at ref_lo of the
    document ref_id; ``spans`` are the merged [lo, hi) of all factors.
    """
    steps = steps or Steps(docs.sparkSession)
    texts = keyed(docs)
    # a step each, so that no word is hashed a second time for its anchors and the space of
    # one is free before the texts move
    found = steps.write(_anchor_rows(texts, window, gram))
    twice = steps.write(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    of_text = found.join(twice, "gram").groupBy("doc_id", "text_key")
    lists = steps.write(of_text.agg(F.collect_set(F.struct("place", "gram")).alias("anchors")))
    steps.drop(found, twice)
    blocks = steps.write(_blocks(texts, lists, window))
    steps.drop(lists)

    # the reference index: every block at its first place
    first = F.struct("doc_id", "text_key", "place")
    name = ["gram", "block"]
    index = steps.write(blocks.groupBy(*name).agg(F.min(first).alias("first")))

    # blocks that the index has at an earlier place
    copies = blocks.drop("windows").join(index, name).where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
        | (F.col("place") != F.col("first.place"))
    )
    copies = copies.select(
        "doc_id", "text_key",
        (_at(F.col("place")) - _high(F.col("place"))).alias("lo"),
        (_at(F.col("place")) - _low(F.col("place")) + window).alias("hi"),
        F.col("first.doc_id").alias("ref_id"),
        (_at(F.col("first.place")) - _high(F.col("first.place"))).alias("ref_lo"),
    )

    copies = steps.write(copies)

    # boundaries: windows of blocks that share their anchor gram with other blocks
    # written, so that the join is between two shuffles and a gram of many blocks can be split
    several = steps.write(index.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    described = blocks.where("windows IS NOT NULL").select(*name, "windows").dropDuplicates(name)
    # the hashes run from the earliest window, which starts _high words before the anchor
    single = described.join(several, "gram").join(index, name).select(
        "gram", "first", F.posexplode("windows").alias("n", "mark")
    ).select(
        "gram", "mark",
        F.struct(
            F.col("first.doc_id").alias("doc_id"),
            F.col("first.text_key").alias("text_key"),
            (_at(F.col("first.place")) - _high(F.col("first.place")) + F.col("n")).alias("lo"),
        ).alias("place"),
    )
    earliest = single.groupBy("gram", "mark").agg(F.min("place").alias("ref"), F.count("*").alias("n"))
    # written, so that the join is between two shuffles and a hot window can be split
    earliest = steps.write(earliest.where("n > 1").drop("n"))
    later = single.join(earliest, ["gram", "mark"]).where("place > ref").select(
        "place.doc_id", "place.text_key", "place.lo", (F.col("place.lo") + window).alias("hi"),
        F.col("ref.doc_id").alias("ref_id"), F.col("ref.lo").alias("ref_lo"),
    )

    later = steps.write(later)
    steps.drop(blocks, index, earliest, several)

    # parts on the same stretch of the reference are one factor
    stretch = copies.unionByName(later).withColumn("shift", F.col("ref_lo") - F.col("lo"))
    parts = merged(stretch, ["doc_id", "text_key", "ref_id", "shift"])
    part = F.struct("lo", "hi", "ref_id", (F.col("lo") + F.col("shift")).alias("ref_lo"))
    of_document = ["doc_id", "text_key"]
    parsed = steps.write(parts.select(*of_document, "lo", "hi", part.alias("part")))
    steps.drop(copies, later)
    spans = merged(parsed.select(*of_document, "lo", "hi").distinct(), of_document)
    spans = spans.groupBy(*of_document).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    lists = parsed.groupBy(*of_document).agg(F.array_sort(F.collect_list("part")).alias("factors"))
    return attach(lists, spans)


def without_copies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, one space between) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = attach(compressed(keyed(docs)), found.select("doc_id", "text_key", "spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept, sizes, removed = [], [], []
            for body, cuts in zip(batch.column(1), batch.column(2)):
                words = grow(body.as_py()).split()
                at, left = 0, []
                for cut in cuts.as_py() or []:
                    left += words[at : cut["lo"]]
                    at = cut["hi"]
                left += words[at:]
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                sizes.append(len(words))
                removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept)],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return rows.select("doc_id", "body", "spans").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept string"
    )
