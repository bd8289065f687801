"""Packing by concatenate and cut.

Pass one tokenises every text and numbers the ids of each partition from 0; the prefix
sums of the partition totals turn these into positions in the concatenation of all
documents.  Pass two cuts the concatenation into fixed windows: a document becomes one
piece per window it touches, so a document on a boundary has a record on either side.
Only the last sequence is not full.

Pass one is a written table, so both passes see the same order even when a lost executor
makes Spark run tasks again.

Defined results: a null or empty text is the end id alone; rows that repeat an id are
documents of their own, null ids stay null; a very long text is one row of ids, cut into as
many pieces as it takes; an empty table gives no pieces.  Other columns are left behind,
whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.storage import Steps

SEQUENCE = 4096
END_ID = 2
# Distinct words a worker keeps the ids of, beside those of one text.
WORDS_KEPT = 400_000
# Two separators that end a token under any pre-tokeniser that drops white space.
CHUNKS = re.compile(r"[^ \n]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Fixed value: how the default vocabulary cuts normalised text, white space being dropped.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same cut for lower-case text up to U+024F, where Python's classes differ from these
# only in six numerals; such text is also its own NFC.
LATIN_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
NOT_LATIN = re.compile(r"[\x00-\x08\x0e-\x1f\x7f\u0250-\U0010ffff]|<[|]")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit integers, word by word from a cache.

    Only for tokenisers that drop white space before they cut words; for them a text and
    its words give the same ids.  Latin text of the default vocabulary is cut into the
    vocabulary's own words, any other text at blanks and line ends.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            self.latin = json.dumps(CUT) in file.read()
        self.letters = byte_letters()
        self.cut: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _of_cut(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped))

    def _of_chunk(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def of(self, text: str) -> bytes:
        if self.latin and not NOT_LATIN.search(text):
            words, known, look_up = LATIN_CUT.findall(text.lower()), self.cut, self._of_cut
        else:
            words, known, look_up = CHUNKS.findall(text), self.chunks, self._of_chunk
        if len(known) > WORDS_KEPT:
            known.clear()
        for word in set(words).difference(known):
            known[word] = look_up(word)
        return b"".join(map(known.__getitem__, words))


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One cache for all tasks of a worker."""
    return WordIds(path)


def tokenised(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, at, n, ids: ``at`` counts the ids before the document in its partition."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, at long, n long, ids binary"
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer or default_tokenizer())
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            # a slice at a time, so that a batch of long texts does not double in memory
            for low in range(0, batch.num_rows, 512):
                ids, starts, sizes = [], [], []
                for text in texts.slice(low, 512):
                    ids.append(ids_of.of(text.as_py() or "") + end)
                    starts.append(at)
                    sizes.append(len(ids[-1]) // 4)
                    at += sizes[-1]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, 512),
                        pa.array([part] * n, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "part", "at", "n", "ids"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    sequence: int = SEQUENCE,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    steps: Steps | None = None,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers.
    """
    steps = steps or Steps(docs.sparkSession)
    rows = steps.write(tokenised(docs, tokenizer, end_id))
    # one row per partition of pass one, whatever the number of documents
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("at"))
    last = F.col("at") + F.col("n")
    cuts = F.sequence(F.floor(F.col("at") / sequence), F.floor((last - 1) / sequence))

    def piece(number):
        low = F.greatest(number * sequence, F.col("at"))
        high = F.least((number + 1) * sequence, last)
        start = low - F.col("at")
        return F.struct(
            start.alias("start"),
            (high - low).alias("length"),
            F.substring("ids", (4 * start + 1).cast("int"), (4 * (high - low)).cast("int")).alias("ids"),
            F.col("n").alias("doc_tokens"),
            number.alias("sequence_id"),
            (low - number * sequence).alias("offset"),
        )

    return placed.select("doc_id", F.inline(F.transform(cuts, piece)))
