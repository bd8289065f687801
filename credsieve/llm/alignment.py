"""Alignment of two tokenizers, and how often their ids stand for the same bytes.

Both tokenizers encode a space and the text.  Where a token of either ends at the same byte
a group ends; an A token and a B token whose bytes overlap are linked, and the links of an
id pair are counted over all documents.  As the tokens cover the same bytes, every byte at
which a token of either ends closes exactly one link: that of the two tokens it lies in.

1. The ids of all documents are a written step, so no text is tokenised twice.
2. First pass: every task aligns its documents and sends its distinct pairs with their
   counts.
3. The distinct pairs are dealt by hash into shards of about ``SHARD``.  A shard gets a
   minimal perfect hash function: levels of bit arrays in which a key that is alone at its
   place stays, the others going on to the next level.  The keys themselves are kept at
   their numbers and compared at every lookup, so a pair that was not counted is never
   taken for another.
4. Counts are dense vectors indexed by that number.  A node of a tree sums the pairs of
   ``FAN`` tasks into one vector for each shard, further nodes sum ``FAN`` vectors each.
5. Second pass: the documents are aligned anew and their links looked up.  The functions
   and counts are broadcast as long as they take less than ``BROADCAST`` bytes; otherwise
   the shards are taken in slices of that size, one written pass for each.

Defined results: a null or empty text, and one that a tokenizer does not give back byte by
byte, has no tokens, zeros and empty groups; very long texts pass in one piece, with some
dozen bytes of memory for each of theirs; rows that repeat an id are documents of their
own, null ids stay null; an empty table gives no rows.  Other columns of the input are left
behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.packing import byte_letters
from credsieve.storage import Steps

# Ids of either vocabulary are below this; a pair is one number.
IDS = 1 << 16
SHARD = 1 << 16
FAN = 32
BROADCAST = 96 << 20
# Words a worker keeps twice at most, and the longest of them in characters.
WORDS_KEPT, WORD_LENGTH = 200_000, 64
# Words that are encoded in one call.
CALL = 1000
# Documents whose tokens are looked at together.
ROWS = 512
# Distinct pairs a task counts before it sends them.
PAIRS_HELD = 2_000_000
# Bits of a level for each of its keys.
GAMMA = 2
DECIMAL = np.array([str(i) for i in range(IDS)], object)
# A single space between two other characters.
CUT = re.compile(r"(?<=\S) (?=\S)")
# Fixed value: how the byte-level pre-tokenizer cuts text.
BYTE_LEVEL = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- tokens ----------------------------------------------------------------------------


def _encoder(path: str):
    """Ids of a text by a byte-level vocabulary, special tokens' strings being plain text.

    Where ids number the merges in their order the same ids come from ranks, several times
    as fast for words that were not seen before.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, merges = spec["model"].get("vocab", {}), spec["model"].get("merges", [])
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    level = spec.get("pre_tokenizer") or {}
    letters = {c: b for b, c in byte_letters().items()}
    plain = (
        spec["model"].get("type") == "BPE"
        and spec.get("normalizer") is None
        and level == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": level.get("trim_offsets"), "use_regex": True}
        and all(vocab.get(a + b) == len(letters) + k for k, (a, b) in enumerate(pairs))
        and all(vocab.get(c, IDS) < len(letters) for c in letters)
    )
    if plain:
        import tiktoken

        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocab.items() if i < len(letters) + len(pairs)}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary (.json) or of pieces (.model)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        letters = {c: b for b, c in byte_letters().items()}
        vocab = Tokenizer.from_file(path).get_vocab()
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if all(c in letters for c in token):
                out[i] = bytes(map(letters.__getitem__, token))
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        # a byte piece is written <0xHH>
        out = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    if len(out) > IDS:
        raise ValueError(f"{path} has more than {IDS} ids")
    return out


class Tokens:
    """Ids of texts in both vocabularies, as 16-bit numbers.

    Between two words that one space parts both tokenizers always cut, so a word with its
    space is encoded once by a worker and looked up afterwards.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.encode_a, self.bytes_a = _encoder(path_a), token_bytes(path_a)
        self.b, self.bytes_b = sentencepiece.SentencePieceProcessor(model_file=path_b), token_bytes(path_b)
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # merges of B never cross the front of a word if no piece has a space behind a letter
        self.by_word = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        self.words: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        # words that a tokenizer does not give back
        self.changed: set[str] = set()

    def _learn(self, parts: list[str]) -> None:
        """Ids of a space and each part, of many parts in one call where each is a word."""
        words, others = [], []
        for part in parts:
            # white space at an end would run together with the space behind or before it
            (others if not part or part[0].isspace() or part[-1].isspace() else words).append(part)
        for low in range(0, len(words), CALL):
            if not self._learn_words(words[low : low + CALL]):
                others += words[low : low + CALL]
        for part in others:
            if not self._learn_words([part]):
                self.changed.add(part)
                self.words[0][part] = self.words[1][part] = b""

    def _learn_words(self, parts: list[str]) -> bool:
        """False if a tokenizer changes their bytes."""
        text = " ".join(parts)
        a, b, raw = self.encode_a(" " + text), self.b.encode(text), b" " + text.encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw or b"".join(map(self.bytes_a.__getitem__, a)) != raw:
            return False
        ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts)))
        for ids, sizes, known in ((a, self.sizes_a, self.words[0]), (b, self.sizes_b, self.words[1])):
            numbers = np.array(ids, np.uint16)
            token_ends = np.cumsum(sizes[numbers])
            cuts = np.searchsorted(token_ends, ends)
            if len(parts) > 1 and not np.array_equal(token_ends[cuts], ends):
                return False
            data, edges = numbers.tobytes(), [0, *(2 * (cuts + 1)).tolist()]
            known.update((p, data[i:j]) for p, i, j in zip(parts, edges, edges[1:]))
        return True

    def of(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """The A ids and the B ids of each text, none for a text without tokens."""
        rows = [(CUT.split(t) if self.by_word else [t]) if t else [] for t in texts]
        (of_a, of_b), (old_a, old_b), new = self.words, self.older, []
        for part in set(chain.from_iterable(rows)).difference(of_a):
            if part in old_a:
                of_a[part], of_b[part] = old_a[part], old_b[part]
            else:
                new.append(part)
        self._learn(new)
        if self.changed:
            rows = [r if self.changed.isdisjoint(r) else [] for r in rows]
        out = [b"".join(map(of_a.__getitem__, r)) for r in rows], [b"".join(map(of_b.__getitem__, r)) for r in rows]
        # long stretches seldom come again; others stay if they came again lately
        for part in new:
            if len(part) > WORD_LENGTH:
                del of_a[part], of_b[part]
                self.changed.discard(part)
        if len(of_a) > WORDS_KEPT:
            self.words, self.older = ({}, {}), self.words
            self.changed.intersection_update(self.older[0])
        return out


@lru_cache(1)
def tokens(path_a: str, path_b: str) -> Tokens:
    """One for all tasks of a worker."""
    return Tokens(path_a, path_b)


def tokenised(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a, b: the ids of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens(path_a, path_b)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                a, b = tool.of(batch.column(1).slice(low, ROWS).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, ROWS), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["doc_id", "a", "b"]
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, a binary, b binary")


# -- alignment -------------------------------------------------------------------------


class Aligned:
    """Documents one behind the other: their links, and where groups and documents end."""

    def __init__(self, a: list[bytes], b: list[bytes], sizes_a: np.ndarray, sizes_b: np.ndarray) -> None:
        self.a, self.b = np.frombuffer(b"".join(a), np.uint16), np.frombuffer(b"".join(b), np.uint16)
        self.n_a = np.array([len(x) // 2 for x in a], np.int64)
        self.n_b = np.array([len(x) // 2 for x in b], np.int64)
        ends_a, ends_b = np.cumsum(sizes_a[self.a]), np.cumsum(sizes_b[self.b])
        marks = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] |= 2
        ends = np.flatnonzero(marks)
        self.closes = marks[ends]
        # tokens of either side that end before
        by_a, by_b = self.closes & 1, self.closes >> 1
        self.at_a, self.at_b = np.cumsum(by_a) - by_a, np.cumsum(by_b) - by_b
        self.links = self.a[self.at_a].astype(np.int64) * IDS + self.b[self.at_b]
        # links up to the end of each document
        last = np.concatenate([[0], ends_a])[np.cumsum(self.n_a)]
        self.until = np.concatenate([[0], np.searchsorted(ends, last, "right")])

    def per_document(self, values: np.ndarray) -> np.ndarray:
        """Sums over the links of each document."""
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[self.until])

    def groups(self) -> list[str]:
        """The groups of each document as text."""
        ends = np.flatnonzero(self.closes == 3)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        out = np.empty(len(ends), object)
        single = starts == ends
        pairs, inverse = np.unique(self.links[ends[single]], return_inverse=True)
        names = np.empty(len(pairs), object)
        names[:] = [f"{p // IDS}|{p % IDS}" for p in pairs.tolist()]
        out[single] = names[inverse]
        wide = np.flatnonzero(~single)
        cuts = [x[y[wide]].tolist() for x in (self.at_a, self.at_b) for y in (starts, ends)]
        texts_a, texts_b = DECIMAL[self.a].tolist(), DECIMAL[self.b].tolist()
        texts = [
            ",".join(texts_a[i : j + 1]) + "|" + ",".join(texts_b[k : m + 1]) for i, j, k, m in zip(*cuts, strict=True)
        ]
        out[wide] = np.array([*texts, None], object)[:-1]
        edges = np.searchsorted(ends, self.until).tolist()
        return [";".join(out[i:j].tolist()) for i, j in zip(edges, edges[1:])]


def _sizes(path: str) -> np.ndarray:
    return np.array([len(t) for t in token_bytes(path)], np.int64)


# -- minimal perfect hashing -----------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each key."""
    z = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys, 0) % np.uint64(shards)).astype(np.int32)


class PerfectHash:
    """Numbers distinct keys from 0 without gaps; -1 for any other key.

    ``levels`` are bit arrays; ``keys`` holds the key of each number.
    """

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray) -> None:
        self.levels, self.keys = levels, keys
        self.before, total = [], 0
        for bits in levels:
            self.before.append((total + np.cumsum(bits, dtype=np.int32) - bits).astype(np.int32))
            total += int(bits.sum())

    def __reduce__(self):
        return PerfectHash.unpacked, self.packed()

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = max(64, GAMMA * len(rest))
            places = (mixed(rest, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[places]]
        made = cls(levels, np.zeros(0, np.int64))
        ordered = np.empty(len(keys), np.int64)
        ordered[made._numbers(keys)] = keys
        made.keys = ordered
        return made

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            places = (mixed(keys[left], level + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[places]
            out[left[hit]] = self.before[level][places[hit]]
            left = left[~hit]
        return out

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        found = self._numbers(keys)
        if len(self.keys):
            found[self.keys[np.maximum(found, 0)] != keys] = -1
        return found

    def packed(self) -> tuple[list[int], list[bytes], bytes]:
        return [len(x) for x in self.levels], [np.packbits(x).tobytes() for x in self.levels], self.keys.astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, sizes: list[int], bits: list[bytes], keys: bytes) -> PerfectHash:
        levels = [
            np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for n, x in zip(sizes, bits, strict=True)
        ]
        return cls(levels, np.frombuffer(keys, "<i8"))


# -- first pass: pairs and their counts ------------------------------------------------


def task_pairs(ids: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """part, pair, n: the distinct pairs of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pairs = TaskContext.get().partitionId(), Counter()
        sizes = _sizes(path_a), _sizes(path_b)

        def sent() -> Iterator[pa.RecordBatch]:
            keys, counts = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
            pairs.clear()
            for low in range(0, len(keys), 1 << 16):
                k = keys[low : low + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), part, np.int32)), pa.array(k), pa.array(counts[low : low + len(k)])], names=["part", "pair", "n"]
                )

        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                a, b = (batch.column(c).slice(low, ROWS).to_pylist() for c in ("a", "b"))
                keys, counts = np.unique(Aligned(a, b, *sizes).links, return_counts=True)
                for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
                    pairs[k] += n
                if len(pairs) > PAIRS_HELD:
                    yield from sent()
        if pairs:
            yield from sent()

    return ids.select("a", "b").mapInArrow(run, "part int, pair long, n long")


def perfect_hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """shard, sizes, bits, keys: a perfect hash function of the distinct pairs of each shard."""
    schema = "shard int, sizes array<long>, bits array<binary>, keys binary"

    def build(table: pa.Table) -> pa.Table:
        sizes, bits, keys = PerfectHash.of(table.column("pair").to_numpy()).packed()
        return pa.table(
            {
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "bits": pa.array([bits], pa.list_(pa.binary())),
                "keys": pa.array([keys], pa.binary()),
            }
        )

    return _sharded(pairs.select("pair").distinct(), shards).groupBy("shard").applyInArrow(build, schema)


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shard_of(batch.column("pair").to_numpy(zero_copy_only=False), shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "shard"])

    return rows.mapInArrow(run, ", ".join([*fields, "shard int"]))


def dense_counts(pairs: DataFrame, hashes: DataFrame, shards: int) -> DataFrame:
    """shard, vector: the counts of a shard's pairs, at their numbers.

    A group of the first level holds the pairs of at most FAN tasks in one shard, one of a
    further level at most FAN vectors.
    """
    parts = (pairs.agg(F.max("part")).head()[0] or 0) + 1
    nodes = -(-parts // FAN)
    leaves = _sharded(pairs, shards).withColumn("node", F.floor(F.col("part") / FAN).cast("int"))
    functions = hashes.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))
    schema = "shard int, node int, vector binary"

    def one(shard: int, node: int, vector: np.ndarray) -> pa.Table:
        return pa.table(
            {"shard": pa.array([shard], pa.int32()), "node": pa.array([node], pa.int32()), "vector": pa.array([vector.astype("<i8").tobytes()], pa.binary())}
        )

    def count(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        function = _function(right.slice(0, 1).to_pylist()[0])
        vector = np.zeros(len(function.keys), np.int64)
        numbers = function.look_up(left.column("pair").to_numpy())
        np.add.at(vector, numbers, left.column("n").to_numpy())
        return one(key[0].as_py(), key[1].as_py(), vector)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        vectors = [np.frombuffer(v.as_py(), "<i8") for v in table.column("vector")]
        return one(key[0].as_py(), key[1].as_py(), np.sum(vectors, axis=0))

    tree = leaves.groupBy("shard", "node").cogroup(functions.groupBy("shard", "node")).applyInArrow(count_present(count, schema), schema)
    while nodes > 1:
        nodes = -(-nodes // FAN)
        tree = tree.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("shard", "node").applyInArrow(add, schema)
    return tree.select("shard", "vector")


def count_present(count, schema: str):
    """``count`` for groups that have pairs; none of a node's tasks may have met a shard."""
    empty = pa.table({"shard": pa.array([], pa.int32()), "node": pa.array([], pa.int32()), "vector": pa.array([], pa.binary())})

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return count(key, left, right) if left.num_rows else empty

    return run


def _function(row: dict) -> PerfectHash:
    return PerfectHash.unpacked(row["sizes"], row["bits"], row["keys"])


# -- second pass: lookups --------------------------------------------------------------


def best_of_b(table: DataFrame) -> np.ndarray:
    """The highest count of each B id; as many numbers as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(IDS, np.int64)
        for batch in batches:
            for keys, vector in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(keys.as_py(), "<i8") % IDS
                np.maximum.at(best, ids, np.frombuffer(vector.as_py(), "<i8"))
        at = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[at])], names=["b", "n"])

    out = np.zeros(IDS, np.int64)
    for r in table.select("keys", "vector").mapInArrow(run, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).collect():
        out[r.b] = r.n
    return out


class Counts:
    """Counts of the pairs of some shards."""

    def __init__(self, rows: list[dict], shards: int, best: np.ndarray) -> None:
        self.shards, self.best = shards, best
        self.functions = {r["shard"]: _function(r) for r in rows}
        self.vectors = {r["shard"]: np.frombuffer(r["vector"], "<i8") for r in rows}

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 if these shards do not have it."""
        out = np.zeros(len(pairs), np.int64)
        shards = shard_of(pairs, self.shards)
        for shard in np.unique(shards):
            if int(shard) in self.functions:
                at = np.flatnonzero(shards == shard)
                numbers = self.functions[int(shard)].look_up(pairs[at])
                out[at[numbers >= 0]] = self.vectors[int(shard)][numbers[numbers >= 0]]
        return out

    def of_repeated(self, pairs: np.ndarray) -> np.ndarray:
        different, inverse = np.unique(pairs, return_inverse=True)
        return self.of(different)[inverse]


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _scored(ids: DataFrame, counts, path_a: str, path_b: str, first: bool, last: bool) -> DataFrame:
    """The figures of the documents; n_best and count_sum for the pairs of ``counts`` are
    added to those of earlier slices, the ids go on to the next one."""
    kind = ids.schema["doc_id"].dataType.simpleString()
    own = FIGURES if last else FIGURES[4:]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in own) + (", groups_sha256 string" if last else ", a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes = counts.value, (_sizes(path_a), _sizes(path_b))
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                piece = {n: c.slice(low, ROWS) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                both = Aligned(piece["a"].to_pylist(), piece["b"].to_pylist(), *sizes)
                found = table.of_repeated(both.links)
                out = {"doc_id": piece["doc_id"]}
                out["n_best"] = both.per_document((found > 0) & (found == table.best[both.links % IDS]))
                out["count_sum"] = both.per_document(found)
                if not first:
                    out |= {c: out[c] + piece[c].to_numpy() for c in FIGURES[4:]}
                if last:
                    out |= {"n_a": both.n_a, "n_b": both.n_b, "n_groups": both.per_document(both.closes == 3)}
                    out["n_links"] = both.per_document(np.ones(len(both.links), np.int64))
                    out["groups_sha256"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in both.groups()]
                else:
                    out |= {"a": piece["a"], "b": piece["b"]}
                names = ["doc_id", *own, "groups_sha256"] if last else ["doc_id", *own, "a", "b"]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in map(out.get, names)], names=names)

    return ids.mapInArrow(run, schema)


def align(
    docs: DataFrame,
    tokenizers: tuple[str, str] | None = None,
    broadcast_bytes: int = BROADCAST,
    shard_keys: int = SHARD,
    steps: Steps | None = None,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    path_a, path_b = tokenizers or default_tokenizers()
    steps = steps or Steps(spark)
    rows = steps.write(tokenised(docs, path_a, path_b))
    pairs = steps.write(task_pairs(rows, path_a, path_b))
    distinct = pairs.select("pair").distinct().count()
    shards = max(1, -(-distinct // shard_keys))
    hashes = steps.write(perfect_hashes(pairs, shards))
    counted = steps.write(hashes.join(dense_counts(pairs, hashes, shards), "shard"))
    steps.drop(pairs, hashes)
    best = best_of_b(counted)
    sizes = counted.select(
        "shard", (F.octet_length("keys") * 3 + F.octet_length("vector") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + 5 * x)).alias("size")
    )
    # a slice of shards takes less than broadcast_bytes, a single shard always fits
    slices, room = [[]], broadcast_bytes
    for r in sizes.orderBy("shard").toLocalIterator():
        if slices[-1] and r.size > room:
            slices.append([])
            room = broadcast_bytes
        slices[-1].append(r.shard)
        room -= r.size
    for i, of in enumerate(slices):
        found = counted.where(F.col("shard").between(of[0], of[-1])).collect() if of else []
        counts = spark.sparkContext.broadcast(Counts([r.asDict() for r in found], shards, best))
        scored = _scored(rows, counts, path_a, path_b, i == 0, i + 1 == len(slices))
        if i + 1 == len(slices):
            return scored
        before, rows = rows, steps.write(scored)
        steps.drop(before)
