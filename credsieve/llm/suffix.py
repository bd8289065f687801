"""Substring deduplication by sorting suffixes.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts anywhere else.

1. Every window of LENGTH bytes has an anchor (see ``rolling``); windows can only be equal
   where their anchors' grams are.  Grams that occur once are left out by a count.
2. What is left is cut into fragments: an anchor with all bytes of the windows it stands
   for.  A task sends the bytes of a fragment once, and a row without bytes for each
   occurrence.  Equal fragments are equal windows, so a fragment that occurs twice needs
   no further look.
3. The different fragments of a gram are sorted as suffixes from the anchor on, and as
   reversed prefixes before it, by deep-shallow sorting: multikey quicksort to a shallow
   depth, then blind tries for the groups whose common prefix is longer.  The sorted order
   with its common-prefix lengths tells which windows of two fragments are equal.
4. Windows become byte spans of documents.

With ``keep_first`` the string's earliest start, by (doc_id, text, place), covers nothing,
so one copy of a passage stays.

A gram with more than ``GROUP`` different fragments is not gathered in one task: the hashes
of its windows are counted instead, which is the same comparison by another key.

Defined results: a null text is empty and keeps nothing; a text shorter than LENGTH keeps
all; rows that repeat (doc_id, text) are separate occurrences, each with the same result
(with ``keep_first`` that of the first of them); null ids come first; a very long text is
read in slices and sent in one piece; an empty table gives no spans and an empty result.
Columns of any other name are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import attach, fresh, keyed, merged, text_key
from credsieve.llm.rolling import byte_anchors
from credsieve.storage import Steps

LENGTH = 400
GRAM = 100
# Bytes compared by quicksort beyond the known common prefix before blind tries take over.
SHALLOW = 24
CHARACTER = 8
GROUP = 2000
# Fragments a task remembers having sent.
SENT = 200_000


# ---- deep-shallow sorting ----------------------------------------------------------


def common_prefix(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix, known to be at least ``low``."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """A trie that keeps branching depths and one byte per branch, not the strings' text.

    An insertion goes down without looking at the skipped bytes, compares the string once
    with the leaf it ends at, and hangs a branch where the two differ.
    """

    def __init__(self, strings: list[bytes], first: int, depth: int) -> None:
        self.strings, self.depth = strings, depth
        self.root: list | int = first  # a node is [depth, {byte or -1: child}], a leaf its number
        self.equal: dict[int, list[int]] = {first: [first]}

    def add(self, number: int) -> None:
        text, node = self.strings[number], self.root
        while isinstance(node, list):
            byte = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(byte, next(iter(node[1].values())))
        other = self.strings[node]
        shared = common_prefix(text, other, min(self.depth, len(text), len(other)))
        if shared == len(text) == len(other):
            self.equal[node].append(number)
            return
        self.equal[number] = [number]
        mine = text[shared] if shared < len(text) else -1
        theirs = other[shared] if shared < len(other) else -1
        above, key, node = None, None, self.root
        while isinstance(node, list) and node[0] < shared:
            above, key = node, text[node[0]]
            node = node[1][key]
        if isinstance(node, list) and node[0] == shared:
            node[1][mine] = number
            return
        branch = [shared, {theirs: node, mine: number}]
        if above is None:
            self.root = branch
        else:
            above[1][key] = branch

    def walk(self, order: list[int], lcp: list[int]) -> None:
        """Append the numbers in order, each with its common prefix with the one before."""
        stack, pending = [(self.root, None)], 0
        while stack:
            node, above = stack.pop()
            if above is not None:
                pending = above
            if isinstance(node, list):
                keys = sorted(node[1], reverse=True)
                for key in keys[:-1]:
                    stack.append((node[1][key], node[0]))
                stack.append((node[1][keys[-1]], above))
                continue
            for n, number in enumerate(self.equal[node]):
                order.append(number)
                lcp.append(len(self.strings[node]) if n else pending)


def deep_shallow(strings: list[bytes], known: int = 0) -> tuple[list[int], list[int]]:
    """Order of ``strings`` and the common prefix of each with its predecessor (first: 0).

    All strings share their first ``known`` bytes.
    """
    order: list[int] = []
    lcp: list[int] = []
    todo = [(list(range(len(strings))), known)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            order += group
            lcp.append(0)
        elif depth >= known + SHALLOW:
            trie = BlindTrie(strings, group[0], depth)
            for number in group[1:]:
                trie.add(number)
            at = len(lcp)
            trie.walk(order, lcp)
            lcp[at] = 0
        else:
            # three-way partition on a character of several bytes
            characters = {n: strings[n][depth : depth + CHARACTER] for n in group}
            pivot = characters[group[len(group) // 2]]
            parts = ([], [], [])
            for number in group:
                c = characters[number]
                parts[0 if c < pivot else 1 if c == pivot else 2].append(number)
            if parts[2]:
                todo.append((parts[2], depth))
            # shorter characters end the string: it cannot be told apart any deeper
            todo.append((parts[1], depth + CHARACTER if len(pivot) == CHARACTER else known + SHALLOW))
            if parts[0]:
                todo.append((parts[0], depth))
    # seams between the groups
    for i in range(1, len(order)):
        if lcp[i] == 0:
            lcp[i] = common_prefix(strings[order[i - 1]], strings[order[i]], 0)
    return order, lcp


def _classes(order: list[int], lcp: list[int], depths: np.ndarray) -> np.ndarray:
    """[depth, string]: number of the class of strings with equal prefixes of that depth."""
    new = np.asarray(lcp)[None, :] < depths[:, None]
    new[:, 0] = False
    out = np.empty(new.shape, np.int64)
    out[:, order] = np.cumsum(new, axis=1)
    return out


def repeated_windows(
    fragments: list[tuple[int, int, bytes]], length: int, gram: int, keep_first: bool = False
) -> list[list[tuple[int, int]]]:
    """For each different (low, high, bytes) of one gram, the ranges of s in low..high whose
    window also occurs in another of them.  The window of s starts s bytes before the anchor.

    With ``keep_first`` the fragments come in the order of their first places, and only an
    earlier one counts.
    """
    n = len(fragments)
    lows = np.array([f[0] for f in fragments])
    highs = np.array([f[1] for f in fragments])
    s = np.arange(lows.min(), highs.max() + 1)
    after = _classes(*deep_shallow([f[2][f[1] :] for f in fragments], gram), length - s)
    before = _classes(*deep_shallow([f[2][: f[1]][::-1] for f in fragments]), s)
    classes = before * n + after
    absent = (s[:, None] < lows[None, :]) | (s[:, None] > highs[None, :])
    classes = np.where(absent, n * n + np.arange(n)[None, :], classes)
    by = np.argsort(classes, axis=1, kind="stable")
    ranked = np.take_along_axis(classes, by, 1)
    same = ranked[:, 1:] == ranked[:, :-1]
    found = np.zeros((len(s), n), bool)
    found[:, 1:] = same
    if not keep_first:
        found[:, :-1] |= same
    repeated = np.empty_like(found)
    np.put_along_axis(repeated, by, found, 1)
    out = []
    for i in range(n):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], repeated[:, i].view(np.int8), [0]])))
        out.append([(int(s[a]), int(s[b - 1])) for a, b in zip(edges[::2], edges[1::2])])
    return out


# ---- the job -----------------------------------------------------------------------

_ANCHORS = "doc_id {id}, text_key long, at int, low int, high int, gram long"
_OCCURRENCES = "doc_id {id}, text_key long, at int, low int, high int, gram long, fragment long, body binary"


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """An anchor of each run of windows, with what lets the run be found again."""
    names = ["doc_id", "text_key", "at", "low", "high", "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch.column(2)):
                found = byte_anchors(text.as_py().encode("utf-8", "surrogatepass"), gram, length)
                rows.append(np.full(len(found[0]), i))
                parts.append(found)
            if parts:
                at, low, high, hashes = (np.concatenate(x) for x in zip(*parts))
                index = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(index),
                        batch.column(1).take(index),
                        pa.array(at, pa.int32()),
                        pa.array(low, pa.int32()),
                        pa.array(high, pa.int32()),
                        pa.array(hashes, pa.int64()),
                    ],
                    names=names,
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.where(F.octet_length("text") >= length).mapInArrow(run, _ANCHORS.format(id=kind))


def _occurrences(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Fragments of the anchors in ``found``; a task sends the bytes of each only once."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    fields = ["at", "low", "high", "gram"]
    lists = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*fields)).alias("anchors"))
    on = texts["doc_id"].eqNullSafe(lists["doc_id"]) & (texts["text_key"] == lists["text_key"])
    rows = texts.join(lists, on).select(texts["doc_id"], texts["text_key"], "text", "anchors")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            out: tuple = ([], [], [], [], [], [], [])
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                for anchor in batch.column(3)[i].as_py():
                    at, low, high, gram = (anchor[f] for f in fields)
                    body = data[at - high : at - low + length]
                    key = digest(body, (low << 32 | high) & 0xFFFFFFFFFFFF)
                    key -= (key >> 63) << 64
                    new = key not in sent
                    if new:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(key)
                    for column, value in zip(out, (i, at, low, high, gram, key, body if new else None)):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield pack(batch, out)
                    out = ([], [], [], [], [], [], [])
            yield pack(batch, out)

    def pack(batch: pa.RecordBatch, out: tuple) -> pa.RecordBatch:
        index = pa.array(out[0], pa.int64())
        kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.binary()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(index), batch.column(1).take(index)]
            + [pa.array(c, k) for c, k in zip(out[1:], kinds)],
            names=["doc_id", "text_key", "at", "low", "high", "gram", "fragment", "body"],
        )

    return rows.mapInArrow(run, _OCCURRENCES.format(id=kind))


def _compared(bodies: DataFrame, length: int, gram: int, keep_first: bool, steps: Steps) -> DataFrame:
    """gram, fragment, low, high of windows that two fragments of one gram share; with
    ``keep_first`` those that the other one had earlier, by the column ``first``."""
    sizes = bodies.groupBy("gram").agg(F.approx_count_distinct("fragment", 0.02).alias("n"))
    # at most rows / GROUP grams; written, so that Spark knows whether they are few enough
    # for a broadcast
    large = steps.write(sizes.where(F.col("n") > GROUP).select("gram"))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, {}
        out: tuple = ([], [], [], [])

        def settle() -> None:
            if len(members) < 2:
                return
            keys = sorted(members, key=lambda k: members[k][0]) if keep_first else list(members)
            ranges = repeated_windows([members[k][1:] for k in keys], length, gram, keep_first)
            for key, found in zip(keys, ranges):
                for low, high in found:
                    for column, value in zip(out, (now, key, low, high)):
                        column.append(value)

        def pack() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            done = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=["gram", "fragment", "low", "high"]
            )
            for column in out:
                column.clear()
            return done

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    settle()
                    now, members = row[0], {}
                # the first place as (has an id, id, text, place)
                first = tuple(row[2].values()) if keep_first else ()
                members[row[1]] = ((first[0] is not None, *first) if first else (), *row[3:])
            yield pack()
        settle()
        yield pack()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for gram_, key, low, high, body in zip(*(c.to_pylist() for c in batch.columns)):
                s = range(low, high + 1)
                marks = [xxhash.xxh3_128_digest(body[high - x : high - x + length]) for x in s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gram_] * len(s)), pa.array([key] * len(s)), pa.array(s, pa.int32()), pa.array(marks, pa.binary())],
                    names=["gram", "fragment", "s", "mark"],
                )

    columns = ["gram", "fragment", "low", "high", "body"]
    schema = "gram long, fragment long, low int, high int"
    first = ["first"] if keep_first else [F.lit(None).cast("int").alias("first")]
    few = bodies.join(large, "gram", "left_anti").select("gram", "fragment", *first, *columns[2:])
    few = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(groups, schema)
    # pre-aggregated: the same fragment may have been sent by several tasks
    many = bodies.join(large, "gram", "left_semi").select(*columns)
    marks = many.mapInArrow(windows, "gram long, fragment long, s int, mark binary").distinct()
    if keep_first:
        marks = marks.join(bodies.select("gram", "fragment", "first").distinct(), ["gram", "fragment"])
        earliest = F.min(F.struct("first", "fragment"))
    else:
        earliest = F.lit(None).cast("struct<first:int,fragment:bigint>")
    shared = marks.groupBy("mark").agg(F.count("*").alias("n"), earliest.alias("e")).where("n > 1").select("mark", "e")
    rest = marks.join(shared, "mark")
    if keep_first:
        rest = rest.where(F.col("fragment") != F.col("e.fragment"))
    rest = rest.select("gram", "fragment", F.col("s").alias("low"), F.col("s").alias("high"))
    return few.unionByName(rest)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, steps: Steps | None = None, keep_first: bool = False
) -> DataFrame:
    """doc_id, text_key, spans: merged [lo, hi) byte spans that also occur elsewhere; with
    ``keep_first`` those that occur earlier."""
    steps = steps or Steps(docs.sparkSession)
    texts = keyed(docs)
    anchors = steps.write(_anchor_rows(texts, length, gram))
    # written, so that the join is between two shuffles and its hot grams can be split
    twice = steps.write(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    pieces = steps.write(_occurrences(texts, anchors.join(twice, "gram"), length))
    steps.drop(anchors, twice)
    bodies, name = pieces.where("body IS NOT NULL"), ["gram", "fragment"]
    place = F.struct("doc_id", "text_key", "at")
    copies = steps.write(
        pieces.groupBy(*name).agg(F.count("*").alias("n"), F.min(place).alias("first"))
        if keep_first
        else pieces.groupBy(*name).agg(F.count("*").alias("n")).where("n > 1")
    )
    if keep_first:
        bodies = bodies.join(copies.drop("n"), name)
    no_range = F.lit(None).cast("int")
    whole = copies.where("n > 1").select(*name, no_range.alias("low"), no_range.alias("high"))
    ranges = whole.unionByName(_compared(bodies, length, gram, keep_first, steps)).groupBy(*name)
    ranges = ranges.agg(F.collect_set(F.struct(F.col("low").alias("a"), F.col("high").alias("b"))).alias("ranges"))
    if keep_first:
        ranges = ranges.join(copies.drop("n"), name)
    # written, so that the join with the one row of a fragment with very many copies is
    # between two shuffles as well
    ranges = steps.write(ranges)
    at = pieces.drop("body").join(ranges, name)
    found = at.select("doc_id", "text_key", "at", "low", "high", *(["first"] if keep_first else []), F.explode("ranges").alias("r"))
    if keep_first:
        # the whole of a fragment is repeated everywhere but at its first place
        here = F.struct("doc_id", "text_key", "at").eqNullSafe(F.col("first"))
        found = found.where(~here | F.col("r.a").isNotNull())
    spans = found.select(
        "doc_id",
        "text_key",
        (F.col("at") - F.coalesce("r.b", "high")).cast("long").alias("lo"),
        (F.col("at") - F.coalesce("r.a", "low") + length).cast("long").alias("hi"),
    )
    of_document = ["doc_id", "text_key"]
    runs = merged(spans.distinct(), of_document).groupBy(*of_document)
    out = steps.write(runs.agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")))
    steps.drop(pieces, copies, ranges)
    return out


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes left), spans, of every row."""
    rows = attach(keyed(docs), spans).select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lengths = [], []
            for text, cuts in zip(batch.column(1), batch.column(2)):
                data, at, left = text.as_py().encode("utf-8", "surrogatepass"), 0, []
                for cut in cuts.as_py() or []:
                    left.append(data[at : cut["lo"]])
                    at = cut["hi"]
                kept.append(b"".join([*left, data[at:]]))
                lengths.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(lengths, pa.int64()), batch.column(2)],
                names=["doc_id", "kept", "n_bytes", "spans"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind}, kept binary, n_bytes long, spans array<struct<lo:bigint,hi:bigint>>"
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; characters cut apart go whole."""
    found = repeated_spans(docs, length, gram, keep_first=keep_first)
    empty = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    own = {c: fresh(docs, f"_{c}") for c in found.columns}
    found = found.withColumnsRenamed(own)
    on = F.col("doc_id").eqNullSafe(F.col(own["doc_id"])) & (text_key(F.col("text")) == F.col(own["text_key"]))
    spans = F.col(own["spans"])

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans):
            if text is None or cuts is None or len(cuts) == 0:
                out.append(text)
                continue
            data, at, left = text.encode("utf-8", "surrogatepass"), 0, []
            for c in cuts:
                left.append(data[at : c["lo"]])
                at = c["hi"]
            out.append(b"".join([*left, data[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    joined = docs.join(found, on, "left")
    text = F.when(spans.isNull(), F.col("text")).otherwise(cut(F.col("text"), F.coalesce(spans, empty)))
    return joined.withColumn("text", text).select(*docs.columns)
