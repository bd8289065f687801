"""Benchmark decontamination with native column expressions.

The normalised n-grams of the test items become a hash set that is broadcast behind a
check of its size; windows of the training texts look themselves up in it.  Only windows
whose first words have the hash of some test window's first words are put together for
that.  The set is keyed by the words themselves, so that every hit of it is verified.

Defined results: a null or wordless text has no words and no hits; an item without words
is never found; an item shorter than the window is one window of its own length; items
with equal windows are all reported; rows that repeat (doc_id, text) each get the same
result; a very long text is one row of words, and windows only where they may hit; an empty
table gives an empty result, an empty benchmark no hits.  Columns of any other name are left
as they are by ``drop_contaminated`` and left behind by ``contamination``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import ascii_lower, attach, fresh, keyed, merged, text_key
from credsieve.storage import Steps

# First words of a window that are looked at before it is put together.
KEY_WORDS = 3
# Remainders of their hash that are told apart.
MARKS_LEAST, MARKS_MOST = 1 << 16, 1 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
# Above this many bytes of test windows the join is shuffled instead of broadcast.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(ngram, length, items): every distinct window and the sorted ids of its items."""
    words = benchmark.select(
        F.col("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("words")
    ).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    grams = words.select(
        "item_id",
        length.alias("length"),
        F.explode(
            F.transform(starts, lambda i: F.array_join(F.slice("words", i, length), " "))
        ).alias("ngram"),
    )
    return grams.groupBy("ngram", "length").agg(
        F.array_sort(F.collect_set("item_id")).alias("items")
    )


def _key(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from ``at``, counted from 0, on."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def _marks(grams: DataFrame, k: int) -> bytearray:
    """A byte for each remainder of the hash of k words: 1 if a test window begins with such."""
    of_kind = grams.where(F.least("length", F.lit(KEY_WORDS)) == k)
    size = min(max(MARKS_LEAST, 1 << (16 * of_kind.count()).bit_length()), MARKS_MOST)
    at = F.pmod(_key(F.split("ngram", " "), F.lit(0), k), F.lit(size))
    marks = bytearray(size)
    for r in of_kind.select(at.alias("at")).distinct().collect():  # MARKS_MOST at most
        marks[r["at"]] = 1
    return marks


def _may_begin(words: Column, marks: bytearray, k: int) -> Callable[[Column], Column]:
    table, size, one = F.lit(marks), F.lit(len(marks)), F.lit(bytearray(b"\x01"))

    def test(at: Column) -> Column:
        place = F.pmod(_key(words, at, k), size).cast("int") + 1
        return F.substr(table, place, F.lit(1)) == one

    return test


def _windows(words: Column, starts: Column, length: int) -> Column:
    def fits(at: Column) -> Column:
        return at + length <= F.size(words)

    def window(at: Column) -> Column:
        ngram = F.array_join(F.slice(words, at + 1, length), " ")
        return F.struct(at.alias("start"), F.lit(length).alias("length"), ngram.alias("ngram"))

    return F.transform(F.filter(starts, fits), window)


def text_windows(texts: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, text_key, n_words, windows: those (start, length, ngram) that may be some test
    item's, start counting from 0.

    The words of a text are taken out once.  A window is put together only where the hash
    of its first words, KEY_WORDS at most, is that of some test window's first words.
    """
    words = F.col("words")
    # a generator, so that the words are not computed again for each of their uses
    rows = texts.select("doc_id", "text_key", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    parts = []
    for k in range(1, KEY_WORDS + 1):
        of_kind = [n for n in lengths if min(n, KEY_WORDS) == k]
        if not of_kind:
            continue
        places = F.sequence(F.lit(0), F.size(words) - min(of_kind))
        starts = F.filter(places, _may_begin(words, _marks(grams, k), k))
        none = F.array().cast("array<int>")
        rows = rows.withColumn(f"_starts_{k}", F.when(F.size(words) >= min(of_kind), starts).otherwise(none))
        parts += [_windows(words, F.col(f"_starts_{k}"), n) for n in of_kind]
    windows = F.concat(*parts) if len(parts) > 1 else parts[0]
    return rows.select("doc_id", "text_key", F.size(words).cast("long").alias("n_words"), windows.alias("windows"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, steps: Steps | None = None
) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit, item_ids, spans.

    ``spans`` are the merged [lo, hi) word spans that windows of test items cover.
    """
    steps = steps or Steps(docs.sparkSession)
    texts = keyed(docs)
    grams = steps.write(benchmark_windows(benchmark, window))
    size = grams.agg(
        F.sum(F.octet_length("ngram") + 8 * F.size("items") + 64).alias("bytes"),
        F.collect_set("length").alias("lengths"),
    ).first()
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    item = benchmark.schema["item_id"].dataType.simpleString()
    if not size["lengths"]:
        return texts.select(
            "doc_id", "text_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"), F.array().cast(f"array<{item}>").alias("item_ids"), none.alias("spans"),
        )
    # without texts: the few windows that are worth looking up, and the numbers of words
    rows = steps.write(text_windows(texts, grams, sorted(size["lengths"])))
    known = F.broadcast(grams) if size["bytes"] <= BROADCAST_BYTES else grams
    of_document = ["doc_id", "text_key"]
    hits = rows.select(*of_document, F.inline("windows")).join(known, ["ngram", "length"])
    hits = steps.write(hits.select(*of_document, F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("length")).cast("long").alias("hi"), "items"))
    runs = merged(hits.select(*of_document, "lo", "hi").distinct(), of_document).groupBy(*of_document)
    spans = runs.agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_spans"), F.sum(F.col("hi") - F.col("lo")).alias("_n_hit")
    )
    items = hits.select(*of_document, F.explode("items").alias("item")).groupBy(*of_document)
    found = attach(spans, items.agg(F.array_sort(F.collect_set("item")).alias("_items")))
    return attach(rows.drop("windows"), found).select(
        "doc_id", "text_key", "n_words",
        F.coalesce("_n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("_items", F.array().cast(f"array<{item}>")).alias("item_ids"),
        F.coalesce("_spans", none).alias("spans"),
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words lie in windows of test items."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    own_id, own_key = fresh(docs, "_bad_id"), fresh(docs, "_bad_key")
    bad = (
        contamination(docs, benchmark, window)
        .where(is_contaminated(F.col("n_hit"), F.col("n_words")))
        .select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
        .distinct()
    )
    on = F.col("doc_id").eqNullSafe(F.col(own_id)) & (text_key(F.col("text")) == F.col(own_key))
    return docs.join(bad, on, "left_anti")


def cut_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text: the texts without the hit words and what separates them from the next word."""
    text = F.col("text")
    rows = attach(keyed(docs), found.select("doc_id", "text_key", "spans").distinct())
    word = r"(?i:[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
    words = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    gaps = F.split(text, word)
    kept = F.transform(
        F.col("_words"),
        lambda w, i: F.when(
            F.exists("spans", lambda s: (s["lo"] <= i) & (i < s["hi"])), F.lit("")
        ).otherwise(F.concat(w, F.get("_gaps", i + 1))),
    )
    return rows.select("doc_id", "spans", words.alias("_words"), gaps.alias("_gaps")).select(
        "doc_id", F.concat(F.get("_gaps", F.lit(0)), F.array_join(kept, "")).alias("text")
    )
