"""Allowlists of any size.

An allowlist is a table of entries (pattern, scope, is_regex); an entry allows a finding
whose text holds the literal, or in which the regex is found, and whose path or file name
matches the scope.  Few entries are predicates of the plan.  More of them stay a table:

1. Each entry is prepared on the executors: its Java form, its scope as a regex, and the
   strings of which every match holds one.  A literal is its own such string.
2. The distinct (file path, text) of the findings are an inverted index: their substrings
   of ``GRAM`` characters, or of a shorter string whole, with the number of texts that hold
   them.  Each required string is looked up by the rarest of its grams; a gram no text holds
   ends the matter there.
3. The pairs that meet are verified, by ``rlike`` with the entry's pattern, or by Python's
   ``re`` where Java has no equal form.
4. Entries without a string of ``SHORTEST`` characters are put into alternations of one
   scope, and those are tested on blocks of texts.

Nothing of the entries reaches the driver beyond the ``FEW`` that decide the way.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from credsieve.functions.globs import globs_to_regex
from credsieve.functions.regex import Untranslatable, required, to_java
from credsieve.functions.text import base_name, normal_path
from credsieve.operators.joins import ROWS_PER_TASK, join_salted
from credsieve.operators.paths import matches_globs
from credsieve.storage import cut_lineage

# Entries up to this number are compiled into the plan.
FEW = 50
# Regexes tested together as one alternation.
ALTERNATIVES = 100
# Strings are looked up by this many characters, shorter ones whole.
GRAM = 8
SHORTEST = 3
# Texts of a block that is tested with all alternations.
BLOCK = 20_000
# A group that refers to another by number or name, and flags for a whole pattern, cannot
# move into an alternation.
_ALONE = re.compile(r"\\[1-9]|\(\?P[=<]|\(\?\(|\(\?[aiLmsux]+\)")

ENTRY = "pattern string, scope string, is_regex boolean"
PREPARED = f"{ENTRY}, java string, scope_java string, needed array<string>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def regex_problem(pattern: str) -> str | None:
    """Why an allowlist regex cannot be used, None if it can."""
    try:
        re.compile(pattern)
    except re.error as exc:
        return f"invalid regex: {exc}"
    return None


def split_allowlist(allowlist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable entries, and rejected ones with the reason in ``problem``."""

    @F.pandas_udf(StringType())
    def problems(patterns: pd.Series) -> pd.Series:
        return patterns.map(regex_problem)

    empty = F.when(F.coalesce("pattern", F.lit("")) == "", F.lit("empty pattern"))
    checked = allowlist.withColumn(
        "problem", F.coalesce(empty, F.when(F.col("is_regex"), problems(F.coalesce("pattern", F.lit("")))))
    )
    return (
        checked.where(F.col("problem").isNull()).drop("problem"),
        checked.where(F.col("problem").isNotNull()),
    )


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _in_scope(scope_java: Column) -> Column:
    path = normal_path(F.col("file_path"))
    return scope_java.isNull() | F.rlike(path, scope_java) | F.rlike(base_name(path), scope_java)


# ---- few entries: predicates --------------------------------------------------------


@functools.lru_cache(4096)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _found_by_python(value: Column, pattern: Column) -> Column:
    @F.pandas_udf(BooleanType())
    def found(values: pd.Series, patterns: pd.Series) -> pd.Series:
        return pd.Series(
            [_compiled(p).search(v) is not None for v, p in zip(values, patterns, strict=True)], dtype=bool
        )

    return found(value, pattern)


def _predicates(entries: list[Row]) -> list[Column]:
    tests = []
    for e in entries:
        value = F.col("matched_text")
        if not e.is_regex:
            hit = F.contains(value, F.lit(e.pattern))
        elif regex_problem(e.pattern):
            continue
        else:
            try:
                hit = value.rlike(to_java(e.pattern))
            except Untranslatable:
                hit = _found_by_python(value, F.lit(e.pattern))
        tests.append(matches_globs(F.col("file_path"), [e.scope]) & hit if e.scope else hit)
    return tests


# ---- many entries: a table ----------------------------------------------------------


def prepare_entry(pattern: str, scope: str | None, is_regex: bool) -> tuple | None:
    """(java, scope_java, needed) of an entry; None if its regex is invalid."""
    scope_java = globs_to_regex([scope]) if scope else None
    if not is_regex:
        return None, scope_java, [pattern.translate(str.maketrans(_UPPER, _LOWER))]
    try:
        re.compile(pattern)
    except re.error:
        return None
    try:
        java = to_java(pattern)
    except Untranslatable:
        java = None
    return java, scope_java, required(pattern)


def prepared(entries: DataFrame) -> DataFrame:
    """Distinct usable entries as PREPARED; ``java`` is null for literals and for regexes
    that only Python can run.

    Parsing a pattern takes long for the size of its row, so the entries are dealt over all
    cores; a shuffle that goes by sizes would leave them to a task or two.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PREPARED.split(", ")]
        for batch in batches:
            out = []
            for pattern, scope, is_regex in batch.itertuples(index=False):
                found = prepare_entry(pattern, scope, is_regex)
                if found:
                    out.append((pattern, scope, is_regex, *found))
            yield pd.DataFrame(out, columns=columns)

    usable = entries.where(F.coalesce("pattern", F.lit("")) != "")
    distinct = usable.select("pattern", "scope", F.coalesce("is_regex", F.lit(False)).alias("is_regex")).distinct()
    dealt = distinct.repartition(entries.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(run, PREPARED)


def _windows(text: Column, n: Column) -> Column:
    """All substrings of n characters; none of a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(
        F.length(text) >= n, F.transform(starts, lambda i: F.substr(text, i, n))
    ).otherwise(F.array().cast("array<string>"))


def _indexed_hits(values: DataFrame, entries: DataFrame, rows_per_task: int) -> DataFrame:
    """(file_path, matched_text) allowed by an entry that has a required string."""
    value, low = F.col("matched_text"), F.col("_low")
    strings = entries.select("*", F.explode("needed").alias("_s"))
    # SHORTEST to GRAM, so a handful of numbers
    sizes = [r[0] for r in strings.select(F.least(F.length("_s"), F.lit(GRAM))).distinct().collect()]
    if not sizes:
        return values.where(F.lit(False))
    own = F.array_distinct(F.flatten(F.array(*[_windows(low, F.lit(n)) for n in sorted(sizes)])))
    texts = values.withColumn("_low", _ascii_lower(value))
    # made twice from the texts: that is cheaper than to write its many times larger table
    index = texts.select("file_path", "matched_text", F.explode(own).alias("_gram"))
    # also tells which grams are hot, so the index is not counted again for its join
    counts = cut_lineage(index.groupBy("_gram").agg(F.count("*").alias("_n")))
    hot = counts.where(F.col("_n") > rows_per_task).select(
        "_gram", F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts")
    )
    grams = F.array_distinct(_windows(F.col("_s"), F.least(F.length("_s"), F.lit(GRAM))))
    strings = strings.withColumn("_gram", F.explode(grams))
    own_columns = ["pattern", "scope", "is_regex", "java", "scope_java"]
    # grams of one string: a handful; a string with a gram that no text holds is not found
    rarest = (
        join_salted(strings, counts, ["_gram"], "left", rows_per_task)
        .groupBy(*own_columns, "_s")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_r"))
        .where("_r._n > 0")
        .select(*own_columns, "_s", F.col("_r._gram").alias("_gram"))
    )
    rarest = cut_lineage(rarest)
    met = join_salted(index, rarest, ["_gram"], rows_per_task=rows_per_task, hot=hot)
    met = met.where(F.contains(_ascii_lower(value), F.col("_s")) & _in_scope(F.col("scope_java")))
    literal = ~F.col("is_regex") & F.contains(value, F.col("pattern"))
    by_java = F.col("java").isNotNull() & F.rlike(value, F.col("java"))
    hits = met.where(literal | by_java).select("file_path", "matched_text")
    by_python = met.where(F.col("is_regex") & F.col("java").isNull())
    found = by_python.where(_found_by_python(value, F.col("pattern"))).select("file_path", "matched_text")
    return hits.unionByName(found)


def _alternations(rows: pd.DataFrame) -> list[tuple[re.Pattern | None, list]]:
    """(scope, tests) of entries; a test is a compiled pattern or a literal."""
    from fnmatch import translate

    by_scope: dict[str | None, list] = {}
    for pattern, scope, is_regex in rows[["pattern", "scope", "is_regex"]].itertuples(index=False):
        by_scope.setdefault(scope, []).append(re.escape(pattern) if not is_regex else pattern)
    out = []
    for scope, patterns in by_scope.items():
        alone = [p for p in patterns if _ALONE.search(p)]
        rest = [p for p in patterns if not _ALONE.search(p)]
        joined = ["|".join(f"(?:{p})" for p in rest[i : i + ALTERNATIVES]) for i in range(0, len(rest), ALTERNATIVES)]
        out.append((re.compile(translate(scope)) if scope else None, [re.compile(p) for p in [*joined, *alone]]))
    return out


def _unindexed_hits(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(file_path, matched_text) allowed by an entry of which no string is known.

    Each of these entries has to be tested on each text: a task gets a block of texts and
    all the entries.
    """
    blocks = -(-values.count() // BLOCK)
    dealt = values.withColumn("_block", F.pmod(F.xxhash64("file_path", "matched_text"), F.lit(max(1, blocks))))
    copies = entries.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, blocks) - 1).cast("long"))))

    def run(texts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        tests = _alternations(rows.astype(object).where(rows.notna(), None))

        def allowed(path: str, value: str) -> bool:
            path = path.replace("\\", "/")
            name = path.rsplit("/", 1)[-1]
            return any(
                (scope is None or scope.match(path) or scope.match(name)) and any(t.search(value) for t in patterns)
                for scope, patterns in tests
            )

        keep = [allowed(p, v) for p, v in zip(texts["file_path"], texts["matched_text"], strict=True)]
        return texts.loc[keep, ["file_path", "matched_text"]]

    return (
        dealt.groupBy("_block")
        .cogroup(copies.select("pattern", "scope", "is_regex", "_block").groupBy("_block"))
        .applyInPandas(run, "file_path string, matched_text string")
    )


def allowed_texts(
    values: DataFrame, entries: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The distinct (file_path, matched_text) of ``values`` that an entry allows.

    Both tables are read several times: they should be written ones.
    """
    long_enough = (F.size("needed") > 0) & (F.array_min(F.transform("needed", F.length)) >= SHORTEST)
    indexed, others = entries.where(long_enough), entries.where(~long_enough)
    hits = _indexed_hits(values, indexed, rows_per_task)
    if not others.isEmpty():
        hits = hits.unionByName(_unindexed_hits(values, others))
    return hits.distinct()


def drop_allowed(findings: DataFrame, allowlist: DataFrame | None) -> DataFrame:
    """Findings no allowlist entry speaks for.

    ``allowlist`` holds (pattern, scope, is_regex).  Beyond ``FEW`` entries the findings are
    written, so that their texts are searched once, and the entries stay a table.  Findings
    that are a stream meet the table without an index.  Entries with an invalid regex allow
    nothing; ``split_allowlist`` tells which.
    """
    if allowlist is None:
        return findings
    usable = allowlist.where(F.coalesce("pattern", F.lit("")) != "").select(
        "pattern", "scope", F.coalesce("is_regex", F.lit(False)).alias("is_regex")
    )
    few = usable.limit(FEW + 1).collect()
    if len(few) <= FEW:
        tests = _predicates(sorted(set(few), key=lambda e: (e.scope or "", e.pattern, e.is_regex)))
        return findings.where(~functools.reduce(Column.__or__, tests)) if tests else findings
    entries = cut_lineage(prepared(usable))
    if findings.isStreaming:
        return _drop_from_stream(findings, entries)
    findings = cut_lineage(findings)
    values = cut_lineage(findings.select("file_path", "matched_text").distinct())
    allowed = allowed_texts(values, entries)
    return findings.join(allowed, ["file_path", "matched_text"], "left_anti")


def _drop_from_stream(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """A stream cannot be joined with what is derived from it; its batches are small."""
    value = F.col("matched_text")
    ready = entries.where(~F.col("is_regex") | F.col("java").isNotNull()).drop("needed", "scope")
    literal = ~F.col("is_regex") & F.contains(value, F.col("pattern"))
    hit = literal | (F.col("is_regex") & F.rlike(value, F.col("java")))
    kept = findings.join(ready, hit & _in_scope(F.col("scope_java")), "left_anti")
    python_only = entries.where(F.col("is_regex") & F.col("java").isNull())
    if python_only.isEmpty():
        return kept
    rows = [r for r in python_only.select("pattern", "scope", "is_regex").toLocalIterator()]
    return kept.where(~functools.reduce(Column.__or__, _predicates(rows)))
