"""Provider rules over whole texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credsieve.functions.text import FOLDING_LETTERS, halves, pair, sql_text
from credsieve.rules.model import LONG_RUN, Rule

# stands before a match while the text is cut into lines
_MARK = "\x01"


def _contains_sql(text: str, literals: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_text(x)})" for x in literals) + ")"


def rule_sql(text: str, rule: Rule) -> str:
    """SQL condition: the rule matches in ``text``.

    The literals come first, they are cheap and never wrong about a text without the
    rule's token.  Conditions of many rules are written as SQL because that is one call
    into the JVM for all of them.
    """
    found = f"rlike({text}, {sql_text(rule.java)})"
    literals = [literal for literal in rule.literals if literal]
    if not literals:
        return found
    if rule.any_case:
        low = _contains_sql("low", [literal.lower() for literal in literals])
        gate = f"(exists(array(lower({text})), low -> {low}) OR {_contains_sql(text, FOLDING_LETTERS)})"
    else:
        gate = _contains_sql(text, literals)
    return f"({gate} AND {found})"


def long_runs_sql(text: str) -> str:
    """The long runs of token characters, blanks between them."""
    return f"array_join(regexp_extract_all({text}, {sql_text(LONG_RUN)}, 0), ' ')"


def any_rule(text: str, rules: list[Rule], or_in_runs: list[str] = ()) -> Column:
    """True if a rule matches in the column named ``text``.

    Rules whose match is one long run look at the runs only.  ``or_in_runs`` are further
    patterns to look for there.
    """
    tests = [f"rlike(runs, {sql_text(p)})" for p in or_in_runs]
    tests += [rule_sql("runs", r) for r in rules if r.is_long_run]
    tests += [rule_sql(text, r) for r in rules if r.has_long_run and not r.is_long_run]
    plain = [rule_sql(text, r) for r in rules if not r.has_long_run]
    if tests:
        # the lambda gives the runs a name, so that they are taken out once
        plain.append(
            f"exists(array({long_runs_sql(text)}), runs -> runs != '' AND ({' OR '.join(tests)}))"
        )
    return F.expr(" OR ".join(plain)) if plain else F.lit(False)


def applying_rules(text: str, rules: list[tuple[int, Rule]]) -> Column:
    """Indexes of the rules with at least one match in the column named ``text``."""
    tests = ", ".join(
        f"CASE WHEN {rule_sql('runs' if r.is_long_run else text, r)} THEN {i} END" for i, r in rules
    )
    found = f"transform(array({long_runs_sql(text)}), runs -> array_compact(array({tests})))"
    return F.expr(f"flatten({found})")


def match_mark(text: Column) -> Column:
    """A string that does not occur in the text."""
    return F.when(
        F.contains(text, F.lit(_MARK)), F.concat(F.lit(_MARK), F.sha2(text, 256))
    ).otherwise(F.lit(_MARK))


def located_matches(
    text: Column, mark: Column, pattern: Column, ignored: Callable[[Column], Column]
) -> Column:
    """Distinct matches of a rule: array of (line_number, match, pos), ignored lines left out.

    The mark is put before every match, then the text is cut at newlines: each marked
    line gives its number once per mark, in match order.  That takes one pass for any
    number of matches and also serves rules whose matches cross lines.  Repeats on a
    line are dropped here, before a match is given its line.
    """
    marked = F.transform(
        F.split(F.regexp_replace(text, pattern, F.concat(mark, F.lit("$0"))), "\n", -1),
        lambda line, i: F.struct((i + 1).alias("line_number"), line.alias("line")),
    )

    def per_mark(row: Column) -> Column:
        bare = F.replace(row["line"], mark, F.lit(""))
        marks = (F.length(row["line"]) - F.length(bare)) / F.length(mark)
        number = F.when(~ignored(bare), row["line_number"].cast("string"))
        return F.array_repeat(number, marks.cast("int"))

    numbers = F.flatten(
        F.transform(F.filter(marked, lambda row: F.contains(row["line"], mark)), per_mark)
    )
    found = F.zip_with(numbers, F.regexp_extract_all(text, pattern, F.lit(0)), pair)

    def located(joined: Column, i: Column) -> Column:
        number, match = halves(joined)
        return F.struct(
            number.cast("int").alias("line_number"), match.alias("match"), i.alias("pos")
        )

    return F.transform(F.array_distinct(F.array_compact(found)), located)


def spans(text: Column, mark: Column, pattern: Column) -> Column:
    """All matches of a rule in order: array of (start, end, match), counted in characters from 0.

    The mark is put on both sides of every match; between two marks stand matches and what
    is not matched in turn, so the lengths so far are the places.
    """
    marked = F.regexp_replace(text, pattern, F.concat(mark, F.lit("$0"), mark))
    pieces = F.split(marked, F.concat(F.lit("\\Q"), mark, F.lit("\\E")), -1)
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        span = F.struct(state["at"].alias("start"), end.alias("end"), piece.alias("match"))
        found = F.when(state["odd"], F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), (~state["odd"]).alias("odd"), found.alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("found"))
    return F.aggregate(pieces, start, step)["found"]


PYTHON_MATCHES = "rule_idx int, line_number int, line string, match string, pos int"


def literal_sql(text: str, rule: Rule) -> str | None:
    """SQL condition that holds for every text the rule matches in; None if unknown."""
    literals = [literal for literal in rule.literals if literal]
    if not literals:
        return None
    if not rule.any_case:
        return _contains_sql(text, literals)
    low = _contains_sql(f"lower({text})", [literal.lower() for literal in literals])
    return f"({low} OR {_contains_sql(text, FOLDING_LETTERS)})"


def line_matches(text: str, pattern: re.Pattern) -> Iterator[tuple[int, str, str, int]]:
    """(line_number, line, match, pos) of the distinct matches on a line."""
    line_number, line_start, seen = 1, 0, set()
    for pos, m in enumerate(pattern.finditer(text)):
        line_number += text.count("\n", line_start, m.start())
        line_start = m.start()
        if (line_number, m.group()) in seen:
            continue
        seen.add((line_number, m.group()))
        first = text.rfind("\n", 0, m.start()) + 1
        last = text.find("\n", m.start())
        line = text[first : last if last >= 0 else len(text)].rstrip("\r\n")
        yield line_number, line, m.group(), pos


def python_matches(texts: DataFrame, keys: list[str], rules: list[tuple[int, Rule]]) -> DataFrame:
    """Matches of the rules that only Python's ``re`` can run, from Arrow batches.

    Only texts with a literal of some rule leave the JVM, with the rules to try on them.
    """
    patterns = {i: rule.pattern for i, rule in rules}
    tests = ", ".join(f"CASE WHEN {literal_sql('_text', rule) or 'true'} THEN {i} END" for i, rule in rules)
    gated = texts.withColumn("_try", F.expr(f"array_compact(array({tests}))")).where(F.size("_try") > 0)
    gated = gated.select(*keys, "_try", "_text")
    key_types = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*keys, "rule_idx", "line_number", "line", "match", "pos"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {i: re.compile(p) for i, p in patterns.items()}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                text, tried, key = row[-1], row[-2], row[:-2]
                for i in tried:
                    out.extend((*key, i, *found) for found in line_matches(text, compiled[i]))
            yield pd.DataFrame(out, columns=columns)

    return gated.mapInPandas(scan, f"{key_types}, {PYTHON_MATCHES}")


def python_spans(texts: DataFrame, keys: list[str], rules: list[tuple[int, Rule]]) -> DataFrame:
    """(keys, _text, rule_idx, start, end, match) of the rules that only Python can run."""
    patterns = [(i, rule.pattern) for i, rule in rules]
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in [*keys, "_text"])
    columns = [*keys, "_text", "rule_idx", "start", "end", "match"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(i, re.compile(p)) for i, p in patterns]
        for batch in batches:
            out = [
                (*row, i, m.start(), m.end(), m.group())
                for row in batch.itertuples(index=False, name=None)
                for i, p in compiled
                for m in p.finditer(row[-1])
            ]
            yield pd.DataFrame(out, columns=columns)

    return texts.select(*keys, "_text").mapInPandas(scan, f"{kinds}, rule_idx int, start int, end int, match string")
