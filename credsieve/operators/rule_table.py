"""Rules that stay a table.

Rules compiled into a plan make it as long as their number.  Here the plan does not know
them: an automaton over the strings of which every match holds one reads a text once and
names the rules that can match in it, and only those are tried.  Rules of which no such
string is known are tried on every text.

Patterns run as Python's ``re``, so there are no patterns that another dialect lacks.  The
rules reach the workers as broadcasts of at most ``SLICE`` bytes; a larger table is several
of them, one pass over the texts each.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions.findings import severity_rank
from credsieve.functions.regex import required
from credsieve.operators.patterns import line_matches
from credsieve.sources.rules import split_rules

SLICE = 16 << 20
# Compiled patterns a worker keeps.
COMPILED = 20_000
# Shorter strings name too many texts to be worth looking for.
SHORTEST = 2

_compiled = functools.lru_cache(COMPILED)(re.compile)


class RuleSet:
    """Some rules, and which of them can match in a text.

    ``rows`` are (rule_idx, id, name, severity, pattern, needed).  A pattern that several
    rules have is tried once; the first of them stands for it.
    """

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = {r[0]: r for r in rows}

    @functools.cached_property
    def of_pattern(self) -> dict[str, list[int]]:
        """The rules of each pattern, in their order."""
        found: dict[str, list[int]] = {}
        for i in sorted(self.rows):
            found.setdefault(self.rows[i][4], []).append(i)
        return found

    @functools.cached_property
    def tried(self) -> list[tuple]:
        """The first rule of each pattern."""
        return [self.rows[same[0]] for same in self.of_pattern.values()]

    @functools.cached_property
    def always(self) -> list[int]:
        return [r[0] for r in self.tried if not self._strings(r)]

    @staticmethod
    def _strings(row: tuple) -> list[str]:
        strings = list(row[5])
        return strings if strings and min(map(len, strings)) >= SHORTEST else []

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        of_string: dict[str, list[int]] = {}
        for row in self.tried:
            for string in self._strings(row):
                of_string.setdefault(string.encode().decode("latin-1"), []).append(row[0])
        if not of_string:
            return None
        found = ahocorasick.Automaton()
        for string, rules in of_string.items():
            found.add_word(string, rules)
        found.make_automaton()
        return found

    def candidates(self, text: str) -> list[int]:
        """Rules to try on the text, in their order."""
        rules = set(self.always)
        if self.automaton is not None:
            # the bytes as characters: A-Z in lower case, all else as it is
            for _, named in self.automaton.iter(text.encode(errors="surrogatepass").lower().decode("latin-1")):
                rules.update(named)
        return sorted(rules)

    def matches(self, text: str, first_only: bool = False) -> Iterator[tuple]:
        """(rule_idx, id, name, severity, line_number, line, match, pos).

        With ``first_only`` what several rules match on a line is told for the first of them.
        """
        seen = set()
        for i in self.candidates(text):
            pattern = self.rows[i][4]
            rules = [i] if first_only else self.of_pattern[pattern]
            for found in line_matches(text, _compiled(pattern)):
                if first_only:
                    place = (found[0], found[2])
                    if place in seen:
                        continue
                    seen.add(place)
                for rule in rules:
                    yield (*self.rows[rule][:4], *found)


def rule_sets(rules: DataFrame, first_idx: int = 0, slice_bytes: int = SLICE) -> Iterator[RuleSet]:
    """The usable rules of a table of rule rows, numbered in their order from ``first_idx``.

    The order is that of rule_idx if there is one, else of id.  The driver holds one set
    at a time.
    """
    valid = split_rules(rules)[0]
    order = "rule_idx" if "rule_idx" in valid.columns else "id"
    columns = ["id", "name", "severity", "pattern"]

    def with_needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(needed=[required(p) for p in batch["pattern"]])

    kind = valid.schema[order].dataType.simpleString()
    schema = f"_order {kind}, " + ", ".join(f"{c} string" for c in columns) + ", needed array<string>"
    ready = valid.select(F.col(order).alias("_order"), *columns).mapInPandas(with_needed, schema)
    rows, size = [], 0
    for n, r in enumerate(ready.orderBy("_order", "id", "pattern").toLocalIterator()):
        own = sum(len(r[c]) for c in columns) + sum(map(len, r.needed))
        if rows and size + own > slice_bytes:
            yield RuleSet(rows)
            rows, size = [], 0
        rows.append((first_idx + n, *(r[c] for c in columns), r.needed))
        size += own
    if rows:
        yield RuleSet(rows)


FOUND = "rule_idx int, rule_id string, rule_name string, severity string, line_number int, line_content string, matched_text string, pos bigint"


def table_hits(
    texts: DataFrame, keys: list[str], rules: DataFrame, first_idx: int = 0, slice_bytes: int = SLICE, first_only: bool = False
) -> DataFrame:
    """Matches of rule rows in (keys, _text): keys and the columns of a pattern hit.

    With ``first_only`` at least the first rule of each (line, matched text) is there; rules
    that repeat a pattern then add no rows.
    """
    key_types = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *(c.split()[0] for c in FOUND.split(", "))]
    context, found = texts.sparkSession.sparkContext, None
    for rule_set in rule_sets(rules, first_idx, slice_bytes):
        shared = context.broadcast(rule_set)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(*row[:-1], *hit) for row in batch.itertuples(index=False, name=None) for hit in shared.value.matches(row[-1], first_only)]
                yield pd.DataFrame(out, columns=names)

        part = texts.select(*keys, "_text").mapInPandas(scan, f"{key_types}, {FOUND}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = texts.sparkSession.createDataFrame([], f"{key_types}, {FOUND}")
    return found.select(
        *keys, "rule_id", "rule_name", "severity", severity_rank(F.col("severity")).alias("sev_rank"), "line_number",
        "line_content", "matched_text", F.lit("PATTERN").alias("detection_type"), F.lit(None).cast("double").alias("entropy"),
        F.lit(0).alias("det_rank"), "rule_idx", "pos",
    )
