"""Assignments of values to suspicious keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.regex import to_java
from credsieve.functions.text import (
    contains_any,
    contains_any_case,
    halves,
    numbered_universal_lines,
    pair,
    strip,
)
from credsieve.options import ScanOptions

# The assignment forms in the order they are tried (Python dialect).
# Groups: 1 keyword, 2 quote, 3 quoted value, 4 unquoted value.
_QUOTED = r"""(['"])([^'"\n]{1,200})\2"""
FORMS = [
    ("colon/json", r"""['"](KEYWORD)['"]\s*:\s*QUOTED()"""),
    ("export", r"""export\s+(KEYWORD)\s*=\s*(?:QUOTED|([^'"\s;#][^\s;#]{0,200}))"""),
    ("arrow", r"""['"]?(KEYWORD)['"]?\s*=>\s*(?:QUOTED|([^'"\s,;#][^\s,;#]{0,200}))"""),
    (
        "equals",
        r"""(?:^|[\s._-])(KEYWORD)\s*[=:]\s*(?:QUOTED|([^'"\s,;#][^'"\n]{0,200}))""",
    ),
]


def form_patterns(options: ScanOptions) -> list[str]:
    """Java patterns of the four forms for the configured keywords."""
    words = "|".join(re.escape(word) for word in options.keywords)
    return [
        to_java(
            form.replace("QUOTED", _QUOTED).replace("KEYWORD", words),
            not options.keyword_case_sensitive,
        )
        for _, form in FORMS
    ]


def keyword_stems(options: ScanOptions) -> list[str]:
    """Shortest set of literals of which every keyword holds one."""
    words = {w if options.keyword_case_sensitive else w.lower() for w in options.keywords}
    return sorted(w for w in words if not any(o != w and o in w for o in words))


def keyword_gate(text: Column, options: ScanOptions) -> Column:
    """False only for text that holds no keyword or no assignment sign."""
    contains = contains_any if options.keyword_case_sensitive else contains_any_case
    return contains_any(text, ["=", ":"]) & contains(text, keyword_stems(options))


def keyword_lines(text: Column, options: ScanOptions) -> Column:
    """Lines that may hold an assignment: array of (line_number, line)."""
    return F.filter(
        numbered_universal_lines(text),
        lambda row: keyword_gate(row["line"], options),
    )


def _value(quote: Column, quoted: Column, unquoted: Column) -> Column:
    """A quoted value is only stripped; an unquoted one also loses a trailing comment."""
    bare = F.substring_index(F.substring_index(strip(unquoted), "#", 1), "//", 1)
    bare = F.rtrim(strip(bare), F.lit("'\"`,;"))
    return F.when(quote != "", strip(quoted)).otherwise(bare)


def line_assignments(line: Column, options: ScanOptions) -> Column:
    """Array of (form, pos, keyword, value) for one line."""

    # what a line must hold before the pattern of a form is tried on it
    signs = [
        contains_any(line, [":"]),
        contains_any_case(line, ["export"]),
        contains_any(line, ["=>"]),
        contains_any(line, ["=", ":"]),
    ]
    nothing = F.array().cast("array<struct<form:int,pos:int,keyword:string,value:string>>")

    def matches(form: int, pattern: str) -> Column:
        groups = [F.regexp_extract_all(line, F.lit(pattern), F.lit(g)) for g in (1, 2, 3, 4)]
        found = F.transform(
            F.arrays_zip(*groups), lambda g: pair(g["0"], _value(g["1"], g["2"], g["3"]))
        )

        def assignment(joined: Column, i: Column) -> Column:
            keyword, value = halves(joined)
            return F.struct(
                F.lit(form).alias("form"),
                i.alias("pos"),
                keyword.alias("keyword"),
                value.alias("value"),
            )

        # repeats on a line go before each of them is given its line
        found = F.transform(F.array_distinct(found), assignment)
        return F.when(signs[form] & line.rlike(pattern), found).otherwise(nothing)

    return F.concat(*[matches(i, p) for i, p in enumerate(form_patterns(options))])
