"""Column helpers for text, lines and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.regex import LINE_BREAK, SPACE_CHARS

# letters whose case folding leaves ASCII, so that lower() is no superset of ignore-case
FOLDING_LETTERS = ["\u0130", "\u0131", "\u017f", "\u212a"]


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends (``trim`` knows the space only)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def drop_line_end(line: Column) -> Column:
    """Remove trailing carriage returns and newlines."""
    return F.rtrim(line, F.lit("\r\n"))


def numbered_lines(text: Column) -> Column:
    """Lines as ended by ``\\n``: array of (line_number, line), CR removed at the end."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda line, i: F.struct(
            (i + 1).alias("line_number"), drop_line_end(line).alias("line")
        ),
    )


def numbered_universal_lines(text: Column) -> Column:
    """Lines as ended by any Unicode line break: array of (line_number, line)."""
    return F.transform(
        F.split(text, LINE_BREAK, -1),
        lambda line, i: F.struct((i + 1).alias("line_number"), line.alias("line")),
    )


def normal_path(path: Column) -> Column:
    """Path with forward slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    """Part after the last slash of a normal path."""
    return F.substring_index(path, "/", -1)


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def sql_text(value: str) -> str:
    """A string as SQL, whatever it holds; the optimizer folds it into a literal."""
    if value.isprintable() and "'" not in value and "\\" not in value:
        return f"'{value}'"
    return f"cast(X'{value.encode().hex()}' AS STRING)"


def text_array(values: list[str]) -> Column:
    """A constant array.  As SQL it is one call into the JVM instead of one per element."""
    return F.expr("array(" + ", ".join(map(sql_text, values)) + ")")


def contains_any(text: Column, needles: list[str]) -> Column:
    """True if one of the literals occurs."""
    if len(needles) == 1:
        return F.contains(text, F.lit(needles[0]))
    return F.exists(text_array(needles), lambda needle: F.contains(text, needle))


def contains_any_case(text: Column, needles: list[str]) -> Column:
    """The same without regard to case.

    A lambda over one element gives the lowered text a name; written out, it would be
    lowered again for every literal.
    """
    lowered = [needle.lower() for needle in needles]
    return F.exists(F.array(F.lower(text)), lambda low: contains_any(low, lowered)) | contains_any(
        text, FOLDING_LETTERS
    )


def pair(first: Column, second: Column) -> Column:
    """Two strings as one.  Arrays of strings are made distinct by hashing, arrays of
    structs by comparing all pairs."""
    return F.concat(F.length(first).cast("string"), F.lit(":"), first, second)


def halves(joined: Column) -> tuple[Column, Column]:
    """The two strings of a :func:`pair`."""
    size = F.substring_index(joined, ":", 1)
    start = F.length(size) + 2
    length = size.cast("int")
    return F.substr(joined, start, length), F.substr(joined, start + length)
