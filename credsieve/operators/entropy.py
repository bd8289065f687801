"""Tokens of unusually high entropy."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.entropy import (
    BASE64,
    BASE64_CHARS,
    EPSILON,
    HEX,
    HEX_CHARS,
    alphabet_entropy,
)
from credsieve.functions.regex import SPACE
from credsieve.functions.text import halves, numbered_lines, pair
from credsieve.options import ScanOptions

_MIN_HEX = 8
_MIN_BASE64 = 12
# an address counts for a token if it starts at most this far before it on the line
_LOOK_BACK = 60
_STOP = rf"[^{SPACE}'\"<>]"


def _shortest(threshold: float, least: int) -> int:
    """n characters have at most log2(n) bits each, so shorter tokens cannot qualify."""
    return max(least, math.ceil(2 ** (threshold - EPSILON)))


def base64_size(options: ScanOptions) -> int:
    """Length below which no base64 token qualifies."""
    return _shortest(options.base64_threshold, _MIN_BASE64)


def hex_pattern(options: ScanOptions) -> str:
    """Finds text that holds a hex token long enough for its threshold."""
    return f"{HEX}{{{_shortest(options.hex_threshold, _MIN_HEX)}}}"


def base64_pattern(options: ScanOptions) -> str:
    """The same for base64 tokens; tried at the start of a run only."""
    return f"(?<!{BASE64}){BASE64}{{{base64_size(options)}}}"


def token_pattern(options: ScanOptions) -> str:
    return f"{hex_pattern(options)}|{base64_pattern(options)}"


def token_lines(text: Column, options: ScanOptions) -> Column:
    """Lines that may hold a token: array of (line_number, line)."""
    return F.filter(numbered_lines(text), lambda row: row["line"].rlike(token_pattern(options)))


def line_runs(line: Column, options: ScanOptions) -> Column:
    """Distinct maximal runs of base64 characters: array of (head, run, pos).

    ``head`` is the start of an address that leads without a break up to the run,
    '' if there is none.  The bound in the pattern is loose (UTF-16 units); the
    exact look-back is tested on the length of the head.
    """
    head = rf"((?iu:https?:)(?=//)|(?iu:https?://){_STOP}{{0,{2 * _LOOK_BACK}}})"
    run = (
        rf"(?<!{BASE64})(?={BASE64}{{{base64_size(options)}}}|{BASE64}*?{hex_pattern(options)})"
        rf"(?:(?<={head})|)({BASE64}+)"
    )
    found = F.zip_with(
        F.regexp_extract_all(line, F.lit(run), F.lit(1)),
        F.regexp_extract_all(line, F.lit(run), F.lit(2)),
        pair,
    )

    def parts(joined: Column, i: Column) -> Column:
        start, characters = halves(joined)
        return F.struct(start.alias("head"), characters.alias("run"), i.alias("pos"))

    return F.transform(F.array_distinct(found), parts)


def _path_or_slug(token: Column) -> Column:
    size = F.length(token)
    slashes = size - F.length(F.replace(token, F.lit("/"), F.lit("")))
    dashes = size - F.length(F.replace(token, F.lit("-"), F.lit("")))
    return (slashes >= 2) | (dashes >= 2)


def base64_bits(head: Column, run: Column, options: ScanOptions) -> Column:
    """Entropy of the run if it qualifies as a base64 token, else null."""
    in_address = (head != "") & (F.length(head) <= _LOOK_BACK)
    bits = alphabet_entropy(run, BASE64_CHARS)
    return F.when(
        (F.length(run) >= _MIN_BASE64)
        & run.rlike(rf"[^{HEX_CHARS}]")
        & ~in_address
        & ~_path_or_slug(run)
        & (bits >= options.base64_threshold - EPSILON),
        bits,
    )


def hex_tokens(head: Column, run: Column, options: ScanOptions) -> Column:
    """Qualifying hex tokens of a run: array of (bits, size, token).

    The head is replaced by one of the same length without hex digits, so that one
    pattern with a bounded look-behind can leave out tokens inside the address.
    """
    blank_head = (
        F.when(F.length(head) > 6, F.rpad(F.lit("http://"), F.length(head), F.lit("x")))
        .when(head == "", F.lit(""))
        .otherwise(head)
    )
    near_address = (
        rf"(?:(?iu:http)://{_STOP}{{0,{_LOOK_BACK - 7}}}|(?iu:https)://{_STOP}{{0,{_LOOK_BACK - 8}}})"
    )
    # the look-behind over many characters comes after the cheap tests
    token = rf"(?<!{HEX})(?={HEX}{{{_MIN_HEX}}})(?<!{near_address}){HEX}+"
    found = F.regexp_extract_all(F.concat(blank_head, run), F.lit(token), F.lit(0))
    measured = F.transform(
        found,
        lambda t: F.struct(
            alphabet_entropy(t, HEX_CHARS).alias("bits"),
            F.length(t).alias("size"),
            t.alias("token"),
        ),
    )
    return F.filter(measured, lambda t: t["bits"] >= options.hex_threshold - EPSILON)


def run_tokens(bits: Column, hexes: Column, run: Column) -> Column:
    """What is reported of a run: array of (encoding, bits, token).

    Hex tokens of one run never overlap each other, so the base64 token either beats
    the best of them by (entropy, length) and stands for the run, or all of them stay.
    """
    best_hex = F.array_max(F.transform(hexes, lambda t: F.struct(t["bits"], t["size"])))
    wins = bits.isNotNull() & (best_hex.isNull() | (F.struct(bits, F.length(run)) > best_hex))
    return F.when(
        wins,
        F.array(F.struct(F.lit("base64").alias("encoding"), bits.alias("bits"), run.alias("token"))),
    ).otherwise(
        F.transform(
            hexes,
            lambda t: F.struct(
                F.lit("hex").alias("encoding"), t["bits"].alias("bits"), t["token"].alias("token")
            ),
        )
    )
