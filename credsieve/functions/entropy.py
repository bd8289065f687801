"""Shannon entropy of characters as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.regex import char_class

HEX_CHARS = "0123456789abcdefABCDEF"
BASE64_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
HEX = char_class(HEX_CHARS)
BASE64 = char_class(BASE64_CHARS)

# two sums of the same terms may differ in the last bits
EPSILON = 1e-9


def _bits(text: Column, symbols: Callable[[Column], Column]) -> Column:
    """Sum of -p log2 p over ``symbols``; a symbol that does not occur adds nothing.

    The lambdas give the text and the shares names: written out, a text that is cleaned
    first would be cleaned again several times for every symbol.
    """

    def bits(text: Column) -> Column:
        total = F.length(text)
        shares = F.transform(symbols(text), lambda s: (total - F.length(F.replace(text, s, F.lit("")))) / total)
        added = F.aggregate(
            shares, F.lit(0.0), lambda acc, share: F.when(share > 0, acc - share * F.log2(share)).otherwise(acc)
        )
        return F.when(total > 0, added).otherwise(F.lit(0.0))

    return F.element_at(F.transform(F.array(text), bits), 1)


def shannon_entropy(text: Column) -> Column:
    """Bits per character of any text; 0 for the empty one."""
    return _bits(text, lambda t: F.array_distinct(F.split(t, "")))


def alphabet_entropy(text: Column, alphabet: str) -> Column:
    """The same for text known to use ``alphabet`` only.

    Counts each symbol of the alphabet instead of splitting the text into
    characters, so a token of megabytes needs no array of its characters.
    """
    return _bits(text, lambda _: F.split(F.lit(alphabet), ""))


def hex_entropy(text: Column) -> Column:
    """Entropy over the hex characters of ``text`` alone."""
    return shannon_entropy(F.regexp_replace(text, "[^0-9a-fA-F]+", ""))


def base64_entropy(text: Column) -> Column:
    """Entropy over the base64 characters of ``text`` alone."""
    return shannon_entropy(F.regexp_replace(text, "[^A-Za-z0-9+/=_-]+", ""))


def encoding_class(token: Column) -> Column:
    """``hex``, ``base64`` or ``unknown``; the empty token counts as hex."""
    return (
        F.when(token.rlike(r"\A[0-9a-fA-F]*\z"), F.lit("hex"))
        .when(token.rlike(r"\A[A-Za-z0-9+/=_-]*\z"), F.lit("base64"))
        .otherwise(F.lit("unknown"))
    )
