"""Shell-style globs as Java regular expressions.

``*`` also crosses ``/``, matching is case-sensitive and covers the whole name,
so ``vendor/*`` only speaks about a top-level directory.
"""

from __future__ import annotations

from collections.abc import Iterable
from fnmatch import translate

from credsieve.functions.regex import to_java


def globs_to_regex(globs: Iterable[str]) -> str:
    """One regex that matches the names matched by any of the globs."""
    return to_java(r"\A(?:" + "|".join(translate(glob) for glob in globs) + ")")
