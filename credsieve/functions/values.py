"""Is a captured value plausible as a secret?"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.regex import SPACE, to_java
from credsieve.functions.text import count_of, strip

# Whole values (lower-cased) that are never secrets.
STOP_VALUES = [
    "", "true", "false", "null", "none", "nil", "undefined", "nan", "todo", "fixme", "change_me", "changeme",
    "replace_me", "placeholder", "example", "test", "dummy", "sample", "your_api_key_here", "your-api-key-here",
    "insert_here", "xxx", "yyy", "zzz", "abc", "abcdef", "foobar", "foo", "bar", "password", "secret", "token",
    "passw0rd", "value", "val", "values", "string", "text", "var", "variable", "lambda", "function", "func",
    "callback", "handler", "latest", "stable", "nightly", "write", "read", "all", "root", "nobody", "required",
    "optional", "needed", "needed.", "default",
]

# Lower-cased starts of placeholders, lookups and type names; one per line
# because two of them end in a space.
FALSE_STARTS = [
    "your-", "your_", "my-", "my_", "<", "${", "%(", "{{",
    "example", "test", "dummy", "sample", "fake", "mock", "lambda", "func",
    "os.getenv", "os.environ", "process.env", "sys.getenv", "system.getenv",
    "std::env::var", "std::env::var_os", "env::var", "env::var_os", "os.lookupenv",
    "environment.getenvironmentvariable",
    "env(", "getenv(", "config(", "config.", "dotenv(", "settings.", "params.", "cfg.", "conf.",
    "options.", "opts.", "props.", "properties.", "self.", "this.", "request.", "update.",
    "ctx.", "context.", "auth.", "str(", "int(", "bool(", "dict(", "list(", "set(",
    "&str", "&[", "option<", "some(", "vec<", "box<", "arc<", "rc<", "string>", "result<",
    "hashmap<", "...", "your ", "insert ",
]

# Lower-cased ends of the same kind.
FALSE_ENDS = [">", "}", ")", "...", "here", "_test", "-test", ">()", ">>", ">();"]

# Starts of sentences.
ARTICLES = ["the ", "a ", "an ", "this ", "that "]

_CODE_CHARS = "<>(){}|&;"


def _any_of(texts: Iterable[str]) -> str:
    return "|".join("".join(f"\\x{{{ord(c):x}}}" if not c.isalnum() else c for c in t) for t in texts)


def _digit_class() -> str:
    """Characters str.isdigit() accepts: decimal digits and digit-like numbers."""
    extra = [c for c in range(0x80, 0x1F200)
             if chr(c).isdigit() and unicodedata.category(chr(c)) != "Nd"]
    return r"\p{Nd}" + "".join(f"\\x{{{c:x}}}" for c in extra)


_DIGITS_ONLY = rf"\A[:-]*[{_digit_class()}][{_digit_class()}:-]*\z"
_START = rf"\A(?:{_any_of(FALSE_STARTS + ARTICLES)})"
_END = rf"(?:{_any_of(FALSE_ENDS)})\z"
_THREE_WORDS = rf"[^{SPACE}][{SPACE}]+[^{SPACE}]+[{SPACE}]+[^{SPACE}]"


def is_valid_secret(
    value: Column, min_length: int = 4, extra_stop_values: Iterable[str] = ()
) -> Column:
    """True unless the value is too short, a placeholder, a lookup, a plain URL,
    a number, one repeated character, code or a sentence."""
    v = F.btrim(strip(value), F.lit("'\"` "))
    low = F.lower(v)
    stops = sorted({*STOP_VALUES, *(s.lower() for s in extra_stop_values)})
    plain_url = low.rlike(r"\Ahttps?://") & ~F.contains(low, F.lit("@"))
    one_char = F.replace(v, F.substring(v, 1, 1), F.lit("")) == ""
    return (
        (F.length(v) >= min_length)
        & ~low.isin(stops)
        & ~low.rlike(_START)
        & ~low.rlike(_END)
        & ~plain_url
        & ~v.rlike(_DIGITS_ONLY)
        & ~one_char
        & (count_of(v, _CODE_CHARS) < 2)
        & ~v.rlike(_THREE_WORDS)
    )


# Lines that are structure, not configuration (Python dialect, on the
# stripped line; the signature test is a search, the others look at the start).
COMMENT_LINE = r"^(?://|#|--|/\*|\*|;|%|<!--)"
SIGNATURE_LINE = (
    r"(?i)(?:\bfn\s+\w+\s*\(|\bfunc\s+[\w(]|\bdef\s+\w+\s*\(|\bfunction\s+\w+\s*\("
    r"|\b(?:public|private|protected|static|async|override|virtual)\s+"
    r"|\)\s*->\s*|\)\s*:\s*\w+)"
)
IMPORT_LINE = r"(?i)^(?:import\s|from\s|use\s|require\s|include\s|#include\s)"
TYPE_LINE = r"(?i)^(?:struct\s|class\s|type\s|interface\s|enum\s|trait\s|impl\s)"


def is_noise_line(line: Column) -> Column:
    """True for blank lines, comments, signatures, imports and type definitions."""
    bare = strip(line)
    noise = bare == ""
    for pattern in (COMMENT_LINE, IMPORT_LINE, TYPE_LINE, SIGNATURE_LINE):
        noise = noise | bare.rlike(to_java(pattern))
    return noise
