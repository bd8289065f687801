"""Python regular expressions as Java ones.

Rules are written in Python's dialect, Spark runs Java's.  The two differ where
it matters for scanning: ``\\s \\w \\d \\b`` are Unicode-aware in Python only,
``$`` and ``.`` treat line ends differently, and ignore-case folds beyond ASCII.
:func:`to_java` walks the parsed expression and writes every construct out
explicitly, so no Java flag other than ignore-case is needed.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parser

# The parser is that of the standard library of Python 3.11 to 3.14, which names its parts
# alike; another version that does not fails here and not in a scan.
_ = (sre.LITERAL, sre.IN, sre.BRANCH, sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT, sre.ATOMIC_GROUP,
     sre.SUBPATTERN, sre.GROUPREF, sre.ASSERT, sre.ASSERT_NOT, sre.AT, sre.ANY, sre.FAILURE, sre.MAXREPEAT)
if [op for op, _arg in sre_parser.parse(r"a[b](c|de)\b")] != [sre.LITERAL, sre.LITERAL, sre.SUBPATTERN, sre.AT]:
    raise ImportError("the regular expression parser of this Python is not known")

# str.isspace() as the inside of a character class
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# the same characters as a plain string, for btrim
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# str.splitlines()
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

_WORD = r"\p{L}\p{N}_"
_DIGIT = r"\p{Nd}"
_CLASSES = {
    "SPACE": (SPACE, r"\t-\r\x20"),
    "DIGIT": (_DIGIT, "0-9"),
    "WORD": (_WORD, "a-zA-Z0-9_"),
}


class Untranslatable(ValueError):
    """The expression is valid Python but has no exact Java form."""


@lru_cache(maxsize=4096)
def to_java(pattern: str, ignore_case: bool = False) -> str:
    """Java form of a Python pattern; ``re.error`` if it is no valid pattern."""
    tree = sre_parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
    flags = tree.state.flags
    if flags & re.LOCALE:
        raise Untranslatable("locale flag")
    body = _sequence(tree, flags)
    if flags & re.IGNORECASE:
        return ("(?i)" if flags & re.ASCII else "(?iu)") + body
    return body


def char_class(chars: str) -> str:
    """Class of the given characters."""
    return "[" + "".join(_char(ord(c)) for c in chars) + "]"


def _char(code: int) -> str:
    ch = chr(code)
    if ch.isascii() and (ch.isalnum() or ch in "_ "):
        return ch
    if ch.isascii() and ch.isprintable():
        return "\\" + ch
    return f"\\x{{{code:x}}}"


def _category(name, flags: int) -> str:
    """Inside of a class, possibly a nested one, for \\s \\d \\w and their negations."""
    text = str(name)
    inside = _CLASSES[text.rsplit("_", 1)[-1]][1 if flags & re.ASCII else 0]
    return f"[^{inside}]" if "_NOT_" in text else inside


def _klass(items, flags: int) -> str:
    negate, parts = "", []
    for op, arg in items:
        if op is sre.NEGATE:
            negate = "^"
        elif op is sre.LITERAL:
            parts.append(_char(arg))
        elif op is sre.RANGE and arg[1] < 128:
            # Java tests listed ASCII characters by one table look-up, ranges one by one
            parts.extend(_char(code) for code in range(arg[0], arg[1] + 1))
        elif op is sre.RANGE:
            parts.append(f"{_char(arg[0])}-{_char(arg[1])}")
        elif op is sre.CATEGORY:
            parts.append(_category(arg, flags))
        else:
            raise Untranslatable(str(op))
    inside = "".join(parts)
    # a negated class holding a nested one is written as the negation of the union
    return f"[^[{inside}]]" if negate and "[" in inside else f"[{negate}{inside}]"


def _boundary(negated: bool, flags: int) -> str:
    word = _CLASSES["WORD"][1 if flags & re.ASCII else 0]
    if negated:
        return f"(?:(?<=[{word}])(?=[{word}])|(?<![{word}])(?![{word}]))"
    return f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"


def _anchor(where, flags: int) -> str:
    if where is sre.AT_BEGINNING:
        return r"(?<![^\n])" if flags & re.MULTILINE else r"\A"
    if where is sre.AT_END:
        return r"(?![^\n])" if flags & re.MULTILINE else r"(?=\n?\z)"
    if where is sre.AT_BEGINNING_STRING:
        return r"\A"
    if where is sre.AT_END_STRING:
        return r"\z"
    if where is sre.AT_BOUNDARY:
        return _boundary(False, flags)
    if where is sre.AT_NON_BOUNDARY:
        return _boundary(True, flags)
    raise Untranslatable(str(where))


_REPEATS = {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}


def _repeat(op, arg, flags: int) -> str:
    low, high, item = arg
    body = _sequence(item, flags)
    single = len(item) == 1 and item[0][0] in (sre.IN, sre.LITERAL, sre.NOT_LITERAL, sre.ANY)
    if not single:
        body = f"(?:{body})"
    if high is sre.MAXREPEAT:
        count = {0: "*", 1: "+"}.get(int(low), f"{{{low},}}")
    elif (low, high) == (0, 1):
        count = "?"
    elif low == high:
        count = f"{{{low}}}"
    else:
        count = f"{{{low},{high}}}"
    return body + count + _REPEATS[op]


def _group(arg, flags: int) -> str:
    index, add, drop, item = arg
    inner = (flags | add) & ~drop
    if (add | drop) & (re.ASCII | re.LOCALE):
        raise Untranslatable("scoped character-set flag")
    body = _sequence(item, inner)
    if add & re.IGNORECASE:
        body = f"(?iu:{body})"
    elif drop & re.IGNORECASE:
        body = f"(?-iu:{body})"
    return f"(?:{body})" if index is None else f"({body})"


def _look(arg, flags: int, negated: bool) -> str:
    direction, item = arg
    head = "(?" + ("<" if direction < 0 else "") + ("!" if negated else "=")
    return f"{head}{_sequence(item, flags)})"


def _sequence(items, flags: int) -> str:
    out, items = [], list(items)
    for i, (op, arg) in enumerate(items):
        if op is sre.AT and arg is sre.AT_BOUNDARY and _starts_word(items[i + 1 :]):
            # a word starts here: only what stands before it needs a look
            word = _CLASSES["WORD"][1 if flags & re.ASCII else 0]
            out.append(f"(?<![{word}])")
        else:
            out.append(_node(op, arg, flags))
    return "".join(out)


def _starts_word(items) -> bool:
    """True if the first character can only be a letter, a digit or an underscore."""
    if not items:
        return False
    op, arg = items[0]
    if op is sre.LITERAL:
        return chr(arg).isalnum() or arg == ord("_")
    if op is sre.BRANCH:
        return all(_starts_word(list(branch)) for branch in arg[1])
    return op is sre.SUBPATTERN and _starts_word(list(arg[-1]))


def _node(op, arg, flags: int) -> str:
    if op is sre.LITERAL:
        return _char(arg)
    if op is sre.NOT_LITERAL:
        return f"[^{_char(arg)}]"
    if op is sre.ANY:
        return r"[\x{0}-\x{10ffff}]" if flags & re.DOTALL else r"[^\n]"
    if op is sre.IN:
        return _klass(arg, flags)
    if op is sre.BRANCH:
        return "(?:" + "|".join(_sequence(branch, flags) for branch in arg[1]) + ")"
    if op in _REPEATS:
        return _repeat(op, arg, flags)
    if op is sre.SUBPATTERN:
        return _group(arg, flags)
    if op is sre.ATOMIC_GROUP:
        return f"(?>{_sequence(arg, flags)})"
    if op is sre.GROUPREF:
        return f"(?:\\{arg})"
    if op in (sre.ASSERT, sre.ASSERT_NOT):
        return _look(arg, flags, op is sre.ASSERT_NOT)
    if op is sre.AT:
        return _anchor(arg, flags)
    if op is sre.FAILURE:
        return "(?!)"
    raise Untranslatable(str(op))


# ---------------------------------------------------------------------------------
# What every match of a pattern is known to hold
# ---------------------------------------------------------------------------------

_BREAK = (0, 0, 0, False)  # longest run, run at the start, run at the end, nothing but run


def guaranteed_run(pattern: str, chars: str) -> int:
    """Every match holds at least this many of ``chars`` in a row (0 = nothing known)."""
    tree = sre_parser.parse(pattern)
    return _run_of(tree, tree.state.flags, frozenset(map(ord, chars)))[0]


def stays_in_run(pattern: str, chars: str) -> bool:
    """Every match is one run of ``chars``, and only ``chars`` next to it can prevent one.

    Such a pattern matches in a text if and only if it matches in the maximal runs of
    the text, written one after the other with blanks between them.
    """
    tree = sre_parser.parse(pattern)
    codes = frozenset(map(ord, chars))
    return _run_of(tree, tree.state.flags, codes)[3] and _sees_run_only(tree, codes)


def _sees_run_only(items, chars: frozenset[int]) -> bool:
    for op, arg in items:
        if op is sre.ASSERT_NOT:
            if len(arg[1]) != 1 or arg[1][0][0] is not sre.IN:
                return False
            if not (_listed(arg[1][0][1]) or {-1}) <= chars:
                return False
        elif op in (sre.ASSERT, sre.AT, sre.GROUPREF):
            return False
        elif op is sre.BRANCH:
            if not all(_sees_run_only(branch, chars) for branch in arg[1]):
                return False
        elif op is sre.SUBPATTERN or op in _REPEATS:
            if not _sees_run_only(arg[-1], chars):
                return False
    return True


def _run_of(items, flags: int, chars: frozenset[int]):
    best, start, end, whole = 0, 0, 0, True
    for op, arg in items:
        b, s, e, w = _node_run(op, arg, flags, chars)
        best = max(best, b, end + s)
        start = start + s if whole else start
        end = end + e if w else e
        whole = whole and w
    return best, start, end, whole


def _node_run(op, arg, flags: int, chars: frozenset[int]):
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return (0, 0, 0, True)
    if op in (sre.LITERAL, sre.IN):
        codes = _listed([(op, arg)] if op is sre.LITERAL else arg)
        if flags & re.IGNORECASE and codes and codes & set(map(ord, "iksIKS")):
            return _BREAK  # may also match a letter beyond ASCII
        return (1, 1, 1, True) if codes and codes <= chars else _BREAK
    if op in _REPEATS:
        low, _, item = arg
        b, s, e, w = _run_of(item, flags, chars)
        if w:
            return (low * b, low * b, low * b, True)
        return (b, s, e, False) if low else _BREAK
    if op is sre.BRANCH:
        runs = [_run_of(branch, flags, chars) for branch in arg[1]]
        return (*(min(r[i] for r in runs) for i in range(3)), all(r[3] for r in runs))
    if op is sre.SUBPATTERN:
        _, add, drop, item = arg
        return _run_of(item, (flags | add) & ~drop, chars)
    if op is sre.ATOMIC_GROUP:
        return _run_of(arg, flags, chars)
    return _BREAK


def _listed(items) -> set[int] | None:
    codes: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            codes.add(arg)
        elif op is sre.RANGE and arg[1] < 128:
            codes.update(range(arg[0], arg[1] + 1))
        else:
            return None
    return codes


# ---------------------------------------------------------------------------------
# Strings of which every match holds one
# ---------------------------------------------------------------------------------

# Alternatives of one pattern that are told apart, further ones leave it unknown.
ALTERNATIVES = 32
# ASCII letters that ignoring case equates with letters beyond ASCII.
_FOLDED = frozenset("iks")


def required(pattern: str, ignore_case: bool = False) -> list[str]:
    """Every match holds one of these strings, A-Z in lower case (none = nothing known).

    The text is to be put into lower case the same way, A-Z only, before it is looked at.
    """
    tree = sre_parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
    return sorted(_needed(tree, tree.state.flags, {}) or ())


def _best(found: list[frozenset[str]]) -> frozenset[str] | None:
    """The set of alternatives whose shortest string is the longest."""
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _needed(items, flags: int, groups: dict[int, tuple]) -> frozenset[str] | None:
    """The best known set of alternatives; ``groups`` are those that stand before."""
    found: list[frozenset[str]] = []
    run = _Run()
    _collect(items, flags, run, found, groups)
    run.end(found)
    return _best(found)


class _Run:
    """Literal characters that stand next to each other in every match."""

    def __init__(self) -> None:
        self.text = ""

    def end(self, found: list[frozenset[str]]) -> None:
        if self.text:
            found.append(frozenset([self.text]))
        self.text = ""


def _collect(items, flags: int, run: _Run, found: list[frozenset[str]], groups: dict[int, tuple]) -> None:
    for op, arg in items:
        if op is sre.LITERAL:
            char = chr(arg).lower() if arg < 128 else chr(arg)
            if flags & re.IGNORECASE and (arg >= 128 or char in _FOLDED):
                run.end(found)
            else:
                run.text += char
        elif op is sre.SUBPATTERN:
            inside = (flags | arg[1]) & ~arg[2]
            _collect(arg[3], inside, run, found, groups)
            if arg[0] is not None:
                groups[arg[0]] = (arg[3], inside)
        elif op is sre.ATOMIC_GROUP:
            _collect(arg, flags, run, found, groups)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue  # takes no characters
        else:
            run.end(found)
            if op in _REPEATS and arg[0] > 0:
                alternatives = _needed(arg[2], flags, groups)
            elif op in _REPEATS:
                _needed(arg[2], flags, groups)  # for the groups in it
                alternatives = None
            elif op is sre.BRANCH:
                each = [_needed(branch, flags, groups) for branch in arg[1]]
                alternatives = frozenset().union(*each) if all(each) else None
            elif op is sre.GROUPREF_EXISTS and arg[2] is not None:
                # the first branch is taken if the group has matched, so its text is there too
                group = groups.get(arg[0])
                taken = [_needed(arg[1], flags, groups), _needed(*group, dict(groups)) if group else None]
                each = [_best([s for s in taken if s]), _needed(arg[2], flags, groups)]
                alternatives = frozenset().union(*each) if all(each) else None
            else:
                alternatives = None
            if alternatives and len(alternatives) <= ALTERNATIVES:
                found.append(alternatives)
