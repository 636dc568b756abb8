"""The literals that patterns cannot do without, so that a regular expression is tried only on lines that hold one of its own.

Literals are compared in folded text, in which letters are lower case; whatever a pattern that ignores case can match
holds its literals there. Lines that hold them need not match, but no other line does. The comparisons are plain
columns, so they run within the generated code that splits a file into lines.
"""

from __future__ import annotations

import re
import warnings
from functools import reduce
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds on the strings that a part of a pattern is spelled out in, and on the members of a class that is.
MAX_STRINGS, MAX_CLASS = 64, 4
#: Strings that are looked for one by one; more make the generated code too large and are one regular expression.
MAX_TESTS = 32
#: Letters beyond ASCII that match ASCII ones where case is ignored.
FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}

Strings = frozenset[str]
EMPTY: Strings = frozenset([""])


def better(a: Strings | None, b: Strings | None) -> Strings | None:
    """Of two sets of which one string each must occur, the one whose shortest is longer, then the smaller one."""
    found = [s for s in (a, b) if s and min(map(len, s))]
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _items(items, ignore_case: bool) -> tuple[Strings | None, Strings | None]:
    """Of a sequence: all strings it can match, if few, else None; and strings of which it must hold one, if known."""
    best, run, whole = None, EMPTY, True
    for op, arg in items:
        exact, must = _item(op, arg, ignore_case)
        if exact is not None and len(run) * len(exact) <= MAX_STRINGS:
            run = frozenset(a + b for a in run for b in exact)
            continue
        best, whole = better(better(best, run), must), False
        run = EMPTY if exact is None else exact
    return (run if whole else None), better(best, run)


def _item(op, arg, ignore_case: bool) -> tuple[Strings | None, Strings | None]:
    if op is C.LITERAL:
        c = chr(arg)
        # Other letters may have several lower cases or change in number; escapes for control characters differ by engine.
        exact = None if c < " " else frozenset([c.lower()]) if c.isascii() else frozenset([c]) if not ignore_case and ord(c) not in FOLDED and c.lower() == c else None
        return exact, exact
    if op is C.IN and len(arg) <= MAX_CLASS and all(o is C.LITERAL for o, _ in arg):
        each = [_item(o, a, ignore_case)[0] for o, a in arg]
        exact = None if None in each else frozenset().union(*each)
        return exact, exact
    if op is C.SUBPATTERN:
        return _items(arg[3], ignore_case or bool(arg[1] & re.IGNORECASE))
    if op is C.BRANCH:
        arms = [_items(a, ignore_case) for a in arg[1]]
        exact = None if any(e is None for e, _ in arms) else frozenset().union(*(e for e, _ in arms))
        must = None if any(m is None for _, m in arms) else frozenset().union(*(m for _, m in arms))
        return (exact if exact is None or len(exact) <= MAX_STRINGS else None), must
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = arg
        exact, must = _items(inner, ignore_case)
        if most == 1 and exact is not None:
            return (exact if least else exact | EMPTY), (must if least else None)
        return None, (must if least else None)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return EMPTY, None
    return None, None


def required(pattern: str) -> Strings | None:
    """Folded strings of which every match's text holds at least one; None if the pattern gives none or is not understood."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError, Warning):
        return None
    return _items(parsed, bool(parsed.state.flags & re.IGNORECASE))[1]


def folded(text: Column) -> Column:
    """Text as the strings of ``required`` are written. ASCII text needs no look at single letters."""
    special = F.translate(text, "".join(map(chr, FOLDED)), "".join(FOLDED.values()))
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(special))


def holds(low: Column, strings: Strings | None) -> Column:
    """Whether folded text may match what needs one of the strings; always, if none are known."""
    if strings is None:
        return F.lit(True)
    if len(strings) > MAX_TESTS:
        return low.rlike("|".join(re.escape(s) for s in sorted(strings)))
    return reduce(lambda a, b: a | b, [low.contains(s) for s in sorted(strings)])
