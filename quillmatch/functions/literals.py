"""What a text must hold for a regular expression to match it: literals, or a digit, that are looked for before the expression is tried.

An expression is parsed; of a sequence, its most selective part counts, of alternatives all. Only ASCII literals and
characters without case are used, so lower case decides as the expression does, but for four
characters that ignoring case equates with ASCII letters; texts with one of these
are always tried.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 5  # literals of one expression; each is a search of its own
ALIKE = {"i": "İı", "s": "ſ", "k": "K"}


def _usable(ch: str) -> bool:
    return ch.isascii() or ch.lower() == ch.upper()


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The more selective of two sets: by the shortest literal, then by fewer ones; one of too many is none."""
    a, b = (x if x and len(x) <= MOST else None for x in (a, b))
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _of(items: object) -> frozenset[str] | None:
    best, run = None, ""
    for kind, value in items:
        if kind is op.LITERAL and _usable(chr(value)):
            run += chr(value).lower()
            continue
        if run:
            best, run = _better(best, frozenset([run])), ""
        found = None
        if kind is op.SUBPATTERN:
            found = _of(value[-1])
        elif kind is op.ATOMIC_GROUP:
            found = _of(value)
        elif kind is op.BRANCH:
            each = [_of(x) for x in value[1]]
            found = frozenset().union(*each) if all(each) else None
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] >= 1:
            one = list(value[2])
            found = frozenset([chr(one[0][1]).lower() * min(value[0], 8)]) if len(one) == 1 and one[0][0] is op.LITERAL and _usable(chr(one[0][1])) else _of(one)
        elif kind is op.IN and all(k is op.LITERAL and _usable(chr(v)) for k, v in value):
            found = frozenset(chr(v).lower() for _, v in value)
        best = _better(best, found)
    return _better(best, frozenset([run])) if run else best


@lru_cache(maxsize=1024)
def required(pattern: str) -> tuple[str, ...] | None:
    """Literals in lower case of which any match holds one; None if there are none, too many, or the syntax is another, and if the expression starts where the text does, which is as quick to try."""
    try:
        items = parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError):
        return None
    found = None if len(items) and items[0] == (op.AT, op.AT_BEGINNING) else _better(_of(items), None)
    return tuple(sorted(found)) if found and len(found) <= MOST else None


def alternatives(pattern: str) -> list[str]:
    """An expression as those that its outermost bars part; one of them matches where it does. Inline flags hold for all, so it stays whole with them."""
    parts, depth, inside, at = [""], 0, False, 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\":
            parts[-1] += pattern[at : at + 2]
            at += 2
            continue
        if inside:
            inside = ch != "]"
        elif ch == "[":
            inside = True
            if pattern[at + 1 : at + 2] in ("]", "^"):  # a bracket may come first
                parts[-1] += ch
                at += 1
                ch = pattern[at]
                if ch == "^" and pattern[at + 1 : at + 2] == "]":
                    parts[-1] += ch
                    at += 1
                    ch = "]"
        else:
            depth += (ch == "(") - (ch == ")")
            if ch == "|" and depth == 0:
                parts.append("")
                at += 1
                continue
        parts[-1] += ch
        at += 1
    return [pattern] if "(?" in pattern.replace("(?:", "") or "\\Q" in pattern or re.search(r"\\[1-9k]", pattern) else parts


def _digit(items: object) -> bool:
    """Whether any match holds a digit."""
    for kind, value in items:
        if kind is op.IN and list(value) == [(op.CATEGORY, op.CATEGORY_DIGIT)]:
            return True
        if (kind is op.SUBPATTERN and _digit(value[-1])) or (kind is op.BRANCH and all(map(_digit, value[1]))) or (kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1 and _digit(value[2])):
            return True
    return False


@lru_cache(maxsize=1024)
def needs_digit(pattern: str) -> bool:
    try:
        items = parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError):
        return False
    return not (len(items) and items[0] == (op.AT, op.AT_BEGINNING)) and _digit(items)


def matches(c: Column, pattern: str, flags: str, low: Column | None = None) -> Column:
    """``c.rlike(flags + pattern)``, tried only on texts that hold what it needs."""
    out = []
    for p in alternatives(pattern):
        test, literals = c.rlike(flags + p), required(p)
        if needs_digit(p):
            test = c.rlike(r"\p{Nd}") & test
        out.append(test if literals is None else hopeful(c, literals, low) & test)
    return reduce(lambda a, b: a | b, out)


def hopeful(c: Column, literals: tuple[str, ...], low: Column | None = None) -> Column:
    """Whether a text (in lower case ``low``) holds one of ``literals``, or what may be taken for one."""
    low = F.lower(c) if low is None else low
    letters = "".join(literals)
    odd = "".join(v for k, v in ALIKE.items() if k in letters)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in literals] + [F.contains(c, F.lit(ch)) for ch in odd])
