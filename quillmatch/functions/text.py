"""String functions on Columns: normal forms, regular expressions, similarity, confidence."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillmatch.functions.literals import matches

#: Flags that make a Java expression agree with Python's re.search: ignore case, Unicode case and classes, only \n ends a line.
FLAGS, CASED = "(?iuUd)", "(?uUd)"


#: Unicode white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def norm(c: Column) -> Column:
    return F.lower(strip(c))


def found(c: Column, pattern: str) -> Column:
    """Whether an expression matches somewhere; it is only tried on texts that hold what it needs."""
    return matches(c, pattern, FLAGS)


def any_found(c: Column, patterns: list[str]) -> Column:
    """Whether one of several matches. The text and its lower case are bound once, so that a filter, in which no expression is shared, doesn't make them for each literal."""
    if not patterns:
        return F.lit(False)
    return F.exists(F.array(F.struct(c.alias("s"), F.lower(c).alias("low"))), lambda x: reduce(lambda a, b: a | b, [matches(x["s"], p, FLAGS, x["low"]) for p in patterns]))


def group(c: Column, pattern: str, k: int) -> Column:
    """The text of a group of the first match; empty where the group took no part."""
    return F.regexp_extract(c, FLAGS + pattern, k)


def last_match(c: Column, pattern: str) -> Column:
    """The whole last match, or null."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), F.lit(-1))


def token_sorted(c: Column) -> Column:
    """Its tokens in order, joined by single spaces."""
    return F.array_join(F.array_sort(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")), " ")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (one big integer)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (len a + len b) of texts that are token-sorted already; two empty ones are equal."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).when(a == b, F.lit(100.0)).otherwise(200.0 * _lcs(a, b) / total)


def best_possible(a: Column, b: Column) -> Column:
    """A bound that ``indel_ratio`` doesn't exceed, from the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * F.least(F.length(a), F.length(b)) / total)


def visit_match(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if equal but for case, 0.5 if one holds the other, else 0."""
    x, y = F.lower(a), F.lower(b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).when(F.contains(x, y) | F.contains(y, x), F.lit(0.5)).otherwise(F.lit(0.0))


def confidence(score: Column) -> Column:
    return F.least(score / 100.0, F.lit(1.0))


def display_label(label: Column, form: Column, page: Column) -> Column:
    """Label, form and page for a list; a dash where there is no field."""
    return F.when(label.isNull(), F.lit("—")).otherwise(F.concat(label, F.lit("  ·  "), form, F.lit("  ·  p."), page.cast("string")))


def shortened(c: Column, most: int, otherwise: Column) -> Column:
    return F.substring(F.when(F.coalesce(c, F.lit("")) == "", otherwise).otherwise(c), 1, most)


def stable_id(*parts: Column) -> Column:
    """An id that a repeated run makes again."""
    return F.sha2(F.concat_ws("/", *[p.cast("string") for p in parts]), 256)


def page_number(c: Column) -> Column:
    """int(float(text)), and 1 where that fails."""
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(1))
