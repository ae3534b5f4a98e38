"""A profile's rules as Columns: classification, visits, form names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import FLAGS, any_found, found, group, strip
from quillmatch.plans.profile import Condition, Profile, VisitRule

EXCLUDED, DEFAULT = "_exclude", "sdtm_mapping"


def java_pattern(pattern: str) -> str:
    """Named groups in Java's spelling; the rest of the common syntax is the same."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def holds(c: Condition, content: Column, subject: Column, domain_codes: list[str]) -> Column:
    """All conditions that are set; none set holds always."""
    tests = []
    if c.max_length is not None:
        tests.append(F.length(content) <= c.max_length)
    if c.min_length is not None:
        tests.append(F.length(content) >= c.min_length)
    if c.subject_is is not None:
        tests.append(F.lower(subject) == c.subject_is.lower())
    if c.contains is not None:
        tests.append(F.contains(F.lower(content), F.lit(c.contains.lower())))
    if c.starts_with is not None:
        tests.append(F.startswith(F.lower(content), F.lit(c.starts_with.lower())))
    if c.multi_line:
        tests.append(F.contains(content, F.lit("\n")) | F.contains(content, F.lit("\r")))
    if c.regex is not None:
        tests.append(found(content, java_pattern(c.regex)))
    if c.domain_in is not None:
        if c.regex is None or not re.compile(c.regex).groups:
            tests.append(F.lit(False))
        else:
            tests.append(F.array_contains(F.array(*[F.lit(d) for d in domain_codes]), group(content, java_pattern(c.regex), 1)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def described(number: int, c: Condition) -> str:
    said = {
        "fallback": c.fallback and "fallback",
        "subject_is": c.subject_is is not None and f"subject_is='{c.subject_is}'",
        "max_length": c.max_length is not None and f"max_length={c.max_length}",
        "min_length": c.min_length is not None and f"min_length={c.min_length}",
        "contains": c.contains is not None and f"contains='{c.contains}'",
        "starts_with": c.starts_with is not None and f"starts_with='{c.starts_with}'",
        "multi_line": c.multi_line and "multi_line",
        "regex": c.regex is not None and f"regex='{c.regex}'",
        "domain_in": c.domain_in is not None and "domain_in=domain_codes",
    }
    return f"Rule {number}: {', '.join(x for x in said.values() if x) or 'conditions'}"


def rule_number(profile: Profile, text: Column, subject: Column) -> Column:
    """The place, from 1, of the first rule that holds for a stripped text; one more than there are rules if none does."""
    out = F.lit(len(profile.classification_rules) + 1)
    for k, r in reversed(list(enumerate(profile.classification_rules, 1))):
        out = F.when(holds(r.conditions, text, subject, profile.domain_codes), F.lit(k)).otherwise(out)
    return out


def _verdict(profile: Profile, number: Column) -> Column:
    rules = profile.classification_rules
    said = [described(k, r.conditions) for k, r in enumerate(rules, 1)] + [f"Rule {len(rules) + 1}: ultimate fallback (no rule matched)"]
    categories = [r.category for r in rules] + [DEFAULT]
    names = {"category": categories, "matched_rule": said}
    return F.struct(*[F.element_at(F.array(*[F.lit(x) for x in values]), number).alias(name) for name, values in names.items()])


def classified(profile: Profile, content: Column, subject: Column) -> Column:
    """struct(category, matched_rule) by the first rule that holds for the stripped content."""
    return _verdict(profile, rule_number(profile, strip(F.coalesce(content, F.lit(""))), F.coalesce(subject, F.lit(""))))


def classify(rows: DataFrame, profile: Profile, content: str, subject: str, name: str) -> DataFrame:
    """``rows`` with the verdict as ``name``. The stripped content and the rule's number are made by generators, which the optimizer doesn't copy into each use."""
    text = rows.select("*", F.explode(F.array(strip(F.coalesce(F.col(content), F.lit(""))))).alias("_text"))
    number = text.select("*", F.explode(F.array(rule_number(profile, F.col("_text"), F.coalesce(F.col(subject), F.lit(""))))).alias("_rule"))
    return number.withColumn(name, _verdict(profile, F.col("_rule"))).drop("_text", "_rule")


def visit(rules: list[VisitRule], text: Column) -> Column:
    """The value of the first rule found in the text, with its groups filled in; empty if none is."""
    out = None
    for r in rules:
        p = java_pattern(r.regex)
        value = F.lit(r.value)
        for k in range(1, re.compile(r.regex).groups + 1):
            if f"{{{k}}}" in r.value:
                value = F.replace(value, F.lit(f"{{{k}}}"), group(text, p, k))
        out = F.when(found(text, p), value) if out is None else out.when(found(text, p), value)
    return F.lit("") if out is None else out.otherwise(F.lit(""))


def excluded(profile: Profile, text: Column) -> Column:
    """Whether a text is boilerplate: never a form name, a label or a header."""
    return any_found(text, [java_pattern(p) for p in profile.form_name_rules.exclude_patterns])


def prefix_pattern(prefix: str) -> str:
    """Of ``prefix: value``; \\Q and \\E quote the prefix."""
    return rf"^\Q{prefix.rstrip(':')}\E\s*:\s*(.+)$"


def prefixed(prefix: str, text: Column) -> Column:
    """The value of a line ``prefix: value``, or null."""
    t = strip(text)
    p = FLAGS + prefix_pattern(prefix)
    return F.when(t.rlike(p), strip(F.regexp_extract(t, p, 1)))
