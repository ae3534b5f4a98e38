"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a Column that is true where it rejects a text. The cascade first runs each
rule alone over a bounded sample (rows of least hashes of all documents), which gives its
cost (seconds) and its selectivity (share rejected), and then evaluates the rules in
descending order of rejection per cost inside one CASE, so a row meets an expensive rule
only if every rule that rejects more per second has let it pass. The verdict is a
conjunction: its order changes its price and never its value. Inside a rule the same
holds: repeated windows are located only in texts that could have too many, or any.

Null texts are texts without words; texts without words are rejected by the word count.
Equal rows get equal results, an empty table gives an empty result, and columns of the
input other than the id and the text are neither read nor kept by ``measures``. No step
needs a shuffle, so no key can be hot; a row needs memory in proportion to its text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.shared import fresh, table

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

#: What bullet lines begin and broken-off lines end with.
BULLETS = r"^[\x20\x09-\x0D]*[-*•‣▪●◦]"
ELLIPSIS = r"(\.\.\.|…)[\x20\x09-\x0D]*$"

#: Rows of the sample from which costs and selectivities are estimated, and the seed of its hash.
SAMPLE_ROWS, SEED = 400, 42


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (functions over arrays would compute a plain Column again for each element)."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]++", "")).cast("long")


def word_chars(w: Column) -> Column:
    """Code points of all words."""
    return F.length(F.array_join(w, "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_again(a: Column) -> Column:
    """How many elements equal an earlier one."""
    return F.size(a) - F.size(F.array_distinct(a))


def window_hashes(w: Column) -> Column:
    """64-bit hashes of the windows of three words. Two different ones among n of a text are equal with a chance below n * n / 2**65."""
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def covered(h: Column) -> Column:
    """Words covered by a window that starts at two places or more.

    Windows are sorted as (hash, start), so equal ones become neighbours: no window is
    compared with all others and nothing leaves the row.
    """
    starts = let(
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        lambda s: F.sort_array(
            F.filter(
                F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])),
                lambda i: i.isNotNull(),
            )
        ),
    )
    # A start adds its three words less those that the start before it covers.
    return let(starts, lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b))


def n_repeat_words(w: Column) -> Column:
    """Words covered by a window of three words that starts at two places or more; they are located only where a window occurs again."""
    return let(w, lambda a: let(window_hashes(a), lambda h: F.when(n_again(h) == 0, F.lit(0).cast("long")).otherwise(covered(h))))


def mostly_repeated(w: Column) -> Column:
    """Whether repeated windows cover more than half of the words. Groups of g equal windows have g - 1 that occur again and cover 3 * g words, at most 6 * (g - 1); texts with too few need no more."""
    return let(w, lambda a: let(window_hashes(a), lambda h: F.when(12 * n_again(h) > F.size(a), 100 * covered(h) > 50 * F.size(a)).otherwise(F.lit(False))))


def share_of_lines(lines: Column, pattern: str, percent: int) -> Column:
    """Whether more than so many per cent of three lines or more match."""
    return (F.size(lines) > 2) & (100 * F.size(F.filter(lines, lambda line: line.rlike(pattern))) > percent * F.size(lines))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of the whole text; columns of these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = fresh("_parts", docs)
    counted = docs.withColumns(
        {
            parts: F.struct(
                let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), word_chars(w).alias("c"), n_repeat_words(w).alias("r"))).alias("w"),
                let(lines_with_words(t), lambda x: F.struct(F.size(x).cast("long").alias("n"), n_again(x).cast("long").alias("d"))).alias("l"),
            ),
            "n_symbols": n_symbols(t),
        }
    )
    w, lines = F.col(parts)["w"], F.col(parts)["l"]
    return counted.withColumns({"n_words": w["n"], "word_chars": w["c"], "n_repeat_words": w["r"], "n_lines": lines["n"], "n_dup_lines": lines["d"]}).drop(parts)


def default_rules(text: Column, w: Column | None = None, lines: Column | None = None) -> list[Rule]:
    """The rules of this engine, each from the whole text alone; ``w`` and ``lines``: its words and its lines with words, if they are at hand. The last three use what ``measures`` doesn't give."""
    t = F.coalesce(text, F.lit(""))
    w = words(t) if w is None else w
    lines = lines_with_words(t) if lines is None else lines
    return [
        Rule("few_words", F.size(w) < 50),
        Rule("repeated_windows", mostly_repeated(w)),
        Rule("symbols", 4 * n_symbols(t) > F.size(w)),
        Rule("word_length", let(w, lambda a: let(word_chars(a), lambda c: (c < 2 * F.size(a)) | (c > 15 * F.size(a))))),
        Rule("repeated_lines", let(lines, lambda x: 2 * n_again(x) > F.size(x))),
        Rule("few_letters", 2 * F.length(F.regexp_replace(t, r"\P{L}++", "")) < word_chars(w)),
        Rule("bullet_lines", let(lines, lambda x: share_of_lines(x, BULLETS, 90))),
        Rule("broken_lines", let(lines, lambda x: share_of_lines(x, ELLIPSIS, 30))),
    ]


def rejected_by(text: Column, order: list[str]) -> Column:
    """The name of the first of the default rules in ``order`` that rejects, or null; the text is split once for all of them."""

    def verdict(parts: Column) -> Column:
        by_name = {r.name: r for r in default_rules(text, parts["w"], parts["l"])}
        return cascade([by_name[n] for n in order])

    t = F.coalesce(text, F.lit(""))
    return let(F.struct(words(t).alias("w"), lines_with_words(t).alias("l")), verdict)


def ordered(rules: list[Rule], sample: DataFrame) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) in descending order of rejection per cost, measured on ``sample``.

    Each rule runs alone over the cached sample; what a rule that does nothing takes
    is subtracted. An empty sample keeps the given order.
    """
    sample = sample.persist()
    try:
        rows = sample.count()
        if not rows:
            return [(r, 0.0, 0.0) for r in rules]

        def run(c: Column) -> tuple[float, int]:
            began = time.perf_counter()
            hits = sample.agg(F.count_if(c).alias("n")).first()["n"]
            return time.perf_counter() - began, hits

        run(F.lit(True))
        idle = run(F.lit(True))[0]
        found = []
        for k, r in enumerate(rules):
            took, hits = run(r.rejects)
            cost = max(took - idle, 1e-3)
            found.append((-(hits / rows) / cost, k, r, cost, hits / rows))
        return [(r, cost, share) for _, _, r, cost, share in sorted(found, key=lambda x: x[:2])]
    finally:
        sample.unpersist()


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule, in the order given, that rejects; null if none does. Later rules aren't evaluated."""
    out = F.when(F.coalesce(rules[0].rejects, F.lit(False)), F.lit(rules[0].name))
    for r in rules[1:]:
        out = out.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name))
    return out


def sampled(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """At most ``rows`` texts of all documents for the estimates, chosen by a seeded hash; the verdict itself reads every row."""
    share = min(1.0, 2 * rows / max(docs.count(), 1))
    hashed = F.xxhash64(*[F.col(c) for c in ("doc_id", text) if c in docs.columns], F.lit(seed))
    return docs.where(F.pmod(hashed, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).select(text).limit(rows)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    on_measures = {
        "few_words": F.col("n_words") < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 4 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
    }
    order = ordered(default_rules(F.col("text")), sampled(docs))
    # The contract wants every measure of every text, so the rules on them read what is there; the others are evaluated as the cascade says.
    rejected = cascade([Rule(r.name, on_measures.get(r.name, r.rejects)) for r, _, _ in order])
    base = on_measures["few_words"] | on_measures["repeated_windows"]
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), rejected.isNull().alias("kept")
    )


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    order = [r.name for r, _, _ in ordered(default_rules(F.col("text")), sampled(docs))]
    return docs.where(rejected_by(F.col("text"), order).isNull())


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: For DuckDB, over whole texts.
OP3_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), k AS (SELECT row_number() OVER () AS k, * FROM w),
g AS (
  SELECT k, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM k WHERE len(w) >= 3)
), r AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g),
p AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY k),
m AS (
  SELECT doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS wc,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
         len(list_filter(l, lambda x: regexp_matches(x, '{BULLETS}'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS n_broken
  FROM k LEFT JOIN p USING (k)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(wc, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 4 * n_symbols > n_words
            OR coalesce(wc, 0) < 2 * n_words OR coalesce(wc, 0) > 15 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * n_letters < coalesce(wc, 0) OR (n_lines > 2 AND (100 * n_bullets > 90 * n_lines OR 100 * n_broken > 30 * n_lines))) AS kept
FROM m
"""
