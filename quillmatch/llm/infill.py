"""Fill-in-middle: a text cut at two of its units, and its parts in another order between sentinels.

Constant memory beside the text and its output: a first pass over the matches of the unit
counts them, a second advances a lazy iterator over the same matches to both ranks and
keeps two offsets; no list of units exists. Units that are one code point each are matched
in runs of up to ``RUN``, so a match object is paid for once in a run.

What is cut, and how, hangs on a hash of the seed and the id alone: a lost task gives the
same rows again, and rows of one id have the same draws. No shuffle.

Null texts count as empty, empty texts and those that hold a sentinel stay plain. A null
id hashes as an empty one. Repeated rows give a row each, empty tables none, other columns
are not read. Long texts are cut whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.shared import slices, table, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
CODE_POINTS, WORDS = r"(?s:.)", r"\S+\s*|\s+"
RUN = 4096
ROWS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Units:
    """The units of a text: the matches of a pattern, from left to right. ``single``: each is one code point."""

    def __init__(self, pattern: str = CODE_POINTS, single: bool | None = None) -> None:
        self.single = pattern == CODE_POINTS if single is None else single
        self.find = re.compile(f"(?:{pattern}){{1,{RUN}}}" if self.single else pattern).finditer

    def _size(self, match: re.Match[str]) -> int:
        return match.end() - match.start() if self.single else 1

    def count(self, text: str) -> int:
        return sum(map(self._size, self.find(text)))

    def ends(self, text: str, *ranks: int) -> list[int]:
        """Where the unit of each rank ends, of ranks that rise; 0 for rank 0."""
        matches, seen, size, match = self.find(text), 0, 0, None
        out = []
        for rank in ranks:
            while seen + size < rank:
                seen += size
                match = next(matches)
                size = self._size(match)
            out.append(0 if rank == 0 else match.start() + rank - seen if self.single else match.end())
        return out


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def cut(text: str, n: int, units: Units, hashes: tuple[int, ...], rate: int, spm: int) -> tuple[str, int | None, int | None, str]:
    """(form, code points of prefix and middle, output) of a text of n units."""
    h1, h2, h3, h4 = hashes
    if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return "plain", None, None, text
    a, b = units.ends(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < spm:
        return "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def infilled(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = CODE_POINTS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of ``docs`` (doc_id, text): ``rate`` of 100 are cut, of those ``spm`` of 100 with the suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    text = text or ""
                    n = units.count(text)
                    rows.append((n, *cut(text, n, units, draws(seed, doc_id), rate, spm)))
                n, form, prefix, middle, output = zip(*rows, strict=True)
                long = pa.int64()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, long), pa.array(form), pa.array(prefix, long), pa.array(middle, long), pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), ROWS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, by its sentinels alone."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    whole = F.when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(whole)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infilled(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
      CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS e FROM d),
f AS (SELECT doc_id, t, n, least(a, b) AS lo, greatest(a, b) AS hi,
      CASE WHEN n = 0 OR c >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, lo) AS x, substr(t, lo + 1, hi - lo) AS y, substr(t, hi + 1) AS z FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(lo AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(hi - lo AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
