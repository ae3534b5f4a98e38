"""Fuzzy search for short license notices.

A text becomes words (A-Z lower-cased; letters, digits and characters beyond ASCII)
joined by single spaces. A notice of n characters may be found with k = n // 10 edits of
code points, but one at least, in a place of whole words. Any of its letters may be the
edited one, the first too (so "unlicensed under cc by nc" is two edits from its notice, and
found). A ``Scanner`` that isn't to find ``every`` such place takes those that begin with the
notice's first letter, and of each start the best end only.

Cut into k + 1 pieces, one piece of a notice must stand unchanged in any such place
(pigeonhole): the pieces are searched for as strings (an Aho-Corasick automaton took five
times the time, as few states have few branches), and each gives the few word starts where
the notice could begin. From there an edit distance of bit vectors (Myers) finds the word
ends within the edits. Of overlapping places of a notice the one with fewest errors stays, the
first of equal ones, and any place that overlaps no better one is kept. The regex library's bounded-error
matching then verifies the place and gives its span; as its time grows exponentially with
the errors, places with more than ``MATCHER_EDITS`` stand by the distance alone. Phrases of
the base are found exactly.

Rows are independent: nothing is shuffled, so no source or copy can be hot; a row needs
memory in proportion to its text, and time too, however many places it has. Null and empty
texts hold nothing. Equal rows get equal results. Null ids stay null. Empty tables give
empty results. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.shared import NOT_ALNUM, Words, as_bytes, slices, table, tidy

#: Phrases that are found exactly, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices that are found with errors, as words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version 2 0": "mpl-2.0",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}

#: Errors up to which the matcher, and not the edit distance itself, gives the spans.
MATCHER_EDITS = 4

FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:int,last_word:int,start:int,end:int,errors:int>>"

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else 32 if c in NOT_ALNUM else c for c in range(256))
_words = Words(NOT_ALNUM, lower=True)
# Capital letters are separators only before they are lower-cased.
_words.part[65:91] = False


def edits(notice: str) -> int:
    return max(1, len(notice) // 10)


def pieces(notice: str) -> list[tuple[int, str]]:
    """(place, piece): ``edits`` + 1 parts of almost one length."""
    n = edits(notice) + 1
    at = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _masks(notice: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for k, ch in enumerate(notice):
        out[ch] |= 1 << k
    return dict(out)


def distances(masks: dict[str, int], n: int, text: str) -> list[int]:
    """The edits between a notice of n characters and ``text`` up to each of its characters."""
    full, top = (1 << n) - 1, 1 << n - 1
    up, down, far, out = full, 0, n, []
    for ch in text:
        eq = masks.get(ch, 0)
        x = eq | down
        d = ((((eq & up) + up) & full) ^ up) | x
        p, m = down | (full & ~(d | up)), up & d
        far += bool(p & top) - bool(m & top)
        p = (p << 1 | 1) & full
        m = m << 1 & full
        up, down = m | (full & ~(x | p)), p & x
        out.append(far)
    return out


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE, every: bool = False) -> None:
        self.every = every
        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.notices = list(notices.items())
        self.patterns = [[regex.compile(f"(?:{regex.escape(p)}){{e<={e}}}") for e in range(min(edits(p), MATCHER_EDITS) + 1)] for p, _ in self.notices]
        self.masks = [_masks(p) for p, _ in self.notices]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (p, _) in enumerate(self.notices):
            for at, piece in pieces(p):
                where[piece].append((k, at))
        self.seeds = [(piece, places) for piece, places in where.items()]

    def places(self, k: int, joined: str, start: int) -> list[tuple[int, int, int]]:
        """(errors, start, end) of the places of notice k that begin at a word start; the best one, if not ``every``."""
        notice = self.notices[k][0]
        most = edits(notice)
        far = distances(self.masks[k], len(notice), joined[start : start + len(notice) + most])
        found = sorted((d, start, start + i + 1) for i, d in enumerate(far) if d <= most and joined.startswith(" ", start + i + 1))
        return found if self.every else found[:1]

    def fuzzy(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of the places in the joined words, which a space begins and ends."""
        spots: dict[int, set[int]] = defaultdict(set)
        for piece, places in self.seeds:
            found = joined.find(piece)
            while found >= 0:
                for k, at in places:
                    notice = self.notices[k][0]
                    slack = edits(notice)
                    for start in range(max(found - at - slack, 1), min(found - at + slack + 1, len(joined))):
                        if joined[start - 1] == " " and (self.every or joined[start] == notice[0]):
                            spots[k].add(start)
                found = joined.find(piece, found + 1)
        out: list[tuple[int, int, int, int]] = []
        for k, starts in spots.items():
            taken: list[tuple[int, int]] = []
            for errors, a, b in sorted(p for s in starts for p in self.places(k, joined, s)):
                at = bisect_left(taken, (a, b))
                if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
                    continue
                if errors <= MATCHER_EDITS:
                    m = self.patterns[k][errors].fullmatch(joined, a, b)
                    (a, b), errors = m.span(), sum(m.fuzzy_counts)
                insort(taken, (a, b))
                out.append((k, a, b, errors))
        return out

    def scan(self, text: str | None) -> dict:
        raw = as_bytes(text)
        words = raw.translate(_SPLIT).split()
        joined = b" " + b" ".join(words) + b" "
        starts, labels, base, score = [], set(), set(), 0.0
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                starts.append(at)
                base.add(label)
                score = 1.0
                at = joined.find(phrase, at + 1)
        if starts:
            starts = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), starts).tolist()
        spans = []
        text_ = joined.decode("utf-8", "surrogatepass")
        found = self.fuzzy(text_)
        if found:
            lo, hi = _words.spans(np.frombuffer(raw, np.uint8))
            spaces = np.flatnonzero(np.frombuffer(text_.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
            points = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)))
            for k, a, b, errors in found:
                notice, label = self.notices[k]
                labels.add(label)
                score = max(score, 1 - errors / len(notice))
                f, z = (int(x) - 1 for x in np.searchsorted(spaces, [a, b]))
                spans.append({"label": label, "first_word": f, "last_word": z, "start": int(points[lo[f]]), "end": int(points[hi[z]]), "errors": errors})
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | labels)),
            "score": score,
            "spans": sorted(spans, key=lambda s: (s["first_word"], s["last_word"], s["label"])),
        }


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("errors", pa.int32())]))
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPAN}


def license_spans(docs: DataFrame, notices: dict[str, str] = NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """What the notices and phrases of each row are; ``spans``: label, words from 0 (first and last), code points (start, end), errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, base, every=True)
        for batch in batches:
            for part in slices(batch):
                rows = [scanner.scan(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array([r[n] for r in rows], t) for n, t in _TYPES.items()]], ["doc_id", *_TYPES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), FOUND)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

