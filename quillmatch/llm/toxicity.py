"""Toxicity of texts by a weighted lexicon.

Texts are folded first: compatibility forms and case, letters of other scripts that look
like Latin ones, digits and signs that stand for letters inside a word, marks that don't
show; what is left are words between single spaces. The lexicon has words and beginnings
of words (families), each with a weight, and exception phrases; one Aho-Corasick automaton
finds all of them in a pass over a text. A word counts with the greatest weight among its
entries, unless an exception phrase covers it. The score is a logistic function of the
greatest weight, of the sum of weights, of that for each 100 words, and of the length.

Learning: at most ``LABELLED`` labelled rows, those whose ids hash lowest. An entry's weight is
the lower bound (``SURENESS`` standard errors) of the log odds that a toxic text has it. Entries
that a longer one explains go, at most ``ENTRIES`` stay. Weights of a labelled text are taken
without its own label when the logistic function is fitted. A few insults are in any lexicon,
as if a share ``SEEN`` of the toxic texts had them, so that few or no labels still leave a scorer. Two-word
phrases with an entry that only clean texts have, several times, become exceptions. The
model is bounded and goes to the workers with the tasks; scoring is one pass without a shuffle.

Null texts count as empty and get the score of a text without words. Null labels don't
count; of several labels of an id the greatest does. Null ids are never learned from nor held
out. Repeated rows give a row each, empty tables none; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.shared import held, slices, stored, table, tidy

LABELLED, CANDIDATES, ENTRIES, PHRASES = 20_000, 60_000, 20_000, 2_000
SURENESS, LEAST_WEIGHT, EXPLAINED = 2.5, 0.5, 0.95
SHORTEST, LONGEST = 3, 8  # letters of a beginning
CLEAN_TEXTS = 3  # that have a phrase, at least, for an exception
SEEN, LEAST_SEEN, HELD_OUT, TOXIC_FROM = 0.2, 8, 2, 0.3
#: Where one class of labels is missing: constant, greatest weight, sum, sum for each 100 words, length.
DEFAULT = (-2.5, 1.0, 0.5, 0.5, -0.2)

# Letters that look like others, digits and signs that stand for letters, what doesn't show.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t",
    "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
UNSEEN = "­​‌‍⁠﻿"
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "scumbag", "loser", "losers", "worthless", "pathetic", "disgusting", "imbecile", "retard", "bastard", "asshole", "bitch", "dumbass", "vermin", "subhuman")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum")

_FOLD = str.maketrans(LOOKALIKES | dict.fromkeys(UNSEEN, ""))
_DIGITS = str.maketrans(DIGITS)
_STANDS = re.compile(r"(?<=[^\W\d_])[0134578]+|(?<=[^\W\d_])[@$!]+(?=[^\W_])|(?<![^\W_])(?<![@$!])[0134578@$!]+(?=[^\W\d_])")
_GAP = re.compile(r"[\W\d_]+")
_WORD = re.compile(r"[^ ]+")


def folded(text: str | None) -> str:
    """The words of a text, folded, each with a space before and after it; a space if there is none."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).lower().translate(_FOLD))
    text = _STANDS.sub(lambda m: m[0].translate(_DIGITS), text.lower())
    words = _GAP.sub(" ", text).strip(" ")
    return f" {words} " if words else " "


def entries_of(word: str) -> Iterator[str]:
    """The lexicon's entries that a word may have: itself, and its beginnings. An entry starts with a space, a whole word ends with one."""
    yield f" {word} "
    for k in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield f" {word[:k]}"


@dataclass(frozen=True)
class Model:
    """entries: (text, toxic, clean), of so many texts that have it. weights: one for each. phrases: exceptions. toxic, clean: learned texts."""

    entries: tuple[tuple[str, int, int], ...]
    weights: tuple[float, ...]
    phrases: tuple[str, ...]
    toxic: int
    clean: int
    terms: tuple[float, ...] = DEFAULT


def weights(has_toxic: np.ndarray, has_clean: np.ndarray, toxic: float, clean: float) -> np.ndarray:
    """Lower bounds of the log odds of entries; 0 where they are under ``LEAST_WEIGHT``."""
    a, b = np.maximum(has_toxic, 0) + 0.5, np.maximum(has_clean, 0) + 0.5
    bound = np.log(a / (toxic + 1)) - np.log(b / (clean + 1)) - SURENESS * np.sqrt(1 / a + 1 / b)
    return np.where(bound >= LEAST_WEIGHT, bound, 0.0)


class Matcher:
    """The automaton of a model."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for k, (entry, _, _) in enumerate(model.entries):
            self.find.add_word(entry, (len(entry), k))
        for phrase in model.phrases:
            if phrase not in self.find:
                self.find.add_word(phrase, (len(phrase), -1))
        self.weights = model.weights
        if len(self.find):
            self.find.make_automaton()

    def hits(self, text: str) -> dict[int, int]:
        """By the place of a word in a folded text: its entry of the greatest weight."""
        best: dict[int, int] = {}
        spared: list[tuple[int, int]] = []
        if not len(self.find):
            return best
        for end, (size, k) in self.find.iter(text):
            at = end - size + 1
            if k < 0:
                spared.append((at, end))
            elif at not in best or self.weights[k] > self.weights[best[at]]:
                best[at] = k
        for lo, hi in spared:
            for at in [a for a in best if lo <= a < hi] if len(best) < hi - lo else [a for a in range(lo, hi) if a in best]:
                del best[at]
        return best


def features(greatest: np.ndarray, sums: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What the logistic function sees."""
    return np.stack([np.ones_like(sums), greatest, np.log1p(sums), np.log1p(100 * sums / (n_words + 10)), np.log1p(n_words)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Terms of a logistic regression with a penalty on all but the constant, by Newton steps that are halved while they don't help."""
    keep = ridge * np.array([0.0, *[1.0] * (x.shape[1] - 1)])

    def loss(t: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ t).sum() - y @ (x @ t) + (keep * t * t).sum() / 2)

    terms = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ terms, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (p - y) + keep * terms)
        size = 1.0
        while size > 1e-6 and loss(terms - size * step) > loss(terms):
            size /= 2
        terms = terms - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return terms


def bucket(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(text, toxic) of the rows to learn from, stored. The ids are at most ``most``, so they are broadcast and no text moves but theirs."""
    ids = labels.where(F.col("toxic").isNotNull() & (bucket(F.col("doc_id")) != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"))


def _counted(rows: DataFrame, keys: object) -> DataFrame:
    """(key, toxic, clean): how many texts of each label have a key; ``keys`` gives those of a folded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def emit() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[x] for x in names], pa.int64()) for c in (counts[1], counts[0])]], ["key", "toxic", "clean"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    counts[toxic > 0].update(keys(folded(text)))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield emit()
        yield emit()

    return rows.mapInArrow(tidy(run, "toxicity"), "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _text_entries(text: str) -> set[str]:
    return {e for w in {m[0] for m in _WORD.finditer(text)} if len(w) <= 40 for e in entries_of(w)}


def _lexicon(rows: DataFrame, toxic: int, clean: int) -> list[tuple[str, int, int]]:
    """The entries whose weight counts; seeds have a share of the toxic texts more. Those that a longer entry explains are left out."""
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    bound = F.log(a / (toxic + 1)) - F.log(b / (clean + 1)) - SURENESS * F.sqrt(1 / a + 1 / b)
    seeds = [f" {w} " for w in INSULTS]
    good = _counted(rows, _text_entries).withColumn("w", bound)
    chosen = good.where((F.col("w") >= LEAST_WEIGHT) | F.col("key").isin(seeds)).orderBy(F.desc("w"), "key").limit(CANDIDATES).collect()
    found = {r["key"]: (r["toxic"], r["clean"]) for r in chosen}
    explained: set[str] = set()
    for entry, (has, _) in found.items():
        word = entry.strip(" ")
        for k in range(SHORTEST, len(word) + entry.endswith(" ")):
            start = f" {word[:k]}"
            if start in found and EXPLAINED * found[start][0] <= has:
                explained.add(start)
    kept = [(e, *c) for e, c in found.items() if e not in explained and e not in seeds][: ENTRIES - len(seeds)]
    more = max(LEAST_SEEN, int(SEEN * toxic))
    return kept + [(s, found.get(s, (0, 0))[0] + more, found.get(s, (0, 0))[1]) for s in seeds]


def _phrases(text: str, hits: dict[int, int]) -> set[str]:
    """The two-word phrases around the hits of a folded text."""
    out = set()
    for at in hits:
        end = text.index(" ", at + 1)
        if at > 0:
            out.add(text[text.rindex(" ", 0, at) : end + 1])
        if end + 1 < len(text):
            out.add(text[at : text.index(" ", end + 1) + 1])
    return out


def learned(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """A model of the labelled texts that aren't held out."""
    rows = labelled(docs, labels, most)
    of = {r["label"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("label")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = of.get(True, 0), of.get(False, 0)
    entries = _lexicon(rows, toxic, clean)
    has = np.array([e[1:] for e in entries], float).reshape(-1, 2)
    first = Model(tuple(entries), tuple(weights(has[:, 0], has[:, 1], max(toxic, LEAST_SEEN), max(clean, 10 * LEAST_SEEN)).tolist()), (), toxic, clean)

    def around(text: str) -> set[str]:
        return _phrases(text, held("toxicity", first, lambda: Matcher(first)).hits(text))

    spared = _counted(rows, around).where(f"toxic = 0 and clean >= {CLEAN_TEXTS}").orderBy(F.desc("clean"), "key").limit(PHRASES).collect()
    given = [f" {folded(p).strip(' ')} " for p in EXCEPTIONS]
    model = Model(first.entries, first.weights, tuple(dict.fromkeys([*given, *(r["key"] for r in spared)])), toxic, clean)
    if not toxic or not clean:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = held("toxicity", model, lambda: Matcher(model))
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    said = folded(text)
                    hits = Counter(matcher.hits(said).values())
                    at = list(hits)
                    own = weights(has[at, 0] - (label > 0), has[at, 1] - (label <= 0), max(toxic, LEAST_SEEN), max(clean, 10 * LEAST_SEEN)) if at else np.zeros(0)
                    out.append((float(own.max(initial=0.0)), float(own @ np.array(list(hits.values()), float)), said.count(" ") - 1, int(label > 0)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.int64(), pa.int64()))], ["m", "s", "n", "y"])

    # At most ``most`` ids; the driver gets four numbers of each text.
    seen = rows.mapInArrow(tidy(run, "toxicity"), "m double, s double, n long, y long").toPandas()
    terms = logistic(features(seen["m"].to_numpy(), seen["s"].to_numpy(), seen["n"].to_numpy(float)), seen["y"].to_numpy(float))
    return Model(model.entries, model.weights, model.phrases, toxic, clean, tuple(terms.tolist()))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_words, matched) of every row of ``docs`` (doc_id, text); matched is how many words of it counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = held("toxicity", model, lambda: Matcher(model))
        for batch in batches:
            for part in slices(batch):
                n, hit, most, total = [], [], [], []
                for text in part.column("text").to_pylist():
                    said = folded(text)
                    found = matcher.hits(said)
                    n.append(said.count(" ") - 1)
                    hit.append(len(found))
                    found = [model.weights[k] for k in found.values()]
                    most.append(max(found, default=0.0))
                    total.append(sum(found))
                x = features(np.array(most, float), np.array(total, float), np.array(n, float))
                score = 1 / (1 + np.exp(-np.clip(x @ np.array(model.terms), -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(n, pa.int64()), pa.array(hit, pa.int64())], ["doc_id", "score", "n_words", "matched"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, "toxicity"), "doc_id long, score double, n_words long, matched long")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = learned(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    held_out = F.coalesce(bucket(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return scored(docs, model).select("doc_id", held_out, "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
