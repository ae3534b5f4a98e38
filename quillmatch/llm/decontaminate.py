"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

Words are runs of letters, digits and characters beyond ASCII, lower-cased (A-Z), so
punctuation and spacing don't matter. Items fall into size classes; for each class
every document is covered by windows of that many words, ``1 / STEPS`` of a window
apart from its start on, by one at its end, and at both ends by windows that are clipped to
the text, down to ``SIMILAR`` of the class's shingles in the same steps; a text that is
shorter than the window is one window as a whole. Windows without any shingle of an item
in the text around them have nothing to verify and are left out before their fingerprints.
A window and an item have 64-bit SimHash fingerprints over their five-word shingles.
Fingerprints are cut into ``BLOCKS`` blocks of 16 bits; within ``RADIUS`` of an item at least
one block is within RADIUS // BLOCKS bits of the item's, so a table of those neighbours for
each block finds every fingerprint within the radius (pigeonhole), and nothing else is
compared. What passes is verified exactly: the weight of the item's shingles found in the
text around the window (one window step either way) over the weight of all the item's
shingles, where a shingle weighs 1 / (items that have it), is at least 0.75. An item of
fewer than five words is one shingle.

Documents are never shuffled; a hot source or thousands of copies cost what their words
cost. One pass over the documents serves up to ``ITEMS`` items and ``ITEM_BYTES`` of their
texts, which are broadcast (so the broadcast's size has a bound); a larger benchmark takes
further passes. In a pass a worker first collects the few windows that have something to
verify, then looks them up in the neighbour tables of ``SHARD`` items at a time, so what it
holds is bounded too. How many items have a shingle and which lengths items have is found
over the whole benchmark before, for the weights and the size classes, so results are the
same for every size of passes and shards and in every order of items and documents.

Null and empty texts hold no item; null items and items without words are found nowhere.
Equal documents are found alike, equal items each under its own id. Null ids are values
like others. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.shared import NOT_ALNUM, Words, as_bytes, fresh, held, keep_only, slices, stored, table, tidy, windows

SHINGLE, SIMILAR = 5, 0.75
RADIUS, BLOCKS, STEPS, RATIO = 18, 4, 8, 1.1
ITEMS, ITEM_BYTES = 20_000, 16 << 20
SHARD = 500  # items; their tables take about 120 KB each
PENDING, CHUNK, ROWS = 200_000, 1 << 17, 128  # windows that wait for a look-up, shingles that are summed at a time, rows of a tile
_U = np.uint64
_BLOCK = np.arange(BLOCKS) << 16
_words = Words(NOT_ALNUM, lower=True)
FOUND = "doc_id long, hash long, item_id long, similarity double, distance int, first_word long"
Item = tuple[int | None, str | None, list[tuple[int, int]]]


def _signs(shingles: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of the shingles' bits; windows' sums are differences, modulo more than the ``longest`` window.

    Rows are summed by columns of ``ROWS`` x ``ROWS`` tiles, then over the tiles, so each
    step adds many bytes at once (a cumsum goes through every bit's column by itself).
    """
    kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
    tiles = len(shingles) // ROWS + 1
    out = np.zeros((tiles, ROWS, 64), kind)
    out.reshape(-1, 64)[1 : len(shingles) + 1] = np.unpackbits(shingles.view(np.uint8)).reshape(-1, 64)
    for k in range(1, ROWS):
        out[:, k] += out[:, k - 1]
    for k in range(1, tiles):
        out[k] += out[k - 1, -1]
    return out.reshape(-1, 64)[: len(shingles) + 1]


def _fingerprints(shingles: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The fingerprints of the windows of so many shingles ``at`` these places; only shingles in windows are summed."""
    out = np.zeros(len(at), _U)
    if not len(at):
        return out
    order = np.argsort(at, kind="stable")
    at, size = at[order], size[order]
    ends = np.maximum.accumulate(at + size)
    new = np.flatnonzero(np.concatenate(([True], at[1:] > ends[:-1])))
    hi = np.append(ends[new[1:] - 1], ends[-1])  # where what the windows cover ends
    longest = int(size.max())
    prints = np.zeros(len(at), _U)
    for k, (first, last) in enumerate(zip(new.tolist(), np.append(new[1:], len(at)).tolist(), strict=True)):
        while first < last:  # a long stretch goes in parts
            a = int(at[first])
            stop = max(first + 1, int(np.searchsorted(at[:last], a + CHUNK)))
            sums = _signs(shingles[a : min(int(ends[stop - 1]), int(hi[k]))], longest)
            x, n = at[first:stop] - a, size[first:stop]
            prints[first:stop] = np.packbits(sums[x + n] - sums[x] > (n // 2).astype(sums.dtype)[:, None], axis=1).view(_U).ravel()
            first = stop
    out[order] = prints
    return out


def _near(bits: int) -> np.ndarray:
    """All 16-bit numbers with at most so many bits."""
    x = np.arange(1 << 16, dtype=np.uint16)
    return x[np.bitwise_count(x) <= bits]


def _limits() -> list[int]:
    """How many bits a block may differ: one more in each, summed, exceeds RADIUS, so not all blocks can differ by more."""
    spare = RADIUS + 1 - BLOCKS
    return [spare // BLOCKS + (b < spare % BLOCKS) for b in range(BLOCKS)]


def _clipped(starts: np.ndarray, n: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the windows that reach past an end of texts of ``n`` shingles each, without what is past it."""
    whole = np.flatnonzero((n > 0) & (n < size))
    at, sizes = [starts[whole]], [n[whole]]
    for part in range(size - step, math.ceil(SIMILAR * size) - 1, -step):
        own = np.flatnonzero(n > part)
        at += [starts[own], starts[own] + n[own] - part]
        sizes.append(np.full(2 * len(own), part))
    return np.concatenate(at), np.concatenate(sizes)


class _Class:
    """Items of about one size, with the tables of their blocks."""

    def __init__(self, size: int, prints: np.ndarray, items: np.ndarray) -> None:
        self.size, self.items = size, items
        whose, keys = [], []
        for b, limit in enumerate(_limits()):
            near = _near(limit)
            own = (prints >> _U(16 * b)).astype(np.uint16)
            keys.append((own[:, None] ^ near[None, :]).ravel().astype(np.int32) + (b << 16))
            whose.append(np.repeat(np.arange(len(prints), dtype=np.int32), len(near)))
        key = np.concatenate(keys)
        # One table of all blocks: the items near a key stand in ``whose`` from the table's high half on, as many as its low half says.
        self.whose = np.concatenate(whose)[np.argsort(key, kind="stable")]
        self.near_prints = prints[self.whose]
        many = np.bincount(key, minlength=BLOCKS << 16)
        self.table = (np.cumsum(many) - many << 32) + many

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        key = (prints.view("<u2").reshape(-1, BLOCKS) + _BLOCK).ravel()
        both = self.table.take(key)
        n = both & 0xFFFFFFFF
        ends = np.cumsum(n)
        place = np.repeat((both >> 32) - (ends - n), n)
        place += np.arange(len(place))
        other = np.repeat(prints, n.reshape(-1, BLOCKS).sum(axis=1))
        other ^= self.near_prints.take(place)
        far = np.bitwise_count(other)
        ok = np.flatnonzero(far <= RADIUS)
        return np.searchsorted(ends, ok, side="right") // BLOCKS, self.whose[place[ok]], far[ok]


def _shingles(text: str | None) -> tuple[np.ndarray, int]:
    """(the distinct shingles of an item, how many words it has)."""
    w = _words.hashes(np.frombuffer(as_bytes(text), np.uint8))
    return (np.unique(windows(w, min(SHINGLE, len(w)))), len(w)) if len(w) else (w, 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, text, n) to (name, n, shingle, length), a row for each distinct shingle."""
    for batch in batches:
        found = [_shingles(t.as_py()) for t in batch.column("text")]
        row = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
        shingles = np.concatenate([s for s, _ in found]) if found else np.zeros(0, _U)
        lengths = np.array([n for _, n in found], np.int64)
        pick = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column("name").take(pick), batch.column("n").take(pick), pa.array(shingles.view(np.int64)), pa.array(lengths[row])], ["name", "n", "shingle", "length"])


def _sizes(lengths: list[int]) -> list[int]:
    """The least length of each class, of the lengths of all items."""
    sizes: list[int] = []
    for n in sorted(lengths):
        if n >= SHINGLE and (not sizes or n > sizes[-1] * RATIO):
            sizes.append(n)
    return sizes


class _Filter:
    """Places of shingles that are among the known ones: two tables of bits, then the sorted shingles themselves."""

    def __init__(self, known: np.ndarray) -> None:
        self.known, self.bits = known, min(24, max(16, len(known).bit_length() + 6))
        self.mask = _U((1 << self.bits) - 1)
        self.low, self.high = np.zeros(1 << self.bits, bool), np.zeros(1 << self.bits, bool)
        self.low[known & self.mask] = True
        self.high[known >> _U(self.bits) & self.mask] = True

    def places(self, shingles: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.low[shingles & self.mask])
        at = at[self.high[shingles[at] >> _U(self.bits) & self.mask]]
        if not len(at):
            return at
        return at[self.known[np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)] == shingles[at]]


class Benchmark:
    """The items of a pass: (id, text, the shingles that several items of the whole benchmark have and in how many), with their classes."""

    def __init__(self, items: list[Item], sizes: list[int]) -> None:
        self.ids, self.shingles, self.weights, lengths = [], [], [], []
        for item, text, shared in items:
            s, n = _shingles(text)
            if n:
                weight = np.ones(len(s))
                if shared:
                    weight[np.searchsorted(s, np.array([x % (1 << 64) for x, _ in shared], _U))] = [1 / many for _, many in shared]
                self.ids.append(item)
                self.shingles.append(s)
                self.weights.append(weight)
                lengths.append(n)
        self.total = [math.fsum(w.tolist()) for w in self.weights]
        self.lengths = np.array(lengths, np.int64)
        self.short = [k for k, n in enumerate(lengths) if n < SHINGLE]
        long_ = [k for k, n in enumerate(lengths) if n >= SHINGLE]
        self.filter = _Filter(np.unique(np.concatenate([self.shingles[k] for k in long_]))) if long_ else None
        self.classes: list[tuple[int, list[int]]] = []  # (shingles of a window, items)
        of: dict[int, list[int]] = {}
        for k in long_:
            of.setdefault(sizes[bisect_right(sizes, lengths[k]) - 1], []).append(k)
        self.classes = [(size - SHINGLE + 1, of[size]) for size in sorted(of)]
        self.prints = {k: _fingerprints(self.shingles[k], np.array([0]), np.array([len(self.shingles[k])]))[0] for k in long_}
        self.tables: dict[tuple[int, int], _Class] = {}

    def table(self, number: int, shard: int) -> _Class:
        """The neighbours of a shard of a class; those of one shard of the pass are kept."""
        if (number, shard) not in self.tables:
            if sum(len(items) for _, items in self.classes) > SHARD:
                self.tables.clear()
            size, items = self.classes[number]
            own = items[shard : shard + SHARD]
            self.tables[number, shard] = _Class(size, np.array([self.prints[k] for k in own], _U), np.array(own))
        return self.tables[number, shard]

    def similarity(self, here: np.ndarray, k: int) -> float:
        """The part of item k's weight that is among these shingles."""
        own = self.shingles[k]
        here = np.unique(here)
        at = np.minimum(np.searchsorted(own, here), len(own) - 1)
        return math.fsum(self.weights[k][at[own[at] == here]].tolist()) / self.total[k]


def _windows_near(hits: np.ndarray, starts: np.ndarray, n: np.ndarray, size: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, size, text) of a class's windows with one of the ``hits`` in them or ``near`` them, in texts that start at ``starts`` and have ``n`` shingles."""
    step = max(1, size // STEPS)
    text = np.searchsorted(starts, hits, side="right") - 1
    at, s = hits - starts[text], starts[text]
    lo = np.maximum(-(-(at - near - size + 1) // step), 0)
    hi = np.minimum((at + near) // step, (n[text] - size) // step)
    many = np.maximum(hi - lo + 1, 0)
    steps = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    whole = np.unique(np.repeat(s, many) + steps * step)
    own = np.unique(text)
    last = own[n[own] > size]
    clipped, sizes = _clipped(starts[own], n[own], size, step)
    places = np.concatenate((whole, starts[last] + n[last] - size, clipped))
    sizes = np.concatenate((np.full(len(whole) + len(last), size), sizes))
    text = np.searchsorted(starts, places, side="right") - 1
    some = np.searchsorted(hits, np.minimum(places + sizes + near, starts[text] + n[text])) > np.searchsorted(hits, np.maximum(places - near, starts[text]))
    return places[some], sizes[some], text[some]


class _Search:
    """Collects what of documents has something to verify, and looks it up when there is enough."""

    def __init__(self, bench: Benchmark) -> None:
        self.bench = bench
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple[tuple[int | None, int], np.ndarray, np.ndarray]] = []  # (id, hash of the text), places and shingles of hits
        self.found: dict[tuple[int, int], tuple[float, int, int]] = {}  # (document, item): (similarity, -distance, -first word)
        self.waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}  # by class: (prints, place, size, document)
        self.many = 0

    def keep(self, doc: int, k: int, similarity: float, distance: int, first: int) -> None:
        new = (similarity, -distance, -first)
        if similarity >= SIMILAR - 1e-9 and new > self.found.get((doc, k), (0.0, 0, 0)):
            self.found[doc, k] = new

    def add(self, ids: list[tuple[int | None, int]], texts: pa.Array) -> None:
        """``ids``: id and hash of each text."""
        raw = [as_bytes(t.as_py()) for t in texts]
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        spans = _words.spans(data)
        words = _words.hashes(data, spans)
        first = np.searchsorted(spans[0], np.cumsum([0, *[len(x) + 1 for x in raw]]))  # of each text, its first word
        starts, n = first[:-1], np.diff(first)
        some = n > 0
        starts, n, ids = starts[some], n[some], [i for i, x in zip(ids, some.tolist(), strict=True) if x]
        numbers: dict[int, int] = {}

        def document(text: int) -> int:
            if text not in numbers:
                numbers[text] = len(self.docs)
                self.docs.append((ids[text], np.zeros(0, np.int64), np.zeros(0, _U)))
            return numbers[text]

        for size in sorted({int(self.bench.lengths[k]) for k in self.bench.short}):
            own = {int(self.bench.shingles[k][0]): [] for k in self.bench.short if self.bench.lengths[k] == size}
            for k in self.bench.short:
                if self.bench.lengths[k] == size:
                    own[int(self.bench.shingles[k][0])].append(k)
            runs = windows(words, size)
            for a in np.flatnonzero(np.isin(runs, np.array(list(own), _U))).tolist():
                text = int(np.searchsorted(starts, a, side="right")) - 1
                if a + size <= starts[text] + n[text]:
                    for k in own[int(runs[a])]:
                        self.keep(document(text), k, 1.0, 0, a - int(starts[text]))
        if self.bench.filter is None or not len(words):
            return
        shingles = windows(words, SHINGLE)
        hits = self.bench.filter.places(shingles)
        text = np.searchsorted(starts, hits, side="right") - 1
        hits = hits[hits + SHINGLE <= starts[text] + n[text]]
        if not len(hits):
            return
        shorter = np.maximum(n - SHINGLE + 1, 0)
        text = np.searchsorted(starts, hits, side="right") - 1
        for t in np.unique(text).tolist():
            own = hits[np.searchsorted(text, t) : np.searchsorted(text, t, side="right")]
            number = document(t)
            self.docs[number] = (ids[t], own - starts[t], shingles[own])
        for c, (size, items) in enumerate(self.bench.classes):
            near = max(1, size // STEPS) + int(self.bench.lengths[items].max()) - (size + SHINGLE - 1)
            at, sizes, of = _windows_near(hits, starts, shorter, size, near)
            if len(at):
                prints = _fingerprints(shingles, at, sizes)
                self.waiting.setdefault(c, []).append((prints, at - starts[of], sizes, np.array([numbers[t] for t in of.tolist()])))
                self.many += len(at)

    def results(self) -> pa.RecordBatch:
        bench = self.bench
        for c, parts in self.waiting.items():
            prints, place, size, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            step = max(1, bench.classes[c][0] // STEPS)
            for shard in range(0, len(bench.classes[c][1]), SHARD):
                t = bench.table(c, shard)
                window, item, far = t.within(prints)
                tried: dict[tuple[int, int, int, int], float] = {}
                for w, k, f in zip(window.tolist(), t.items[item].tolist(), far.tolist(), strict=True):
                    reach = step + int(bench.lengths[k]) - (t.size + SHINGLE - 1)
                    _, at, shingles = self.docs[doc[w]]
                    lo, hi = np.searchsorted(at, (place[w] - reach, place[w] + size[w] + reach)).tolist()
                    key = (int(doc[w]), k, lo, hi)
                    if key not in tried:
                        tried[key] = bench.similarity(shingles[lo:hi], k)
                    self.keep(key[0], k, tried[key], f, int(place[w]))
        keys = sorted(self.found)
        values = [self.found[x] for x in keys]
        out = pa.RecordBatch.from_arrays(
            [
                *[pa.array([self.docs[d][0][k] for d, _ in keys], pa.int64()) for k in (0, 1)],
                pa.array([bench.ids[k] for _, k in keys], pa.int64()),
                pa.array([v[0] for v in values], pa.float64()),
                pa.array([-v[1] for v in values], pa.int32()),
                pa.array([-v[2] for v in values], pa.int64()),
            ],
            ["doc_id", "hash", "item_id", "similarity", "distance", "first_word"],
        )
        self.clear()
        return out


def _search(sent: Broadcast, key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables are built by each worker process, once for the pass it is at; only the items themselves travel."""
    keep_only("decontaminate", key)
    search = _Search(held("decontaminate", key, lambda: Benchmark(*sent.value)))
    for batch in batches:
        for part in slices(batch, rows=2000):
            search.add(list(zip(part.column("doc_id").to_pylist(), part.column("hash").to_pylist(), strict=True)), part.column("text"))
            if search.many > PENDING:
                yield search.results()
    yield search.results()


def contaminated(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """(doc_id, hash, item_id, similarity, distance, first_word) of every document and item that it holds; hash: of the text, 64 bits."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    spark, out, block, held_bytes = docs.sparkSession, None, [], 0
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.sha2("text", 256).alias("name"))
    counted = stored(named.where("text is not null").groupBy("name").agg(F.first("text").alias("text"), F.count("*").alias("n")).mapInArrow(tidy(_counted), "name string, n long, shingle long, length long"))
    sizes = _sizes([r["length"] for r in counted.select("length").distinct().collect()])
    several = counted.groupBy("shingle").agg(F.sum("n").alias("many")).where("many > 1")
    shared = counted.join(several, "shingle").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("shingle", "many"))).alias("shared"))

    def passed(rows: list[Item]) -> DataFrame:
        key = hashlib.blake2b(repr((rows, sizes)).encode("utf-8", "surrogatepass")).hexdigest()
        sent = spark.sparkContext.broadcast((rows, sizes))
        return docs.mapInArrow(tidy(lambda batches: _search(sent, key, batches), "decontaminate"), FOUND)

    for row in named.join(shared, "name", "left").select("item_id", "text", "shared").toLocalIterator():
        block.append((row["item_id"], row["text"], [(x, many) for x, many in row["shared"] or ()]))
        held_bytes += len(row["text"] or "") + 16 * len(block[-1][2])
        if len(block) == items or held_bytes > ITEM_BYTES:
            found = passed(block)
            out, block, held_bytes = (found if out is None else out.union(found)), [], 0
    if block:
        found = passed(block)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).drop("hash")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no item of the benchmark is found. Rows of one id are told apart by the hash of their text, so a clean row stays."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    key, hashed = fresh("_id", docs), fresh("_hash", docs)
    found = found.select(F.col("doc_id").alias(key), F.col("hash").alias(hashed)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(hashed)), "left_anti")
