"""Exact n-gram Jaccard join as a metric-space join.

Jaccard distance d = 1 - J is a metric on shingle sets; texts link when d <= 0.25.

1. Pivots of the first level are the one-shingle sets, in one order for all texts: by
   hash, but frequent shingles last. A text is nearest to those of its own shingles, and
   the window that has to be replicated into is exact, whatever the order: of two linked
   sets of n and m shingles, at least 0.75 n and 0.75 m are common, so the first
   n - ceil(0.75 n) + 1 shingles of the one and the likewise many of the other have one in
   common. A text enters the cells of those. Frequent shingles are those that several texts
   of a slice have, counted over all slices; only the order depends on them, so that a
   phrase in a third of all texts is not what brings them together, and the list is kept
   to the ``FREQUENT`` most frequent ones, which are broadcast.
   Cells where no other text has a size within the radius go at once; of a cell that many
   texts of a batch enter, one row travels for all of one size.
2. In a cell, texts are put into one family if they could be within the radius: a bit for
   each class of shingles (``BITS`` classes, more for large sets, one a shingle at least)
   says whether their number is odd. An element that only one of two sets has flips one
   bit, so the bits that differ are no more than the symmetric difference, and linked sets
   pass. The first round does
   this in the first ``CELLS`` cells of each text; the second in all others, but only where
   texts meet that the first has not linked.
3. Families are regions. In each, pivots are texts chosen farthest-first; every text
   goes to its nearest pivot (Voronoi) and is replicated to each pivot p with
   d(x, p) <= d(x, nearest) + 2 * 0.25, which the triangle inequality shows to be enough
   for two texts within 0.25 to meet; regions are joined recursively. In a small region
   each text is compared exactly, on whole sets, with those that are not yet reached.

A cell beyond ``BLOCK`` bytes of bits (4096 texts of average length), or a family beyond ``BLOCK_SHINGLES``, takes one of its texts
as a pivot: what links with the pivot is done among itself and only meets the rest, in
blocks with a task for each pair of blocks. So no task holds an unbounded group; tasks
emit trees, never all pairs. Exact copies (equal word sequences) are one node throughout.

Shingles are 64-bit hashes and word sequences 128-bit ones. Nulls and texts without words
have an empty set and link with nothing. Rows with a null id take part; a component's id
is the smallest non-null id, or null if there is none. Equal rows are copies of each other.
Empty tables give empty results. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.llm.shared import SPACES, Words, as_bytes, bounds, components, discard, fresh, shared_folder, slices, sorted_runs, stored, table, tidy, tree_edges, windows, write_buckets

SHINGLE, NEAR = 5, 75
CELLS, BITS, LEAF, PIVOTS = 4, 1024, 512, 8
FREQUENT, OFTEN = 1 << 18, 8
BLOCK, BLOCK_SHINGLES = 1 << 19, 1 << 18  # bytes of bits in a task's cell, and shingles in a task's family
_U = np.uint64
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_words = Words(SPACES, lower=True)
_fold = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _split(text: str | None) -> tuple[bytes, bytes | None]:
    """(the text with A-Z lower-cased, 16-byte digest of the word sequence or None without words)."""
    raw = as_bytes(text).translate(_fold)
    split = raw.split()  # bytes.split() parts at \x20 and \x09-\x0D
    return raw, hashlib.blake2b(b" ".join(split), digest_size=16).digest() if split else None


def _shingles_of(raw: bytes) -> np.ndarray:
    words = _words.hashes(np.frombuffer(raw, np.uint8))
    return np.unique(windows(words, min(SHINGLE, len(words)))) if len(words) else words


def shingles(text: str | None) -> tuple[np.ndarray, bytes | None]:
    """(sorted distinct hashes of the shingles, 16-byte digest of the word sequence or None without words)."""
    raw, node = _split(text)
    return _shingles_of(raw), node


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with text to rows with node in its place."""
    for batch in batches:
        for part in slices(batch):
            nodes = pa.array([_split(t.as_py())[1] for t in part.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes if n == "text" else part.column(n) for n in part.schema.names], ["node" if n == "text" else n for n in part.schema.names])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to (node, text), one for each node of a batch."""
    for batch in batches:
        seen: set[bytes | None] = {None}
        for part in slices(batch):
            nodes, keep = [], []
            for k, t in enumerate(part.column("text")):
                node = _split(t.as_py())[1]
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    keep.append(k)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), part.column("text").take(pa.array(keep))], ["node", "text"])


# A text's number: the high bits of its node, then its size class in steps of 1/16 of a doubling, a bit for witnesses, and one for its first CELLS cells.
SIZE_BITS, LEVELS, APART = 9, 16, 7  # sizes within the ratio 0.75 are at most 6.7 steps apart, 7 when rounded down


def _bits(s: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each class of low bits is odd, as words of 64 bits."""
    n = max(BITS, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & _U(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1).view(_U)


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    """The bits of fewer classes."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def _gap(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets, from their bits."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum())


def _prefix(n: int) -> int:
    """How many of the least shingles hold a common one of any two linked sets."""
    return n - -(-NEAR * n // 100) + 1


_SUMMARY = T.StructType(
    [T.StructField("node", T.BinaryType()), T.StructField("lid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("cells", T.ArrayType(T.LongType()))]
)


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to (cell, n): the shingles that n texts of a slice have, two or more."""
    for batch in batches:
        for part in slices(batch, rows=10_000, most=4 << 20):
            cells, n = np.unique(np.concatenate([_shingles_of(as_bytes(t.as_py()).translate(_fold)) for t in part.column("text")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells[n > 1].view(np.int64)), pa.array(n[n > 1])], ["cell", "n"])


def _frequent(texts: DataFrame) -> np.ndarray:
    """The most frequent shingles, sorted; at most ``FREQUENT``."""
    found = texts.select("text").mapInArrow(tidy(_several), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "cell").limit(FREQUENT).select("cell").toArrow()
    return np.sort(rows["cell"].to_numpy().view(_U))


def _summaries(sent: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) to what the first level needs of each."""
    frequent = sent.value
    some = np.zeros(1 << 16, bool)
    some[frequent & _U(0xFFFF)] = True

    def ordered(s: np.ndarray) -> np.ndarray:
        often = some[s & _U(0xFFFF)]
        at = np.flatnonzero(often)
        often[at] = frequent[np.minimum(np.searchsorted(frequent, s[at]), len(frequent) - 1)] == s[at] if len(at) else False
        return np.concatenate((s[~often], s[often]))

    for batch in batches:
        for part in slices(batch):
            nodes, lids, sizes, bits, cells = part.column("node").to_pylist(), [], [], [], []
            for node, text in zip(nodes, part.column("text"), strict=True):
                s = _shingles_of(as_bytes(text.as_py()).translate(_fold))
                level = min(int(LEVELS * np.log2(len(s))), (1 << SIZE_BITS) - 1)
                lids.append(int.from_bytes(node[:8], "little", signed=True) & -(1 << SIZE_BITS + 2) | level << 2)
                sizes.append(len(s))
                bits.append(_bits(s).tobytes())
                cells.append(ordered(s)[: _prefix(len(s))].view(np.int64))
            at = np.concatenate(([0], np.cumsum([len(c) for c in cells]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array(lids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(cells)))],
                ["node", "lid", "n", "bits", "cells"],
            )


def _to_cells(settled: bool) -> Run:
    """Rows (lid, cells) to (cell, lid): those that meet another of their size in a batch if ``settled``, else all others and for each meeting one witness (lid with bit 1 set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                lists = part.column("cells").flatten().to_numpy()
                n = np.diff(part.column("cells").offsets.to_numpy()).astype(np.int64)
                at = np.arange(len(lists)) - np.repeat(np.cumsum(n) - n, n)
                cell, lid = lists, np.repeat(part.column("lid").to_numpy(), n) | (at < CELLS)
                level = lid >> 2 & (1 << SIZE_BITS) - 1
                order = np.lexsort((level, cell))
                cell, lid, level = cell[order], lid[order], level[order]
                same = np.zeros(len(cell) + 1, bool)
                same[1:-1] = (cell[1:] == cell[:-1]) & (level[1:] == level[:-1])
                meets = same[1:] | same[:-1]
                if settled:
                    pick = np.flatnonzero(meets)
                else:
                    pick = np.flatnonzero(~meets | ~same[:-1])
                    lid = lid | meets << 1
                if len(pick):
                    yield pa.RecordBatch.from_arrays([pa.array(cell[pick]), pa.array(lid[pick])], ["cell", "lid"])

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, lid, level) sorted by cell and level, those that are no witnesses and have a neighbour of about their size. One row is held at a time beyond its batch."""
    last: tuple[int, int, int] | None = None  # cell, level and lid of the last row
    met = False  # whether it has a neighbour before it
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, lid, level = (batch.column(c).to_numpy() for c in ("cell", "lid", "level"))
        near = np.zeros(len(cell) + 1, bool)
        near[1:-1] = (cell[1:] == cell[:-1]) & (level[1:] - level[:-1] <= APART)
        near[0] = last is not None and last[0] == cell[0] and level[0] - last[1] <= APART
        keep = (near[1:] | near[:-1]) & (lid >> 1 & 1 == 0)
        keep[-1] = False  # it goes with the next batch
        cells, lids = cell[keep], lid[keep]
        if last is not None and (met or near[0]) and not last[2] >> 1 & 1:
            cells, lids = np.append(cells, last[0]), np.append(lids, last[2])
        last, met = (int(cell[-1]), int(level[-1]), int(lid[-1])), bool(near[-2])
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(lids)], ["cell", "lid"])
    if last is not None and met and not last[2] >> 1 & 1:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[2]], pa.int64())], ["cell", "lid"])


# ---------------------------------------------------------------- joins inside a region


class _Sets:
    """Sets of hashes with postings, for counts of common elements."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, _U)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, element = np.unique(flat, return_inverse=True)
        self.element, self.start = element, np.concatenate(([0], np.cumsum(self.sizes)))
        order = np.argsort(element, kind="stable")
        self.posting = owner[order]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(element)))) if len(element) else np.zeros(1, np.int64)

    def common(self, i: int) -> np.ndarray:
        """How many elements set i has in common with each."""
        mine = self.element[self.start[i] : self.start[i + 1]]
        lo, n = self.at[mine], self.at[mine + 1] - self.at[mine]
        where = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.posting[where], minlength=len(self.sizes))

    def distances(self, i: int) -> np.ndarray:
        c = self.common(i)
        return 1 - c / np.maximum(self.sizes + self.sizes[i] - c, 1)


class _Bits:
    """Lower bounds of symmetric differences, for sets of about one size."""

    def __init__(self, bits: list[np.ndarray], sizes: np.ndarray) -> None:
        self.bits, self.sizes = bits, sizes
        self.words = np.array([len(x) for x in bits])
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by words: the sets with so many or twice as many, and which they are

    def _of(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        if words not in self.rows:
            own = np.flatnonzero((self.words == words) | (self.words == 2 * words))
            self.rows[words] = np.stack([_folded(self.bits[k], words) for k in own]), own
        return self.rows[words]

    def near(self, i: int, ids: np.ndarray) -> np.ndarray:
        """Those of ``ids`` that could be within the radius of i: symmetric differences of linked sets are at most a seventh of both sizes."""
        ids = ids[7 * np.abs(self.sizes[ids] - self.sizes[i]) <= self.sizes[ids] + self.sizes[i]]
        out = []
        words = np.minimum(self.words[ids], self.words[i])
        for w in np.unique(words).tolist():
            rows, own = self._of(w)
            some = ids[words == w]
            gap = np.bitwise_count(rows[np.searchsorted(own, some)] ^ rows[np.searchsorted(own, i)]).sum(1, dtype=np.int64)
            out.append(some[7 * gap <= self.sizes[some] + self.sizes[i]])
        return np.concatenate(out) if out else ids


def _similar(x: _Sets, i: int, ids: np.ndarray) -> np.ndarray:
    c = x.common(i)[ids]
    return ids[(c > 0) & (100 * c >= NEAR * (x.sizes[ids] + x.sizes[i] - c))]


def _reach(near: Callable[[int, np.ndarray], np.ndarray], ids: np.ndarray, labels: np.ndarray, union: Callable[[int, int], None]) -> None:
    """Unites what is connected among ``ids``: each text that was reached looks only at those that were not. Texts of one label belong together from the start."""
    free = np.zeros(len(labels), bool)
    free[ids] = True
    shared = len(np.unique(labels[ids])) < len(ids)
    for seed in ids.tolist():
        if not free[seed]:
            continue
        queue = [seed]
        free[seed] = False
        while queue:
            i = queue.pop()
            if shared:
                own = ids[free[ids] & (labels[ids] == labels[i])]
                free[own] = False
                queue.extend(own.tolist())
            rest = ids[free[ids]]
            if not len(rest):
                return
            found = near(i, rest)
            free[found] = False
            for j in found.tolist():
                union(i, j)
            queue.extend(found.tolist())


def _regions(x: _Sets, ids: np.ndarray, labels: np.ndarray, union: Callable[[int, int], None]) -> None:
    """Joins ``ids`` exactly: Voronoi regions of pivots, replicated by the triangle inequality, recursively."""
    if len(ids) > LEAF:
        pivots, near = [int(ids[0])], x.distances(int(ids[0]))[ids]
        rows = [near]
        while len(pivots) < PIVOTS and near.max() > 0.5:
            pivots.append(int(ids[near.argmax()]))
            rows.append(x.distances(pivots[-1])[ids])
            near = np.minimum(near, rows[-1])
        inside = [ids[d <= near + 2 * (1 - NEAR / 100) + 1e-9] for d in rows]
        if max(map(len, inside)) < 0.8 * len(ids):
            for part in inside:
                _regions(x, part, labels, union)
            return
    _reach(lambda i, rest: _similar(x, i, rest), ids, labels, union)


def forest(data: list[np.ndarray], exact: bool, sizes: list[int] | None = None, labels: list[bytes] | None = None) -> list[tuple[int, int]]:
    """(root, member) of what is connected, root first among its members; of texts of one label the first stands for all. ``data``: whole sets if ``exact``, else bits."""
    numbers: dict[bytes, int] = {}
    own = np.array([numbers.setdefault(x, k) for k, x in enumerate(labels)]) if labels else np.arange(len(data))
    parent = list(range(len(data)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i: int, j: int) -> None:
        a, b = find(int(own[i])), find(int(own[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)

    ids = np.arange(len(data))
    if len(data) == 2:
        x, y = data
        c = len(np.intersect1d(x, y, assume_unique=True)) if exact else 0
        linked = c and 100 * c >= NEAR * (len(x) + len(y) - c) if exact else 7 * abs(sizes[0] - sizes[1]) <= sizes[0] + sizes[1] and 7 * _gap(x, y) <= sizes[0] + sizes[1]
        return [(0, 1)] if linked and own[1] else []
    if exact:
        _regions(_Sets(data), ids, own, union)
    else:
        x = _Bits(data, np.array(sizes, np.int64))
        _reach(x.near, ids, own, union)
    return [(r, i) for i in range(len(data)) if own[i] == i and (r := find(i)) != i]


def _forests(exact: bool) -> Run:
    """Rows (g, node, label, n, data) sorted by g to edges (a, b) of labels. Labels that a group has united are one label in the partition's later groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[bytes] = []
        b: list[bytes] = []
        parent: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for run_ in sorted_runs(batches, "g"):
            at = bounds(run_["g"].to_numpy())
            sizes, names = run_["n"].to_numpy(), run_["label"].to_pylist()
            nodes, data = run_["node"].to_pylist(), run_["data"]
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                first = {nodes[k]: k for k in range(lo, hi)}
                pick = list(first.values())
                labels = [find(names[k]) for k in pick]
                if len(set(labels)) < 2:
                    continue
                own = [np.frombuffer(data[k].as_buffer(), _U) for k in pick]
                for i, j in forest(own, exact, sizes[pick].tolist(), labels):
                    a.append(labels[i])
                    b.append(labels[j])
                    x, y = find(labels[i]), find(labels[j])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
            if len(a) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _matched(exact: bool) -> Run:
    """Rows with the pivot p of their key: with ``linked``, whether they are within its radius (or could be)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            pivots = batch.column("p")
            for k in range(batch.num_rows):
                own, pivot, n = batch.column("data")[k].as_buffer(), pivots[k], batch.column("n")[k].as_py()
                if exact:
                    x, y = np.frombuffer(own, _U), np.frombuffer(pivot["data"].as_buffer(), _U)
                    c = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * c >= NEAR * (len(x) + len(y) - c))
                else:
                    linked.append(7 * _gap(np.frombuffer(own, _U), np.frombuffer(pivot["data"].as_buffer(), _U)) <= n + pivot["n"].as_py())
            yield batch.append_column("linked", pa.array(linked, pa.bool_()))

    return run


def _labelled(edges: DataFrame, cut: bool) -> DataFrame:
    """(node, root) of the nodes of trees; those of different tasks can belong together if a key was ``cut``."""
    if cut:
        return components(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", F.col("a").alias("root")).distinct())


def _exact(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, bool]:
    """As ``tree_edges``, on whole sets, for members (node, label, root) of the families root."""
    whole = stored(texts.join(members.hint("shuffle_hash"), "node").select(F.xxhash64("root").alias("key"), "node", "label", "text").mapInArrow(tidy(_to_sets), "key long, node binary, label binary, n long, data binary"))
    return tree_edges(whole, None, F.col("n"), BLOCK_SHINGLES, _forests(True), _matched(True))


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = [_shingles_of(as_bytes(t.as_py()).translate(_fold)) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("key", "node", "label")], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "node", "label", "n", "data"]
            )


def _links(texts: DataFrame, sums: DataFrame) -> DataFrame:
    """(node, root) of every node that is linked with another."""
    cells = sums.select("lid", "cells")
    alone = cells.mapInArrow(tidy(_to_cells(False)), "cell long, lid long").withColumn("level", F.shiftright("lid", 2).bitwiseAND(F.lit((1 << SIZE_BITS) - 1)))
    meeting = alone.repartition("cell").sortWithinPartitions("cell", "level").mapInArrow(tidy(_meeting), "cell long, lid long")
    all_met = stored(cells.mapInArrow(tidy(_to_cells(True)), "cell long, lid long").union(meeting))
    near, lid = F.col("lid").bitwiseAND(F.lit(1)), F.col("lid").bitwiseAND(F.lit(-2))
    meeting = all_met.select("cell", lid.alias("lid"), near.alias("near"))
    facts = sums.select("lid", "node", "n", F.col("bits").alias("data"))

    # Bytes of a text's bits, from its size class.
    weight = F.greatest(F.lit(BITS / 8), F.pow(F.lit(2.0), F.shiftright("lid", 2).bitwiseAND(F.lit((1 << SIZE_BITS) - 1)) / LEVELS) * 3 / 16)
    bits = (_forests(False), _matched(False))
    maybe, _ = tree_edges(meeting.where("near = 1").select(F.col("cell").alias("key"), "lid"), facts.withColumn("label", F.col("node")), weight, BLOCK, *bits)
    families = components(maybe)
    first, cut = _exact(families.select("node", F.col("node").alias("label"), "root"), texts)
    found = stored(_labelled(first, cut))

    # The other cells, where texts of different components meet.
    label = stored(facts.join(found, "node", "left").select("lid", "node", F.coalesce("root", "node").alias("label"), "n", "data"))
    met = stored(meeting.join(label.select("lid", F.xxhash64("label").alias("of")), "lid"))
    discard(all_met)
    bridges = met.groupBy("cell").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.min("near").alias("near")).where("x <> y and near = 0").select("cell")
    apart = stored(met.join(bridges, "cell", "left_semi").select("cell", "lid").distinct())
    maybe, _ = tree_edges(apart.withColumnRenamed("cell", "key"), label, weight, BLOCK, *bits)
    if maybe.isEmpty():
        return found
    families = components(maybe).withColumnRenamed("node", "label")
    present = label.join(apart.select("lid").distinct(), "lid", "left_semi").select("node", "label")
    second, _ = _exact(present.join(families, "label"), texts)
    trees = found.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    return components(trees.union(second))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, root) of every row of ``docs`` (doc_id long, text string); node: digest of the word sequence, null without words; root: a node of the component, the same in all its rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(docs.mapInArrow(tidy(_named), "doc_id long, node binary"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("text").mapInArrow(tidy(_distinct), "node binary, text string").repartition(buckets, "node").groupBy("node").agg(F.first("text").alias("text"))
    texts = write_buckets(texts, shared_folder(docs.sparkSession), "node", buckets)
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(texts))
    sums = stored(texts.mapInArrow(tidy(lambda batches: _summaries(sent, batches)), _SUMMARY))
    label = _links(texts, sums)
    named = sums.select("node", "n").join(label, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "node")
    named = stored(named)
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = stored(named.join(least, "root").select("node", F.col("n").alias("n_shingles"), "component_id", "root"))
    discard(texts)
    discard(sums)
    with_words = rows.where("node is not null").join(named, "node").select("doc_id", "n_shingles", "component_id", "node", "root")
    return with_words.union(rows.where("node is null").select("doc_id", F.lit(0).cast("long"), "doc_id", "node", "node"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, and all rows without words, with their own columns.

    The row that stays is that of the component's id (null if all its ids are); where several rows have that id
    and belong to the component, the one of the least node and, among rows of one node, of the least hash of all columns.
    """
    key, node, pick = fresh("_id", docs), fresh("_node", docs), fresh("_row", docs)
    found = stored(jaccard_components(docs))
    chosen = found.where("node is not null and doc_id <=> component_id").groupBy("doc_id", "root").agg(F.min("node").alias("node"))
    chosen = stored(chosen.select(F.col("doc_id").alias(key), F.col("node").alias(node)).union(found.where("node is null").select("doc_id", "node").distinct()))
    several = stored(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(key)))
    same_id = F.col("doc_id").eqNullSafe(F.col(key))
    once = chosen.join(several.withColumnRenamed(key, pick), F.col(key).eqNullSafe(F.col(pick)), "left_anti")
    kept = docs.join(once, same_id, "left_semi")
    if several.isEmpty():
        return kept
    # Rows whose id others have too: told apart by their words.
    own = docs.join(several, same_id, "left_semi").withColumn(node, F.col("text"))
    own = own.mapInArrow(tidy(_with_node(node)), T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())]))
    wanted = chosen.select(F.col(key), F.col(node).alias(pick))
    own = own.join(wanted, same_id & F.col(node).eqNullSafe(F.col(pick)), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") if not isinstance(f.dataType, T.MapType) else F.size(F.col(f"`{f.name}`")) for f in docs.schema.fields])
    one = own.where(F.col(node).isNotNull()).groupBy("doc_id", node).agg(F.min_by(F.struct(*columns), hashed).alias(pick)).select(f"`{pick}`.*")
    return kept.unionByName(own.where(F.col(node).isNull()).select(*columns)).unionByName(one)


def _with_node(name: str) -> Run:
    """Rows whose column ``name`` is a text to rows where it is the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, name):
                nodes = pa.array([_split(t.as_py())[1] for t in part.column(name)], pa.binary())
                yield pa.RecordBatch.from_arrays([nodes if n == name else part.column(n) for n in part.schema.names], part.schema.names)

    return run


#: For DuckDB: shingle sets, all links, and what they reach.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT k, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d
), e AS (SELECT k, unnest(g) AS x FROM s),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s p ON p.k = a JOIN s q ON q.k = b WHERE 100 * n >= 75 * (len(p.g) + len(q.g) - n)),
t AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT k, k AS z FROM s UNION SELECT t.b, r.z FROM r JOIN t ON t.a = r.k)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT r.k, min(y.doc_id) AS component_id FROM r JOIN s y ON y.k = r.z GROUP BY 1) m ON m.k = s.k
"""
