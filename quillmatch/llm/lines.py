"""Line dedup by an edit join that partitions lines into segments (Pass-Join).

Lines are the ``\\n``-split parts of a text, trimmed of spaces, tabs and carriage returns.
A line of ``MIN_CHARS`` code points or more is removed if an earlier line, in the order of
(doc_id, hash of the text, line number), is equal to it or belongs to the same class of lines; classes are
the connected components of lines within so many insertions, deletions or substitutions
of each other as the shorter may have: one for each ``CHARS_AN_EDIT`` code points, at most
``EDITS``. Lines of fewer than ``CHARS_AN_EDIT`` thus go as exact repeats only. Lines
without text always stay.

1. Lines are grouped by a 128-bit digest after repeats in a batch of a task were dropped,
   so a line that a third of all documents hold is one row a batch.
2. A distinct line of length n with k edits is cut into k + 1 segments; of two lines within
   the edits of the shorter one segment of it stands unchanged in the longer, near its
   place. Every line with an edit therefore enters the cells (length, segment number,
   segment) of its own segments, and probes the cells of lengths n - k to n with those substrings that the
   multi-match-aware window of Pass-Join allows. Cells are 16 bytes a line; those without
   a pair go before any text moves.
3. In a cell, pairs whose character counts differ too much are excluded by a matrix of
   counts, and the rest is verified with a bit-parallel edit distance on the band of
   cells within EDITS of the diagonal. A line that was reached is not compared again; cells
   emit trees, never all pairs. A cell beyond ``BLOCK`` lines takes one as a pivot: the lines
   within the edits of that belong together and meet only the rest, in blocks with one task
   for each pair of blocks.

Null texts stay null and have no lines. Null ids come first. Rows of one id are told apart
by a 64-bit hash of the text; rows equal in both are one document and stay equal to each
other. Empty tables give empty results. Other columns of the input are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.llm.shared import bounds, components, fresh, slices, sorted_runs, stored, table, tidy, tree_edges

EDITS, MIN_CHARS, CHARS_AN_EDIT, BLOCK = 2, 1, 16, 2048
#: Longs (16 MB) that may be broadcast, counted before; more are joined by a shuffle.
BROADCAST_LONGS = 2 << 20
TRIM = " \t\r"


def allowed(n: int, edits: int) -> int:
    """How many edits a line of length n may be from a line that is not shorter."""
    return min(edits, n // CHARS_AN_EDIT)


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, end) of the segments of a line of length n; the later ones are longer by one where n doesn't divide."""
    short, more = divmod(n, parts)
    out, at = [], 0
    for k in range(parts):
        size = short + (k >= parts - more)
        out.append((at, at + size))
        at += size
    return out


_plans: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}


def probes(n: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(length of the shorter line, segment number, start, end) of the substrings of a line of length n that can match a segment; first its own segments."""
    if (n, edits) not in _plans:
        out = [(n, k, a, b) for k, (a, b) in enumerate(segments(n, allowed(n, edits) + 1))]
        for shorter in range(max(n - edits, edits + 1), n + 1):
            more, few = n - shorter, allowed(shorter, edits)
            if not few or more > few:
                continue
            for k, (a, b) in enumerate(segments(shorter, few + 1)):
                lo = max(a - k, a + more - (few - k), 0)
                hi = min(a + k, a + more + (few - k), n - (b - a))
                out += [(shorter, k, p, p + b - a) for p in range(lo, hi + 1) if (shorter, p) != (n, a)]
        _plans[n, edits] = out
    return _plans[n, edits]


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``.

    After the common ends are cut off, one bit vector for each number of edits holds
    the diagonals (2 * edits + 1 of them, the band) that are reached with so many.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < hi - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lo : len(a) - tail], b[lo : len(b) - tail]
    n = len(a)
    if not n or not b:
        return n + len(b) <= edits
    # Bit r: diagonal r - edits, that is, j + r - edits characters of a against j of b.
    valid = [sum(1 << r for r in range(2 * edits + 1) if 0 <= j + r - edits <= n) for j in range(len(b) + 1)]
    reached, sofar = [], 0
    for e in range(edits + 1):
        sofar = (sofar | sofar << 1 | 1 << edits) & valid[0]
        reached.append(sofar)
    for j, ch in enumerate(b):
        hits = 0
        for r in range(2 * edits + 1):
            if 0 <= j + r - edits < n and a[j + r - edits] == ch:
                hits |= 1 << r
        new = [reached[0] & hits & valid[j + 1]]
        for e in range(1, edits + 1):
            less = reached[e - 1]
            new.append((reached[e] & hits | less | less >> 1 | new[e - 1] << 1) & valid[j + 1])
        reached = new
        if not reached[edits]:
            return False
    end = n - len(b) + edits
    return bool(0 <= end <= 2 * edits and reached[edits] >> end & 1)


def digest(line: str) -> tuple[int, int]:
    """128 bits of a line, as two longs."""
    raw = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def long_lines(text: str | None, least: int) -> Iterator[tuple[int, str]]:
    """(number, trimmed line) of the lines of at least so many code points."""
    for at, line in enumerate(text.split("\n") if text is not None else ()):
        line = line.strip(TRIM)
        if len(line) >= least:
            yield at, line


def _first_lines(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, hash, text) to the first occurrence in a slice of a batch of each long line: (h1, h2, doc_id, hash, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=10_000, most=8 << 20):
                first: dict[tuple[int, int], tuple] = {}
                for doc, hashed, text in zip(part.column("doc_id").to_pylist(), part.column("hash").to_pylist(), part.column("text"), strict=True):
                    for at, line in long_lines(text.as_py(), least):
                        name, key = digest(line), (doc is not None, doc or 0, hashed, at)
                        if name not in first or key < first[name]:
                            first[name] = key
                docs = [v[1] if v[0] else None for v in first.values()]
                longs = [[k[0] for k in first], [k[1] for k in first], docs, [v[2] for v in first.values()]]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in longs], pa.array([v[3] for v in first.values()], pa.int32())], ["h1", "h2", "doc_id", "hash", "at"])

    return run


def _cells(least: int, edits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text) to (cell, lid) of each line that may have an edit, once a batch; the lowest bit of lid is 1 where the cell is of a segment of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in slices(batch, rows=2000, most=4 << 20):
                seen: set[tuple[int, int]] = set()
                cells: list[int] = []
                lids: list[int] = []
                for text in part.column("text"):
                    for _, line in long_lines(text.as_py(), least):
                        n = len(line)
                        own = allowed(n, edits) + 1
                        if own == 1:
                            continue
                        name = digest(line)
                        if name in seen:
                            continue
                        seen.add(name)
                        lid = name[0] & -2
                        for shorter, number, a, b in probes(n, edits):
                            cells.append(hashed(line[a:b], shorter * 64 + number))
                        plan = len(probes(n, edits))
                        lids += [lid | 1] * own + [lid] * (plan - own)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(cells, np.uint64).view(np.int64)), pa.array(lids, pa.int64())], ["cell", "lid"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, lid) sorted by cell and then by the lowest bit of lid, ones first, those of cells with two lines of which one has the segment as its own. One row is held at a time beyond its batch."""
    cell_, first, owned, several = None, 0, False, False  # the cell so far: its first lid, whether it is owned, whether it has two lines
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, lid = batch.column("cell").to_numpy(), batch.column("lid").to_numpy()
        at = bounds(cell)
        group = np.repeat(np.arange(len(at) - 1), np.diff(at))
        head, own = lid[at[:-1]] & -2, (lid[at[:-1]] & 1).astype(bool)
        goes_on = cell_ == cell[0]
        if goes_on:
            head[0], own[0] = first, owned
        two = np.bincount(group, (lid & -2) != head[group]) > 0
        late = np.array([[cell_, first]] if goes_on and owned and two[0] and not several else [], np.int64).reshape(-1, 2)
        if goes_on:
            two[0] |= several
        keep = (two & own)[group]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cell[keep], late[:, 0])), pa.array(np.append(lid[keep] & -2, late[:, 1]))], ["cell", "lid"])
        if len(at) > 2 or not goes_on:
            cell_, several = cell[-1], False
        first, owned, several = int(head[-1]), bool(own[-1]), bool(two[-1])


def _texts(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (text, wanted) to the lines whose first long is wanted: (lid, line, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: dict[bytes, tuple[int, str]] = {}
                for text, wanted in zip(part.column("text"), part.column("wanted").to_pylist(), strict=True):
                    wanted = set(wanted)
                    for _, line in long_lines(text.as_py(), least):
                        h1, h2 = digest(line)
                        if h1 in wanted:
                            out[name_of(h1, h2)] = (h1 & -2, line)
                yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in out.values()], pa.int64()), pa.array(list(out), pa.binary()), pa.array([v[1] for v in out.values()], pa.string())], ["lid", "line", "text"])

    return run


def name_of(h1: int, h2: int) -> bytes:
    return h1.to_bytes(8, "big", signed=True) + h2.to_bytes(8, "big", signed=True)


def tree(lines: list[str], edits: int, labels: list[bytes] | None = None) -> list[tuple[int, int]]:
    """Edges of trees over what is connected by at most ``edits`` edits, fewer for short lines; each line that was reached is compared with those that were not. Lines of one label belong together from the start."""
    counts = np.zeros((len(lines), 64), np.int16)
    for k, line in enumerate(lines):
        counts[k] = np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") % 64, minlength=64)
    numbers: dict[bytes, int] = {}
    own = np.array([numbers.setdefault(x, k) for k, x in enumerate(labels)]) if labels else np.arange(len(lines))
    shared = len(numbers) < len(lines) if labels else False
    free = np.ones(len(lines), bool)
    edges = []
    for seed in range(len(lines)):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            if shared:
                same = np.flatnonzero(free & (own == own[i]))
                free[same] = False
                queue.extend(same.tolist())
            rest = np.flatnonzero(free)
            if not len(rest):
                return edges
            # An edit changes at most two counts by one.
            for j in rest[np.abs(counts[rest] - counts[i]).sum(1) <= 2 * edits].tolist():
                if within(lines[i], lines[j], allowed(min(len(lines[i]), len(lines[j])), edits)):
                    free[j] = False
                    edges.append((i, j))
                    queue.append(j)
    return edges


def _trees(edits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (g, node, label, n, data) sorted by g to edges (a, b) of labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_runs(batches, "g"):
            at = bounds(group["g"].to_numpy())
            names, labels, texts = (group[c].to_pylist() for c in ("node", "label", "data"))
            a, b = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                first = list({names[k]: k for k in range(lo, hi)}.values())
                own = [labels[k] for k in first]
                for i, j in tree([texts[k] for k in first], edits, own) if len(first) > 1 else ():
                    a.append(own[i])
                    b.append(own[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _matched(edits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the pivot p of their key: with ``linked``, whether they are within the edits of the shorter one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("data").to_pylist(), pa.compute.struct_field(batch.column("p"), "data").to_pylist(), strict=True)
            yield batch.append_column("linked", pa.array([within(x, y, allowed(min(len(x), len(y)), edits)) for x, y in pairs], pa.bool_()))

    return run


def _kept(least: int, name: str, lines: str, gone: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with text and ``name`` (numbers of the long lines that stay) to rows with the new text, and the numbers of lines before and removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, before, removed = [], [], []
                for text, kept in zip(part.column("text"), part.column(name).to_pylist(), strict=True):
                    text = text.as_py()
                    own = text.split("\n") if text is not None else []
                    stay = set(kept or ())
                    out = [x for at, x in enumerate(own) if at in stay or len(x.strip(TRIM)) < least]
                    texts.append(None if text is None else "\n".join(out))
                    before.append(len(own))
                    removed.append(len(own) - len(out))
                names = [n for n in part.schema.names if n != name]
                columns = [pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(removed, pa.int64())], [*names, lines, gone])

    return run


def edit_classes(docs: DataFrame, first: DataFrame, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """(node, root) of the long lines that are within ``edits`` of another one, by their 16-byte names; ``docs``: doc_id, hash, text; ``first``: (h1, h2, doc_id, hash, at) of every distinct line."""
    cells = docs.select("text").mapInArrow(tidy(_cells(least, edits)), "cell long, lid long").repartition("cell")
    cells = cells.sortWithinPartitions("cell", F.col("lid").bitwiseAND(F.lit(1)).desc())
    active = stored(cells.mapInArrow(tidy(_pairs), "cell long, lid long").distinct())
    lids = active.select("lid").distinct()
    where = first.withColumn("lid", F.col("h1").bitwiseAND(F.lit(-2))).join(lids, "lid").groupBy("doc_id", "hash").agg(F.collect_set("h1").alias("wanted"))
    where = stored(where.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"}))
    if (where.agg(F.sum(F.size("wanted") + 4).alias("n")).first()["n"] or 0) <= BROADCAST_LONGS:
        where = F.broadcast(where)
    texts = docs.join(where, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("text", "wanted").mapInArrow(tidy(_texts(least)), "lid long, line binary, text string")
    texts = texts.groupBy("line").agg(F.first("lid").alias("lid"), F.first("text").alias("data"))
    facts = texts.select("lid", F.col("line").alias("node"), F.col("line").alias("label"), F.length("data").cast("long").alias("n"), "data")
    found, _ = tree_edges(active.withColumnRenamed("cell", "key"), stored(facts), F.lit(1), BLOCK, _trees(edits), _matched(edits))
    return components(found)


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with text without the lines that repeat an earlier one, and two columns more: how many lines a row had and how many went. Columns of these names are replaced."""
    docs = docs.drop(n_lines, n_removed)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    firsts = slim.mapInArrow(tidy(_first_lines(least)), "h1 long, h2 long, doc_id long, hash long, at int")
    first = firsts.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "hash", "at")).alias("f"))
    first = stored(first.select("h1", "h2", "f.*"))
    classes = edit_classes(slim, first, edits, least)
    named = first.withColumn("node", F.unhex(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))))
    by_class = named.join(classes, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("doc_id", "hash", "at")).alias("f"))
    key, hashed, stay = fresh("_id", docs), fresh("_hash", docs), fresh("_kept", docs)
    kept = by_class.select("f.*").groupBy(F.col("doc_id").alias(key), F.col("hash").alias(hashed)).agg(F.collect_list("at").alias(stay))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(hashed))
    joined = docs.join(kept, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], stay)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_removed, T.LongType())])
    return joined.mapInArrow(tidy(_kept(least, stay, n_lines, n_removed)), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated lines, with n_chars of what is left. A document of which nothing is left, as all its lines stand elsewhere, goes."""
    before, gone = fresh("_n_lines", docs), fresh("_n_removed", docs)
    out = dedup_lines(docs, n_lines=before, n_removed=gone)
    out = out.where(F.col("text").isNull() | (F.col(gone) == 0) | (F.length(F.trim("text")) > 0))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
