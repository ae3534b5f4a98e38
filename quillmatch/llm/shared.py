"""What several operators need: shared tables, and words as arrays of hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.operators.graph import components, discard, shared_folder, stored

__all__ = [
    "NOT_ALNUM", "SPACES", "Words", "as_bytes", "bounds", "components", "discard", "fresh", "held", "keep_only", "read_buckets", "shared_folder", "slices", "sliding_min", "small_batches",
    "sorted_runs", "stored", "table", "tidy", "tree_edges", "windows", "write_buckets",
]

Batches = Iterator[pa.RecordBatch]


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``rows`` as Parquet in buckets of a column, each sorted by it; rows that are dealt by the column already need no shuffle. Read back, they can be joined and grouped by it without one."""
    entry = f"quillmatch_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(entry)
    rows.sparkSession.sql(f"DROP TABLE {entry}")  # the files stay
    return read_buckets(rows.sparkSession, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), key, buckets)


def read_buckets(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    entry = f"quillmatch_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {entry} ({schema}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS")
    rows = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return rows


# ---------------------------------------------------------------- what a worker process holds

_held: dict[tuple, object] = {}
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library than glibc
    _trim = None


def held(owner: str, key: object, build: Callable[[], object]) -> object:
    """What an operator keeps in a worker process from task to task: one value for each owner and key."""
    if (owner, key) not in _held:
        _held[owner, key] = build()
    return _held[owner, key]


def keep_only(owner: str | None, key: object = None) -> None:
    """What other operators keep goes, and with a key what the owner keeps under others, so that a worker's memory doesn't add up over stages."""
    gone = [k for k in _held if k[0] != owner or (key is not None and k[1] != key)]
    for k in gone:
        del _held[k]
    if gone:
        give_back()


def give_back() -> None:
    """Free memory goes back to the system; allocators would keep it for a worker's next task."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs inside gets Arrow batches of at most so many rows, for rows of whole texts or ids."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(run: Callable[[Batches], Batches], owner: str | None = None) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, in a worker process that holds nothing of other operators and gives its memory back at the end."""

    def task(batches: Batches) -> Batches:
        keep_only(owner)
        yield from run(batches)
        give_back()

    return task


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 1000, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each of at most so many rows and bytes of ``column``, but one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        end = min(max(end, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


# ---------------------------------------------------------------- links in groups of any size


def tree_edges(keyed: DataFrame, facts: DataFrame | None, weight: Column, most: int, forests: Callable[[Batches], Batches], matched: Callable[[Batches], Batches]) -> tuple[DataFrame, bool]:
    """(Trees of labels (a, b) of what is linked in each key; whether a key was cut).

    ``keyed``: key, and node, label, n, data or the lid by which ``facts`` has them. ``forests``: rows (g, node, label, n,
    data) sorted by g to trees (a, b) of the labels in each g. ``matched``: rows with p, another row of the key, to rows
    with linked, whether they are.

    A key whose ``weight`` (of ``keyed``) sums to more than ``most`` takes its least node as a pivot: what is linked with
    that belongs together and only meets the rest, in blocks by node, with a g for each pair of blocks.
    """
    totals = stored(keyed.groupBy("key").agg(F.count("*").alias("rows"), F.ceil(F.sum(weight) / F.lit(float(most))).cast("int").alias("blocks")))
    sized = keyed.join(totals.where("rows > 1").drop("rows"), "key")
    sized = sized if facts is None else sized.join(facts, "lid")
    columns = ["key", "node", "label", "n", "data"]

    def trees(grouped: DataFrame) -> DataFrame:
        return grouped.select("g", *columns[1:]).repartition("g").sortWithinPartitions("g").mapInArrow(tidy(forests), "a binary, b binary")

    found = stored(trees(sized.where("blocks <= 1").withColumn("g", F.xxhash64("key"))))
    if totals.where("rows > 1 and blocks > 1").isEmpty():
        return found, False
    hot = stored(sized.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    pivots = hot.groupBy("key").agg(F.min_by(F.struct("node", "label", "n", "data"), "node").alias("p"), F.first("blocks").alias("blocks"))
    pivots = pivots.select("key", "p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    schema = T.StructType([*hot.join(pivots, ["key", "own"]).schema.fields, T.StructField("linked", T.BooleanType())])
    hot = stored(hot.join(pivots, ["key", "own"]).mapInArrow(tidy(matched), schema))
    star = hot.where("linked and label <> p.label").select(F.col("p.label").alias("a"), F.col("label").alias("b"))
    rest = stored(hot.where("not linked").groupBy("key").agg(F.ceil(F.sum(weight) / F.lit(float(most))).cast("int").alias("others")))
    hot = hot.withColumn("label", F.when(F.col("linked"), F.col("p.label")).otherwise(F.col("label"))).join(rest, "key")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), "others").cast("int")
    with_others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.xxhash64("key", F.lit("m"), "own", j))
    with_linked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.xxhash64("key", F.lit("m"), i, mine))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.xxhash64("key", F.lit("o"), F.least(mine, j), F.greatest(mine, j)))
    cut = hot.withColumn("g", F.explode(F.when(F.col("linked"), with_others).otherwise(F.concat(with_linked, among))))
    return found.union(star).union(stored(trees(cut))), True


def sorted_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of consecutive equal ``key`` (a long without nulls) in a partition sorted by it, as tables that hold whole groups."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        keys = now[key].to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and held and held[-1][key][-1].as_py() == keys[-1]:
            held.append(now)
            continue
        if held:
            if last:
                held.append(now.slice(0, last))
            yield pa.concat_tables(held).combine_chunks()
            held = [now.slice(last)]
        else:
            if last:
                yield now.slice(0, last)
            held = [now.slice(last)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbours starts, and the end."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)


# ---------------------------------------------------------------- words as hashes

_U = np.uint64
PART = 1 << 19  # bytes, or words, that are summed at a time
_BASE, _BASE_W = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self, base: np.uint64) -> None:
        self.bases, self.have = (base, _U(_inverse(int(base)))), (np.ones(1, _U), np.ones(1, _U))

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.have[0]) < n:
            out = []
            for base, had in zip(self.bases, self.have, strict=True):
                grown = np.full(max(n, 2 * len(had), 1 << 14), base, _U)
                grown[0] = _U(1)
                out.append(np.multiply.accumulate(grown))
            self.have = (out[0], out[1])
        return self.have[0][:n], self.have[1][:n]


_by_byte, _by_word = _Powers(_BASE), _Powers(_BASE_W)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


class Words:
    """Splits UTF-8 bytes into words and hashes them, all in numpy.

    ``separators``: the bytes that part words. ``lower``: A-Z count as a-z. Bytes of
    characters beyond ASCII are never separators, so words match those of a pattern
    over code points whose excluded characters are all ASCII.
    """

    def __init__(self, separators: Iterable[int], lower: bool, seed: int = 1) -> None:
        self.part = np.zeros(256, bool)
        self.part[list(separators)] = True
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
        if lower:
            self.values[65:91] = self.values[97:123]

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words."""
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = ~self.part[data]
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def hashes(self, data: np.ndarray, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """A 64-bit hash of each word; a word's doesn't depend on its place, so long texts go in parts."""
        starts, ends = spans if spans is not None else self.spans(data)
        out = np.empty(len(starts), _U)
        k = 0
        while k < len(starts):
            stop = max(k + 1, int(np.searchsorted(ends, starts[k] + PART, side="right")))
            lo, hi = int(starts[k]), int(ends[stop - 1])
            up, down = _by_byte(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, _U)
            np.cumsum(self.values[data[lo:hi]] * up[:-1], out=sums[1:])
            a, b = starts[k:stop] - lo, ends[k:stop] - lo
            out[k:stop] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(_U))
            k = stop
        return out


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    out = np.empty(max(len(words) - size + 1, 0), _U)
    for k in range(0, len(out), PART):
        own = words[k : k + PART + size - 1]
        up, down = _by_word(len(own) + 1)
        sums = np.zeros(len(own) + 1, _U)
        np.cumsum(own * up[:-1], out=sums[1:])
        out[k : k + PART] = mixed((sums[size:] - sums[:-size]) * down[: len(own) - size + 1])
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    if len(x) < size:
        return x[:0]
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = size - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


#: The separators of the patterns [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing).
SPACES = (0x20, *range(0x09, 0x0E))
NOT_ALNUM = (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
