"""Removal of repeated passages with a log-structured fingerprint index.

The index holds a fingerprint of every window of ``WINDOW`` words: its *anchor*, the least
hash among its runs of ``GRAM`` words. Equal windows have equal anchors, and neighbouring
windows mostly have the same one, so anchors are about 7 % of the words.

Texts enter in batches. A batch is written as an immutable run: rows (fingerprint, text)
in buckets of the fingerprint, each sorted by it. The run is merge-joined with the runs
before it, bucket by bucket and without a shuffle, and so are its own fingerprints that two
places have. Only windows with such an anchor can be repeated; they are verified, in the
batch and in the earlier texts that the matching rows of the runs name, by 128-bit hashes
of their words (two independent 64-bit ones). So what a batch finds holds for the batch
and for the texts before it, and in the end every window was judged on all texts.
``compact`` merges runs into one, again bucket by bucket. The index keeps the distinct
texts, in buckets too, as they are smaller than the hashes of all their windows. A manifest
names its tables; the greatest version holds, so an index can be opened again, and rows of
a later call are judged by what earlier calls have added.

Texts with equal word sequences are one node. A node of two rows or more, or of a row and
an earlier call, needs no comparison: every window of it also starts in the copy. Before
rows with window hashes are shuffled, those that repeat within a batch of a task are settled
there and leave one witness, so a passage that a third of all documents hold crosses the
network once a batch and not once a document; the stream that settles the rest keeps one
row of a window at a time.

Null and empty texts have no words: n_words and n_removed are 0 and the digest is that
of an empty string. Windows never span rows. Equal rows are repetitions of each other.
Null ids are values like others. Empty tables give empty results. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.shared import SPACES, Words, as_bytes, read_buckets, shared_folder, slices, sliding_min, stored, table, tidy, windows, write_buckets

WINDOW, GRAM, BATCHES, MOST_RUNS = 35, 8, 2, 4
_one, _two = Words(SPACES, lower=False, seed=1), Words(SPACES, lower=False, seed=2)


def node_of(text: str | None) -> tuple[str, bytes, list[bytes]]:
    """(digest of the words joined by spaces, its first 16 bytes, the words)."""
    words = as_bytes(text).split()
    digest = hashlib.sha256(b" ".join(words))
    return digest.hexdigest(), digest.digest()[:16], words


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the GRAM-word runs, the anchor of each window)."""
    grams = windows(_one.hashes(data), GRAM)
    return grams, sliding_min(grams, WINDOW - GRAM + 1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows = [node_of(t.as_py()) for t in part.column("text")]
            columns = [pa.array([r[1] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "node", "sha256", "n_words"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to (lid, node, n, text) of the nodes of a batch that have a window: n rows of the batch have it."""
    for batch in batches:
        times: dict[bytes, int] = {}
        held: list[pa.RecordBatch] = []
        for part in slices(batch):
            names, keep = [], []
            for k, t in enumerate(part.column("text")):
                _, node, words = node_of(t.as_py())
                if len(words) >= WINDOW:
                    if node not in times:
                        names.append(node)
                        keep.append(k)
                    times[node] = times.get(node, 0) + 1
            held.append(pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), part.column("text").take(pa.array(keep, pa.int64()))], ["node", "text"]))
        for part in held:
            names = part.column("node").to_pylist()
            lids = [int.from_bytes(x[:8], "little", signed=True) for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(lids, pa.int64()), part.column("node"), pa.array([times[x] for x in names], pa.int64()), part.column("text")], ["lid", "node", "n", "text"])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lid, text) to (fp, lid, n): each distinct anchor and at how many places of the text it stands."""
    for batch in batches:
        for part in slices(batch):
            found, n, lids = [], [], []
            for lid, text in zip(part.column("lid").to_pylist(), part.column("text"), strict=True):
                grams, least = anchors(np.frombuffer(as_bytes(text.as_py()), np.uint8))
                own, many = np.unique(grams[np.isin(grams, least)], return_counts=True)
                found.append(own.view(np.int64))
                n.append(many)
                lids.append(np.full(len(own), lid))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(lids)), pa.array(np.concatenate(n).astype(np.int32))], ["fp", "lid", "n"])


RUN, TEXTS = "fp bigint, lid bigint, n int", "lid bigint, node binary, n_rows bigint, batch int, text string"


class FingerprintIndex:
    """Immutable runs and texts in a folder that all executors share, in ``buckets`` of fingerprints and texts.

    A folder with a manifest is opened as it was at the last ``commit``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.folder = spark, (folder or shared_folder(spark)).rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.texts: list[str] = []
        self.batches = self.version = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-*/_SUCCESS")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        names = sorted(f.getPath().getParent().getName() for f in found or ())
        if names:
            kept = json.loads(spark.read.text(f"{self.folder}/{names[-1]}").first()["value"])
            self.buckets, self.runs, self.texts, self.batches = (kept[k] for k in ("buckets", "runs", "texts", "batches"))
            self.version = int(names[-1].removeprefix("manifest-"))

    def commit(self) -> None:
        """The state as it is now becomes what the folder holds."""
        self.version += 1
        state = json.dumps({"buckets": self.buckets, "runs": self.runs, "texts": self.texts, "batches": self.batches})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.version:08d}")

    def _write(self, rows: DataFrame, kind: str, key: str) -> str:
        """``rows``, dealt to the buckets of ``key`` already, as a table sorted in each bucket."""
        name = f"{kind}-{uuid.uuid4().hex}"
        write_buckets(rows, f"{self.folder}/{name}", key, self.buckets)
        return name

    def _read(self, name: str, schema: str, key: str) -> DataFrame:
        return read_buckets(self.spark, f"{self.folder}/{name}", schema, key, self.buckets)

    def run(self, name: str) -> DataFrame:
        """(fp, lid, n) of a run."""
        return self._read(name, RUN, "fp")

    def table(self, name: str) -> DataFrame:
        """(lid, node, n_rows, batch, text) of a table of texts."""
        return self._read(name, TEXTS, "lid")

    def add_texts(self, texts: DataFrame) -> str:
        """``texts``: lid, node, n_rows, batch and text, dealt to the buckets of lid."""
        self.texts.append(self._write(texts.select("lid", "node", "n_rows", "batch", "text"), "texts", "lid"))
        return self.texts[-1]

    def append(self, fingerprints: DataFrame) -> DataFrame:
        """Adds a batch (fp, lid, n) as a run; (fp) of those that stand at two places of the batch, or in it and in an earlier run."""
        before = list(self.runs)
        self.runs.append(self._write(fingerprints.select("fp", "lid", "n").repartition(self.buckets, "fp"), "run", "fp"))
        self.batches += 1
        batch = self.run(self.runs[-1])
        found = batch.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
        for name in before:
            found = found.union(batch.select("fp").join(self.run(name).select("fp").hint("merge"), "fp", "left_semi"))
        return found.distinct()

    def holders(self, fingerprints: DataFrame) -> DataFrame:
        """(lid, hot) of the texts of all runs that have some of the fingerprints, and which."""
        rows = reduce(DataFrame.union, [self.run(name).join(fingerprints, "fp", "left_semi").select("lid", "fp") for name in self.runs])
        return rows.groupBy("lid").agg(F.collect_set("fp").alias("hot"))

    def compact(self) -> None:
        """All runs become one, merged in each bucket without a shuffle; the old ones stay until the folder goes, as readers may use them."""
        if len(self.runs) > 1:
            both = reduce(DataFrame.union, [self.run(name) for name in self.runs])
            self.runs = [self._write(both.sortWithinPartitions("fp"), "run", "fp")]


LONE, SETTLED, WITNESS = 0, 1, 2
_WINDOWS = "w1 long, w2 long, node binary, at int, n int, state byte"


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text, hot, named) to windows with a hot anchor.

    Those that repeat in a batch and are of named rows are settled: a row for each run of n neighbouring ones, with
    hashes that deal it anywhere. Each such window leaves a witness, as every window of a row that isn't named does.
    """
    for batch in batches:
        for part in slices(batch, rows=2000, most=8 << 20):
            one, two, at, row = [], [], [], []
            for i, (text, hot) in enumerate(zip(part.column("text"), part.column("hot"), strict=True)):
                data = np.frombuffer(as_bytes(text.as_py()), np.uint8)
                spans = _one.spans(data)
                words = _one.hashes(data, spans)
                least = sliding_min(windows(words, GRAM), WINDOW - GRAM + 1)
                keep = np.flatnonzero(np.isin(least, hot.values.to_numpy().view(np.uint64)))
                one.append(windows(words, WINDOW)[keep])
                two.append(windows(_two.hashes(data, spans), WINDOW)[keep])
                at.append(keep)
                row.append(np.full(len(keep), i))
            w1, w2, at_, row_ = np.concatenate(one), np.concatenate(two), np.concatenate(at), np.concatenate(row)
            if not len(w1):
                continue
            order = np.lexsort((w2, w1))
            new = np.concatenate(([True], (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])))
            group = np.cumsum(new) - 1
            named = part.column("named").to_numpy(zero_copy_only=False)[row_]
            several = np.zeros(len(w1), bool)
            several[order] = (np.bincount(group) > 1)[group]
            first = np.zeros(len(w1), bool)
            first[order] = new
            node = part.column("node")

            def rows(pick: np.ndarray, state: int, n: np.ndarray | None = None) -> pa.RecordBatch:
                names = node.take(pa.array(row_[pick])) if state != WITNESS else pa.nulls(len(pick), pa.binary())
                # A settled row is dealt by its place, a constant number of batches away from all others of its window.
                k1, k2 = (w1[pick], w2[pick]) if state != SETTLED else (w1[pick] ^ (row_[pick].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ~w2[pick])
                n = np.ones(len(pick), np.int32) if n is None else n.astype(np.int32)
                return pa.RecordBatch.from_arrays(
                    [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), names, pa.array(at_[pick].astype(np.int32)), pa.array(n), pa.array(np.full(len(pick), state, np.int8))],
                    ["w1", "w2", "node", "at", "n", "state"],
                )

            yield rows(np.flatnonzero(~several & named), LONE)
            yield rows(np.flatnonzero((several & first) | (~several & ~named)), WITNESS)
            seen = np.flatnonzero(several & named)
            if len(seen):
                starts = np.concatenate(([True], (row_[seen][1:] != row_[seen][:-1]) | (at_[seen][1:] != at_[seen][:-1] + 1)))
                ends = np.append(np.flatnonzero(starts)[1:], len(seen))
                yield rows(seen[starts], SETTLED, ends - np.flatnonzero(starts))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (w1, w2), the settled ones and those lone ones whose window another row has: (lid, node, at, n)."""
    held: pa.RecordBatch | None = None  # the last row so far, while it is lone in its window
    last = None
    columns = ["node", "at", "n"]

    def named(part: pa.RecordBatch) -> pa.RecordBatch:
        lids = np.frombuffer(b"".join([x[:8] for x in part.column("node").to_pylist()]), "<i8")
        return pa.RecordBatch.from_arrays([pa.array(lids), *part.columns], ["lid", *columns])

    for batch in batches:
        if not batch.num_rows:
            continue
        w1, w2, state = (batch.column(c).to_numpy() for c in ("w1", "w2", "state"))
        new = np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
        group = np.cumsum(new) - 1
        many = np.bincount(group, state != SETTLED) > 1
        goes_on = last == (w1[0], w2[0])
        if goes_on:
            many[0] = True
            if held is not None:
                yield named(held)
        held = None
        pick = (state == SETTLED) | (many[group] & (state == LONE))
        yield named(batch.select(columns).filter(pa.array(pick)))
        if not many[group[-1]] and state[-1] == LONE:
            held = batch.slice(batch.num_rows - 1, 1).select(columns)
        last = (w1[-1], w2[-1])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text, starts) to (node, n_removed, kept_sha256); starts: (at, n), n windows from word at on."""
    for batch in batches:
        for part in slices(batch):
            removed, digests = [], []
            for text, starts in zip(part.column("text"), part.column("starts"), strict=True):
                words = as_bytes(text.as_py()).split()
                at, n = (starts.values.field(k).to_numpy() for k in (0, 1))
                step = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n + (WINDOW - 1), minlength=len(words) + 1)
                gone = np.cumsum(step)[: len(words)] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["node", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, index: FingerprintIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs``: its words without those that a window covers which starts elsewhere too, in ``docs`` or in what the index holds.

    ``docs`` then belong to the index. ``batches``: in how many batches they enter it; the result doesn't depend on it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(docs.mapInArrow(tidy(_describe), "doc_id long, node binary, sha256 string, n_words long"))
    index = index or FingerprintIndex(spark)
    earlier = list(index.texts)

    texts = docs.select("text").mapInArrow(tidy(_distinct), "lid long, node binary, n long, text string").repartition(index.buckets, "lid")
    texts = texts.groupBy("lid", "node").agg(F.sum("n").alias("n_rows"), F.first("text").alias("text"))
    texts = texts.withColumn("batch", (F.pmod(F.xxhash64("node"), F.lit(batches)) + index.batches).cast("int"))
    for name in earlier:
        texts = texts.join(index.table(name).select("lid", "node"), ["lid", "node"], "left_anti")
    own = index.add_texts(texts)
    first, mine, hits = index.batches, index.table(own), None
    for number in range(first, first + batches):
        prints = mine.where(F.col("batch") == number).select("lid", "text").mapInArrow(tidy(_fingerprints), "fp long, lid long, n int")
        holders = index.holders(stored(index.append(prints)))
        # Texts of two rows go as a whole, and those of earlier calls were judged then: they are needed as witnesses alone.
        named = [(own, F.col("n_rows") == 1), *[(name, F.lit(False)) for name in earlier]]
        active = [index.table(name).select("lid", "node", "text", flag.alias("named")).join(holders.hint("shuffle_hash"), "lid") for name, flag in named]
        found = reduce(DataFrame.union, active).select("node", "text", "hot", "named").mapInArrow(tidy(_windows_of), _WINDOWS)
        found = stored(found.repartition("w1", "w2").sortWithinPartitions("w1", "w2").mapInArrow(tidy(_repeated), "lid long, node binary, at int, n int"))
        hits = found if hits is None else hits.union(found)
    if len(index.runs) > MOST_RUNS:
        index.compact()
    index.commit()

    starts = hits.groupBy("lid", "node").agg(F.collect_list(F.struct("at", "n")).alias("starts"))
    stripped = mine.select("lid", "node", "text").join(starts.withColumnRenamed("node", "own").hint("shuffle_hash"), "lid").where("node = own").select("node", "text", "starts")
    stripped = stripped.mapInArrow(tidy(_strip), "node binary, n_removed long, kept_sha256 string")
    copied = mine.where("n_rows > 1").select("node")
    for name in earlier:
        copied = copied.union(index.table(name).select("node").join(rows.where(F.col("n_words") >= WINDOW).select("node").distinct(), "node", "left_semi"))
    empty = hashlib.sha256(b"").hexdigest()
    by_node = stored(stripped.select("node", F.lit(False).alias("copied"), "n_removed", "kept_sha256").union(copied.select("node", F.lit(True), F.lit(0).cast("long"), F.lit(empty))))
    long_, short = rows.where(F.col("n_words") >= WINDOW), rows.where(F.col("n_words") < WINDOW)
    judged = long_.join(by_node, "node", "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
    return judged.union(short.select("doc_id", "n_words", F.lit(0).cast("long"), "sha256"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


#: For DuckDB: every window as a string, counted.
OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT k, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS x FROM d WHERE len(w) >= 35),
c AS (SELECT k, i, count(*) OVER (PARTITION BY x) AS n FROM v),
g AS (SELECT k, list(DISTINCT j) AS gone FROM (SELECT k, unnest(range(i, i + 35)) AS j FROM c WHERE n > 1) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (k)
"""
