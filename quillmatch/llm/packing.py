"""Cost-balanced packing of documents into sequences of at most 1024 tokens.

The cost of a piece of n tokens is ``LINEAR * n + QUADRATIC * n * n``: what the layers
and what attention inside the piece take. Documents are cut into full sequences and a
rest; the rests of a pool are assigned in descending order, each to the sequence of
lowest cost that still has room, and a rest for which none has room is cut into the
sequence with most room. A pool's sequences have exactly the room that its tokens need:
as many of 1024 as they fill, and for what is over one sequence for each power of two
in that number, so nothing is padded.

A pool is the documents of a task up to ``POOL_TOKENS`` tokens, so packing needs no
shuffle, memory is bounded, no document or group can be hot, and a lost task is packed
again alike. A document longer than a pool is a pool; its full sequences are emitted at
once. Sequence ids are the task's number in the high bits and a count in the low ones.

Null and empty texts are the end id alone. Repeated rows and ids are packed like others;
null ids stay null. Empty tables give no sequences. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.shared import slices, table, tidy
from quillmatch.llm.tokens import END, encoder, vocabulary_path

LENGTH, POOL_TOKENS = 1024, 1 << 20
#: Pieces that the encoder keeps here; fewer than for token files, as a pool is held too.
CACHE = 200_000
LINEAR, QUADRATIC = 1.0, 1 / 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def rooms(tokens: int) -> list[int]:
    """Full sequences, and a power of two for each bit of the rest: together exactly ``tokens``."""
    rest = tokens % LENGTH
    return [LENGTH] * (tokens // LENGTH) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of these lengths."""
    pieces, rests, sequence = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % LENGTH, LENGTH):
            pieces.append((d, start, LENGTH, sequence, 0))
            sequence += 1
        if n % LENGTH:
            rests.append((-(n % LENGTH), d, n - n % LENGTH))
    room = rooms(-sum(r[0] for r in rests))
    total = list(room)
    # Sequences by cost. One without room for a document has none for longer ones, but later documents are shorter: it waits in ``full``, by room.
    by_cost = [(0.0, k) for k in range(len(room))]
    waiting: list[tuple[int, float, int]] = []  # (-room, cost, sequence)
    heapq.heapify(by_cost)
    heapq.heapify(rests)
    spent = [0.0] * len(room)
    while rests:
        size, d, start = heapq.heappop(rests)
        need = -size
        while waiting and -waiting[0][0] >= need:
            _, c, k = heapq.heappop(waiting)
            heapq.heappush(by_cost, (c, k))
        while by_cost and room[by_cost[0][1]] < need:
            c, k = heapq.heappop(by_cost)
            if room[k]:
                heapq.heappush(waiting, (-room[k], c, k))
        if by_cost:
            k = heapq.heappop(by_cost)[1]
            part = need
        else:
            k = heapq.heappop(waiting)[2]
            part = room[k]
            heapq.heappush(rests, (part - need, d, start + part))
        pieces.append((d, start, part, sequence + k, total[k] - room[k]))
        room[k] -= part
        spent[k] += cost(part)
        if room[k]:
            heapq.heappush(by_cost, (spent[k], k))
    return pieces


def packed(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """The pieces of ``docs`` (doc_id long, text string) in their sequences."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, encode = TaskContext.get().partitionId() << 36, encoder(vocabulary, end, CACHE)
        pool: list[tuple[int | None, np.ndarray]] = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal first, held
            rows = pack([len(x) for _, x in pool])
            table_ = np.array(rows, np.int64).reshape(-1, 5)
            d, start, length, sequence, offset = table_.T
            sums = [zlib.crc32(pool[i][1][a : a + n]) for i, a, n in zip(d.tolist(), start.tolist(), length.tolist(), strict=True)]
            ids = pa.array([x[0] for x in pool], pa.int64()).take(pa.array(d))
            whole = np.array([len(x) for _, x in pool], np.int64)[d]
            out = pa.RecordBatch.from_arrays(
                [ids, *[pa.array(x) for x in (start, length, np.array(sums, np.int64), whole, first + sequence, offset)]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )
            first += int(sequence.max()) + 1
            pool.clear()
            held = 0
            return out

        for batch in batches:
            for part in slices(batch, rows=8000, most=3 << 20):
                ids, n = encode.flat(part.column("text").to_pylist())
                for doc, own in zip(part.column("doc_id").to_pylist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    pool.append((doc, own))
                    held += len(own)
                    if held >= POOL_TOKENS:
                        yield emit()
        if pool:
            yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, "tokens"), PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents", "doc_id", "text"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left."""
    return packed(docs)
