"""Token ids of documents, and their file format: ORC with integer run-length encoding.

Encoding. The vocabulary's pre-tokenizer starts a token at a single space between two
characters that aren't white space, whatever stands on either side, so a text may be cut
before each such space and its pieces encoded one by one: the ids are those of the whole
text. Most texts are plain enough to be cut also before each full stop and comma and
around each line feed; in the others, new pieces are cut there where a token surely ends.
The pieces of plain texts are found in their bytes and reduced to distinct ones by Arrow;
a worker keeps the ids of those it has met lately (two generations of about
``cache`` pieces; what is forgotten costs time and nothing else), gives the tokenizers
library only new parts, and gathers the ids of all pieces at once. Texts that hold an added
token's string are encoded whole, and so are all texts if the vocabulary has another
normalizer or pre-tokenizer than the byte-level one that these rules are for.

Format. Documents are dealt to ascending ranges of doc_id (quantiles of the ids alone, so
the text is read once) and sorted, so files and the stripes in them hold disjoint ascending
id ranges. The ids of a document are an ``array<int>``,
which ORC stores with run-length encoding v2; row indexes (min and max of doc_id each
``row_index_stride`` rows) and Bloom filters on doc_id let a reader skip stripes and row
groups by metadata; readers take stripes in parallel. A file also keeps where in its
part each document starts; the parts' totals, one row a file, give the places in the
whole corpus.

Null and empty texts are the end id alone. Null ids sort first. Of repeated ids the order
is by a hash of the text, and equal rows are kept; an id that fills several ranges, null
too, is dealt to them by that hash, so it is no hot key. Empty tables give an empty corpus.
Other columns are not read. A document is one row and is never cut, so a row needs memory
in proportion to its text; texts are held up to ``slices`` of 5 MB at a time.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.llm.shared import held, shared_folder, slices, small_batches, stored, table, tidy

VOCABULARY, END = "byte_bpe_50k.json", 0
CACHE_PIECES, BLOCK_PIECES = 400_000, 1_500_000
GROUP = 64  # pieces a text; the library slows down on long ones
_CUT = re.compile(r" (?=[^\s᠎])")
_UNSAFE = re.compile(r" [\s᠎]")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SOLID = _LETTER + "0-9.,;:!?%*&$#|"
#: Places where a cut at every space, full stop, comma and line feed might not be where a token ends. Each part begins with one character, which the matcher finds fast.
_DOUBT = [re.compile(x).search for x in (rf" (?=[\s᠎.,])", rf"\n(?:(?<![{_SOLID}]\n)|(?![{_SOLID}]|\Z))", rf",(?<![{_LETTER}0-9],)", rf"\.(?<![{_LETTER}0-9]\.)")]
_STARTS = np.zeros(256, bool)  # bytes that start a piece of a plain text; so does what follows a line feed
_STARTS[list(b" .,\n")] = True
_PARTS = re.compile(rf"(?<=[{_LETTER}])(?=[.,])|(?<=[{_SOLID}])(?=\n)|(?<=[{_SOLID}]\n)(?=[{_SOLID}])")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, with the end id appended."""

    def __init__(self, path: str, end: int = END, cache: int = CACHE_PIECES) -> None:
        # A task has one core; the library's threads would contend for those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether a text holds the string of an added token.
        self.special = re.compile("|".join(added) or r"(?!)").search
        self.end, self.cache = end, cache
        before = self.tokenizer.pre_tokenizer
        #: Whether the rules for cuts hold: nothing is normalized, and pieces are those of the byte-level pattern.
        self.cuts = self.tokenizer.normalizer is None and type(before).__name__ == "ByteLevel" and before.use_regex and not before.add_prefix_space
        one = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_feed = one[0] if len(one) == 1 else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, pieces: Iterable[str]) -> None:
        """Encodes new pieces, which hold no added token and begin with a space at most. Those without other white space go to the library as lines of texts of ``GROUP`` pieces: a line feed between them is a token of its own, so the ids are cut at its id."""
        plain, other, groups = [], [], []
        for p in pieces:
            (other if p in (" ", "\n", "") else plain).append(p)
        if self.line_feed is None:
            plain, other = [], other + plain
        whole: list[str] = []
        for k in range(0, len(plain), GROUP):
            own = plain[k : k + GROUP]
            if not "".join([p[1:] if p[0] == " " else p for p in own]).replace(" ", "\n").isprintable():
                other += [p for p in own if not p.replace(" ", "", 1).isprintable() or " " in p[1:]]
                own = [p for p in own if p.replace(" ", "", 1).isprintable() and " " not in p[1:]]
            if own:
                groups.append("\n".join(own))
                whole += own
        if groups:
            # The last line feed of a group is the encoder's own, so that each piece has one after it.
            found: list[int] = []
            for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False):
                found += e.ids
                found.append(self.line_feed)
            ids = np.array(found, "<u4")
            cuts = np.flatnonzero(ids == self.line_feed) * 4
            if len(cuts) != len(whole):
                raise ValueError("a line feed wasn't a token of its own")
            raw = ids.tobytes()
            self.known.update(zip(whole, [raw[x:y] for x, y in zip([0, *(cuts[:-1] + 4).tolist()], cuts.tolist(), strict=True)], strict=True))
        if other:
            self.known.update(zip(other, self._encode(other), strict=True))

    def _learn(self, pieces: list[str], cut: bool) -> None:
        """Adds what isn't known to ``known``: from the older generation, from known parts if the pieces can be ``cut`` further, or from the library."""
        known, older = self.known, self.older
        new = []
        for p in pieces:
            if (ids := older.get(p)) is not None:
                known[p] = ids
            else:
                new.append(p)
        if not cut:
            return self._add(new)
        split = {p: [p] if p[1:].isalpha() else _PARTS.split(p) for p in new}
        parts = set(chain.from_iterable(split.values())).difference(known)
        if older:
            for p in [p for p in parts if p in older]:
                known[p] = older[p]
                parts.discard(p)
        self._add(parts)
        for p, own in split.items():
            if len(own) > 1:
                known[p] = b"".join([known[x] for x in own])

    def _plain(self, text: str) -> bool:
        """Whether the text may be cut before each space, full stop and comma and around each line feed."""
        return self.cuts and not self.special(text) and not any(doubt(text) for doubt in _DOUBT)

    def _pieces(self, text: str) -> list[str]:
        """The text, cut before each space that surely starts a token."""
        if _UNSAFE.search(text):
            first, *rest = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
            if rest and not rest[-1]:  # a space ends the text
                rest[-2:] = [rest[-2] + " "] if len(rest) > 1 else []
                first += "" if rest else " "
        return [first, *[" " + p for p in rest]]

    def _known_ids(self, names: list[str], cut: bool) -> list[bytes]:
        if len(self.known) > self.cache:
            self.known, self.older = {}, self.known
        known = self.known
        ids = list(map(known.get, names))
        if None in ids:
            gaps = [i for i, x in enumerate(ids) if x is None]
            self._learn(list(dict.fromkeys([names[i] for i in gaps])), cut)
            for i in gaps:
                ids[i] = known[names[i]]
        return ids

    def _plain_ids(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of plain texts end to end, how many each has)."""
        ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        starts = _STARTS[data]
        np.logical_or(starts[1:], data[:-1] == 10, out=starts[1:])
        starts[0] = True
        starts[ends[:-1][ends[:-1] < len(data)]] = True
        at = np.flatnonzero(starts)
        stops, ids, counts = np.append(at[1:], len(data)), [], []
        for k in range(0, len(at), BLOCK_PIECES):
            lo, hi = at[k], stops[min(k + BLOCK_PIECES, len(at)) - 1]
            offsets = np.append(at[k : k + BLOCK_PIECES], hi) - lo
            words = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(memoryview(whole)[lo:hi])).dictionary_encode()
            lists = int_lists(self._known_ids(words.dictionary.to_numpy(zero_copy_only=False).tolist(), False)).take(words.indices)
            stop = lists.offsets.to_numpy()
            ids.append(lists.values.to_numpy()[stop[0] : stop[-1]].view("<u4"))
            counts.append(np.diff(stop))
        total = np.concatenate(([0], np.cumsum(np.concatenate(counts), dtype=np.int64)))
        return np.concatenate(ids), np.diff(total[np.searchsorted(at, ends)], prepend=0)

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each with its end id; how many each text has)."""
        parts: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if t and self._plain(t):
                plain.append(i)
            elif t:
                parts[i] = np.frombuffer(b"".join(self._known_ids(self._pieces(t), True) if self.cuts and not self.special(t) else self._encode([t])), "<u4")
        counts = np.array([len(p) for p in parts], np.int64)
        if plain:
            ids, n = self._plain_ids([texts[i].encode() for i in plain])
            counts[plain] = n
            if len(plain) < len(texts):
                for i, part in zip(plain, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    parts[i] = part
                ids = np.concatenate(parts)
        else:
            ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        return np.insert(ids, np.cumsum(counts), self.end), counts + 1

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        ids, counts = self.flat(texts)
        yield from (x.tobytes() for x in np.split(ids, np.cumsum(counts)[:-1]) if len(texts))


def encoder(path: str, end: int = END, cache: int = CACHE_PIECES) -> Encoder:
    """One for each worker process, which keeps what it has met from task to task."""
    return held("tokens", (path, end, cache), lambda: Encoder(path, end, cache))


def vocabulary_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def int_lists(chunks: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(chunks) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) // 4, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(chunks), "<i4")))


TOKENS = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
_LEAST = -(1 << 63)


def _ranges(docs: DataFrame, parts: int) -> list[int]:
    """Where the parts of ``docs`` after the first begin: quantiles of doc_id, null as the least long."""
    ids = docs.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("doc_id"))
    return sorted(ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10_000, 20 * parts)).alias("q")).first()["q"] or []) if parts > 1 else []


def _before(bounds: list[int], value: Column, equal: bool) -> Column:
    """How many of the ascending bounds are below ``value`` (or ``equal`` to it): a binary search."""
    steps, array = max(len(bounds), 1).bit_length(), F.array(*[F.lit(b) for b in bounds])

    def step(at: Column, k: Column) -> Column:
        # The answer is at least ``at``; k is the next power of two to try.
        x = F.get(array, at + k - 1)
        return F.when(x.isNotNull() & ((x <= value) if equal else (x < value)), at + k).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(steps))]), F.lit(0), step)


def _part_of(bounds: list[int], doc: Column, tie: Column) -> Column:
    """The part of each document; one whose id is several bounds goes to one of their parts by its tie, so parts ascend by (id, tie)."""
    if not bounds:
        return F.lit(0)
    value = F.coalesce(doc, F.lit(_LEAST))
    lo, hi = _before(bounds, value, False), _before(bounds, value, True)
    place = (tie.cast("double") + 2.0**63) / 2.0**64
    place = F.when(doc.isNull(), place / 2).when(doc == _LEAST, place / 2 + 0.5).otherwise(place)  # null before the least long
    return lo + F.least(F.floor(place * (hi - lo + 1)), hi - lo).cast("int")


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, rows_per_index: int = 1000, stripe_bytes: int = 16 << 20, parts: int | None = None) -> None:
    """``docs`` (doc_id long, text string) as ORC files in ``path``, ascending by doc_id: doc_id, part, part_start, n_tokens, ids.

    ``parts``: in how many ranges; by default the session's number of shuffle partitions.
    """
    vocabulary = vocabulary or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_, start = encoder(vocabulary, end), 0
        for batch in batches:
            for rows in slices(batch, rows=8000, most=5 << 20):
                ids, n = encode_.flat(rows.column("text").to_pylist())
                starts = start + np.cumsum(n) - n
                start += len(ids)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), pa.array(starts), pa.array(n), lists], ["doc_id", "part", "part_start", "n_tokens", "ids"])

    tied = docs.withColumn("tie", F.xxhash64("text"))
    dealt = tied.withColumn("part", _part_of(_ranges(docs, parts), F.col("doc_id"), F.col("tie"))).repartitionById(parts, "part")
    out = dealt.sortWithinPartitions("doc_id", "tie", "text").mapInArrow(tidy(encode, "tokens"), TOKENS)
    options = {"compression": "lz4", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(rows_per_index), "orc.stripe.size": str(stripe_bytes)}
    with small_batches(docs.sparkSession, 3000):
        out.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files of ``write_tokens``; a filter on doc_id reads only stripes and row groups whose indexes and Bloom filters admit it."""
    return spark.read.schema(TOKENS).orc(path)


def starts(tokens: DataFrame) -> DataFrame:
    """(part, before): the ids in the parts before each. One row a file, from the totals of the parts."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        data, at = np.ascontiguousarray(lists.values.to_numpy()), lists.offsets.to_numpy()
        sums = [zlib.crc32(data[a:b].astype("<u4", copy=False)) for a, b in zip(at[:-1], at[1:], strict=True)]
        names = ["doc_id", "part", "part_start", "n_tokens"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sums, pa.int64())], [*names, "ids_crc32"])


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    tokens = read_tokens(spark, path)
    with small_batches(spark):
        sums = stored(tokens.mapInArrow(tidy(_checked), "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"))
    return sums.join(starts(tokens), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
