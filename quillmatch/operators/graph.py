"""Tables in the shared folder, groups of rows in tasks, and connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_FALLBACK = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = LOCAL_FALLBACK
    return f"{base.rstrip('/')}/quillmatch-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and the loss of an executor costs nothing that is stored."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join for which neither side is broadcast. Spark goes by the bytes of files, and a few MB of repeated keys are millions of rows in the driver's memory."""
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing will read again."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("quillmatch-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def by_group(rows: DataFrame, keys: list[str], solve: Callable[[pa.Table], list[tuple]], schema: str) -> DataFrame:
    """The rows (tuples of ``schema``) that ``solve`` gives for each group of equal keys, a table of its rows. Many small groups share a batch; a task holds one group and a batch. Keys are told apart by 64-bit hashes."""
    out = to_arrow_schema(StructType(_parse_datatype_string(schema).fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        made: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*made, strict=True) if made else [()] * len(out)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)
            made.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            now, h = pa.Table.from_batches([batch]), batch.column("_h").to_numpy()
            starts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if held and held[-1]["_h"][-1].as_py() != h[lo]:
                    made.extend(solve(pa.concat_tables(held)))
                    held.clear()
                held.append(now.slice(lo, hi - lo))
                if len(made) > 20_000:
                    yield batch_of()
        if held:
            made.extend(solve(pa.concat_tables(held)))
        yield batch_of()

    return rows.withColumn("_h", F.xxhash64(*keys)).repartition("_h").sortWithinPartitions("_h").mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``edges``: root is the smallest node that can be reached.

    Minimum labels go along the edges and labels are then followed once (pointer
    jumping), so paths shorten by half in each round. Each round is a table in the
    shared folder that replaces the one before; the driver sees one count a round. A
    hub's edges are one key of a sort-merge join, which adaptive execution splits.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = stored(pairs.union(pairs.select("b", "a")).distinct())
    table = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        labels = table.select("node", "root")
        near = both.join(shuffled(labels.select(F.col("node").alias("b"), "root")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = stored(labels.join(shuffled(near), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(lower.join(shuffled(jump), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("was")).alias("moved")))
        discard(table)
        discard(lower)
        table = new
        if new.where("moved").isEmpty():
            discard(both)
            return new.select("node", "root")
