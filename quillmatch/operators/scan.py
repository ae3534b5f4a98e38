"""Prefix scans over the rows of a key, for keys of any size.

A key's rows are in the order of (page, y0, seq). They are scanned in segments, a page's
bands of ``BAND`` points, each by itself; what a segment needs of those before it (their
last row, their sums) comes from a table with one row for each segment. So a key that
holds most of all rows is as many tasks as it has segments. Nulls come first and are a
page, or a band, of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.operators.graph import shuffled

ROW_GAP, BAND = 5.0, 50.0
SEGMENT = ["_p", "_b"]


def segmented(records: DataFrame) -> DataFrame:
    """With the segment of each row."""
    y = F.col("y0").cast("double")
    return records.withColumns({"_p": F.col("page"), "_b": F.when(F.isnan(y), F.lit(1 << 62)).otherwise(F.floor(y / BAND))})


def joined_nulls(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which nulls are equal; the keys are those of ``left``."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(shuffled(other), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])).drop(*[f"_r_{k}" for k in keys])


def with_running(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` (of ``segmented``) with the sum of ``value`` over the rows of the key up to each."""
    own = [*keys, *SEGMENT]
    w = Window.partitionBy(*own).orderBy("y0", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(*SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*own).agg(F.sum(value).alias("_sum")).withColumn("_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    return joined_nulls(rows.withColumn(name, F.sum(value).over(w)), sums, own).withColumn(name, F.col(name) + F.col("_sum")).drop("_sum")


def with_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """``row`` from 0 in each key group by (page, y0, seq): a new page, or more than ROW_GAP below the record just before, is a new row."""
    own = [*keys, *SEGMENT]
    inside = Window.partitionBy(*own).orderBy("y0", "seq")
    new = F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(inside)) > ROW_GAP, F.lit(False)).cast("int")
    rows = segmented(records).withColumn("_new", new)
    across = Window.partitionBy(*keys).orderBy(*SEGMENT)
    entered = F.coalesce(~F.col("_p").eqNullSafe(F.lag("_p").over(across)) | (F.abs(F.col("_first") - F.lag("_last").over(across)) > ROW_GAP), F.lit(False))
    entered = F.when(F.row_number().over(across) == 1, F.lit(0)).otherwise(entered.cast("int"))
    parts = rows.groupBy(*own).agg(F.sum("_new").alias("_sum"), F.min("y0").alias("_first"), F.max("y0").alias("_last")).withColumn("_in", entered)
    upto = F.sum(F.col("_sum") + F.col("_in")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")
    parts = parts.select(*own, upto.alias("_start"))
    local = rows.withColumn("row", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return joined_nulls(local, parts, own).withColumn("row", (F.col("row") + F.col("_start")).cast("int")).drop("_new", "_start", *SEGMENT)


def _chain(rows: Column) -> Column:
    """Of structs sorted by y0, the first and each that is more than ROW_GAP from the last that was taken."""
    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.slice(rows, 1, 1), lambda taken, r: F.when(F.abs(r["y0"] - F.element_at(taken, -1)["y0"]) > ROW_GAP, F.concat(taken, F.array(r))).otherwise(taken))


def kept_rows(records: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key group, in the order of (page, y0, seq), the records on another page than the last kept one or more than ROW_GAP from it, with pos, their place among the kept ones.

    A record that starts a row is kept whatever was kept before, so rows are independent. Inside a
    row, which ends where a page does, only the first of the records at one height can be
    kept; its heights are folded in order.
    """
    typed = records.select(*keys, F.col("page").cast("int").alias("page"), F.col("y0").cast("double").alias("y0"), F.col("seq").cast("long").alias("seq"))
    run = [*keys, "row"]
    first = with_rows(typed, keys).repartition(*run).groupBy(*run, "page", "y0").agg(F.min("seq").alias("seq"))
    runs = first.groupBy(*run).agg(_chain(F.array_sort(F.collect_list(F.struct("y0", "page", "seq")))).alias("_kept"))
    runs = runs.select(*keys, "_kept", F.col("_kept")[0]["page"].alias("page"), F.col("_kept")[0]["y0"].alias("y0"), F.col("_kept")[0]["seq"].alias("seq"))
    places = with_running(segmented(runs), keys, F.size("_kept"), "_upto")
    each = places.select(*keys, (F.col("_upto") - F.size("_kept")).alias("_before"), F.posexplode("_kept").alias("_at", "_r"))
    return each.select(*keys, (F.col("_before") + F.col("_at")).cast("int").alias("pos"), "_r.page", "_r.y0", "_r.seq")
