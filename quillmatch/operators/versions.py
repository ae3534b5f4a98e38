"""Which pages of which documents changed between two versions, and records brought up to date by them.

Prints are a tree: rows make a page's print, pages make a document's. Prints are stored with a
version, so the next one compares documents first and pages of differing documents only, and
what is derived page by page (annotations, fields) is computed anew for changed pages alone.
A print is a sum of row hashes under two seeds and a count, so rows are aggregated before the
shuffle and their order doesn't count; put the order among the columns if it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def _sum(*parts: Column | str) -> Column:
    """Of 64-bit hashes, beyond any overflow."""
    return F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))


def page_prints(rows: DataFrame) -> DataFrame:
    """(doc_id, page, print) of the rows of each page, by all columns."""
    said = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.groupBy(*PAGE).agg(F.concat_ws(" ", F.count("*"), _sum(said), _sum(F.lit("2"), said)).alias("print"))


def document_prints(prints: DataFrame) -> DataFrame:
    """(doc_id, root) of the pages' prints."""
    return prints.groupBy("doc_id").agg(F.concat_ws(" ", F.count("*"), _sum("page", "print"), _sum(F.lit("2"), "page", "print")).alias("root"))


def changed_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, page, change) of two tables of ``page_prints``: added, removed or changed."""
    old, new = document_prints(before), document_prints(after).withColumnRenamed("root", "_root")
    # Documents of one root go no further.
    docs = old.join(new, "doc_id", "full").where(~F.col("root").eqNullSafe(F.col("_root"))).select("doc_id")
    pages = before.join(docs, "doc_id").join(after.join(docs, "doc_id").withColumnRenamed("print", "_print"), PAGE, "full")
    change = F.when(F.col("print").isNull(), "added").when(F.col("_print").isNull(), "removed").otherwise("changed")
    return pages.where(~F.col("print").eqNullSafe(F.col("_print"))).select(*PAGE, change.alias("change"))


def refreshed(records: DataFrame, changed: DataFrame, renewed: DataFrame) -> DataFrame:
    """``records`` with those of changed pages replaced by ``renewed``, which was made from the rows of those pages alone (``on_changed``)."""
    return records.join(changed.select(*PAGE), PAGE, "left_anti").unionByName(renewed)


def on_changed(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows of pages that were added or changed."""
    return rows.join(changed.where("change <> 'removed'").select(*PAGE), PAGE, "left_semi")
