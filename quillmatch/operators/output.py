"""What is written: the placement manifest and the quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.style import BLACK, FALLBACK_FILL, first_three, text_style
from quillmatch.plans.profile import StyleDefaults

TYPES = ("exact", "fuzzy", "position_only", "manual", "unmatched")


def writable(matches: DataFrame, annotations: DataFrame, page_count: int | Column) -> DataFrame:
    """``matches`` with ``written``: approved, of an annotation that exists, on a page that exists."""
    known = annotations.select(F.col("id").alias("annotation_id")).distinct().withColumn("_known", F.lit(True))
    ok = (F.col("status") == "approved") & F.col("_known").isNotNull() & F.col("target_page").between(1, page_count)
    return matches.join(known, "annotation_id", "left").withColumn("written", F.coalesce(ok, F.lit(False))).drop("_known")


def placement_manifest(matches: DataFrame, annotations: DataFrame, page_count: int | Column, style: StyleDefaults) -> DataFrame:
    """A row for each annotation to be written: where, what and in which style. A renderer needs nothing else."""
    a = annotations.select(F.col("id").alias("annotation_id"), "content", "domain", "category", F.col("style").alias("_style"), "rotation")
    s = text_style(F.col("category"), F.col("_style"), style.use_source_style, style.font_size, style.domain_label_font_size)
    rows = writable(matches, annotations, page_count).where("written").join(a, "annotation_id").withColumn("text_style", s)
    width = F.when(F.col("_style.border_width") > 0, F.col("_style.border_width")).otherwise(F.lit(1.0))
    return rows.select(
        "annotation_id",
        "target_page",
        "target_rect",
        "content",
        F.col("domain").alias("subject"),
        "text_style",
        first_three(F.col("_style.fill_color"), FALLBACK_FILL).alias("fill_color"),
        first_three(F.col("_style.border_color"), BLACK).alias("border_color"),
        width.alias("border_width"),
        F.col("_style.border_dashes").alias("border_dashes"),
        F.when(F.col("rotation") != 0, F.col("rotation")).alias("rotation"),
    )


def qc_ids(written: DataFrame) -> DataFrame:
    """(list, seq, annotation_id): the ids of the report's lists as rows, for any number of them."""
    lists = {"unmatched": F.col("match_type") == "unmatched", "re_pairing": F.col("status") == "re-pairing", "placement_adjusted": F.col("placement_adjusted")}
    named = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in lists.items()]), lambda x: x.isNotNull())
    return written.select(F.explode(named).alias("list"), "seq", "annotation_id")


def qc_report(written: DataFrame) -> DataFrame:
    """The artifact, whose lists are in one row (``qc_ids`` has them as rows). One row over ``written`` (match records with seq and written): counts, counts by type, and ids in the order of seq."""

    def ids(test: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("seq", "annotation_id")))), lambda x: x["annotation_id"])

    n = F.count("*")
    by_type = written.groupBy("match_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("match_type", "n")))).alias("counts_by_match_type"))
    totals = written.agg(
        n.alias("total_matches"),
        F.count_if("written").alias("written"),
        F.count_if(~F.col("written")).alias("skipped"),
        ids(F.col("match_type") == "unmatched").alias("unmatched_annotation_ids"),
        ids(F.col("status") == "re-pairing").alias("re_pairing_annotation_ids"),
        ids(F.col("placement_adjusted")).alias("placement_adjusted_ids"),
    )
    return totals.withColumn("_k", F.lit(1)).join(by_type.withColumn("_k", F.lit(1)), "_k").drop("_k")
