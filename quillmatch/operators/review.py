"""Review: upserts from CSV, edits of match records, counts, filters and suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.functions import geometry as g
from quillmatch.functions import text as t
from quillmatch.operators.graph import stored
from quillmatch.operators.matching import guarded, keyed, near_classes, scored, sides_of

CATEGORIES = ("domain_label", "sdtm_mapping", "not_submitted", "note", "cross_reference")
FIELD_TYPES = ("text_field", "checkbox", "date_field", "table_row", "section_header")
LEGACY_STATUS = {"rejected": "re-pairing", "modified": "approved"}


def last_of(rows: DataFrame, key: str, order: str = "row") -> DataFrame:
    """One row of each key: that of the greatest ``order``."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")


def upsert(existing: DataFrame, incoming: DataFrame, insert: bool = True) -> tuple[DataFrame, DataFrame]:
    """(all records with seq, ids that ``incoming`` doesn't have).

    ``incoming``: the columns of ``existing`` without seq, and row. A known id replaces
    the whole record, the last row of an id wins; a blank id is a new record with a new
    id (if ``insert``); an unknown id is ignored; a record that isn't mentioned stays.
    """
    columns = [c for c in existing.columns if c not in ("id", "seq")]
    blank = F.coalesce(F.trim("id"), F.lit("")) == ""
    named = last_of(incoming.where(~blank), "id").select("id", F.struct(*columns).alias("_new"))
    joined = existing.select("id", "seq", F.struct(*columns).alias("_old")).join(named, "id", "left")
    kept = joined.select("id", "seq", F.coalesce("_new", "_old").alias("_r")).select("id", "seq", "_r.*")
    missing = existing.join(incoming.where(~blank).select("id").distinct(), "id", "left_anti").select("id", "seq")
    if not insert:
        return kept.select(*existing.columns), missing
    last = existing.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))
    new = incoming.where(blank).withColumn("_k", F.lit(1)).join(last.withColumn("_k", F.lit(1)), "_k")
    new = new.withColumns({"id": t.stable_id(F.lit("csv"), F.col("row")), "seq": (F.col("_last") + 1 + F.col("row")).cast(existing.schema["seq"].dataType)})
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns)), missing


def migrated_status(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEGACY_STATUS.items() for x in kv]), c), c)


def update_matches(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``upsert`` by annotation_id, without new records; old names of states are read as today's, and an empty field id is none."""
    new = incoming.withColumnRenamed("annotation_id", "id").withColumns({"status": migrated_status(F.col("status")), "field_id": F.when(F.col("field_id") != "", F.col("field_id"))})
    out, missing = upsert(existing.withColumnRenamed("annotation_id", "id"), new, insert=False)
    return out.withColumnRenamed("id", "annotation_id").select(*existing.columns), missing.withColumnRenamed("id", "annotation_id")


def distinct_values(records: DataFrame, column: str) -> DataFrame:
    """(column): its non-empty values in order, for a choice."""
    return records.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").select(column).distinct().orderBy(column)


def on_page(records: DataFrame, page: int | None, column: str = "page") -> DataFrame:
    """The records of one page; all without one."""
    return records if page is None else records.where(F.col(column) == page)


def shown_of(chosen_: DataFrame, every: DataFrame) -> DataFrame:
    """(shown, total): how many records a filter leaves of how many."""
    n = chosen_.agg(F.count("*").alias("shown"), F.lit(1).alias("_k"))
    return n.join(every.agg(F.count("*").alias("total"), F.lit(1).alias("_k")), "_k").drop("_k")


def removed(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_anti")


def edited(records: DataFrame, key: str, value: str, changes: dict[str, Column]) -> DataFrame:
    """The record of a key with some columns changed."""
    return records.withColumns({c: F.when(F.col(key) == value, v).otherwise(F.col(c)) for c, v in changes.items()})


def deleted(records: DataFrame, key: str, value: str) -> DataFrame:
    return records.where(~F.col(key).eqNullSafe(F.lit(value)))


def added(records: DataFrame, values: dict[str, object]) -> DataFrame:
    """A new record at the end, on page 1 unless ``values`` says otherwise; columns it doesn't name are null."""
    given = {"page": 1, "rect": [0.0, 0.0, 100.0, 20.0]} | ({"matched_rule": "manual"} if "matched_rule" in records.columns else {}) | values
    last = records.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))
    columns = []
    for f in records.schema.fields:
        v = given.get(f.name)
        c = F.col("_last") + 1 if f.name == "seq" and v is None else F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
        columns.append(c.cast(f.dataType).alias(f.name))
    return records.unionByName(last.select(*columns))


def manual_match(matches: DataFrame, annotation_id: str, field_id: str, target_rect: list[float]) -> DataFrame:
    """The record of an annotation linked by hand. Page, confidence and adjustment stay as they were. An annotation without a record is an error."""
    if matches.where(F.col("annotation_id") == annotation_id).isEmpty():
        raise ValueError(f"no match record of annotation {annotation_id!r}")
    rect = F.array(*[F.lit(float(x)) for x in target_rect])
    return edited(matches, "annotation_id", annotation_id, {"field_id": F.lit(field_id), "match_type": F.lit("manual"), "target_rect": rect, "status": F.lit("approved")})


def approve_exact(matches: DataFrame) -> DataFrame:
    return matches.withColumn("status", F.when(F.col("match_type") == "exact", F.lit("approved")).otherwise(F.col("status")))


def reopened(matches: DataFrame, annotation_id: str) -> DataFrame:
    return edited(matches, "annotation_id", annotation_id, {"status": F.lit("re-pairing")})


def manual_targets(pairs: DataFrame, annotations: DataFrame, fields: DataFrame) -> DataFrame:
    """(annotation_id, field_id, target_rect) of pairs chosen by hand, with the guard that automatic ones have."""
    a = annotations.select(F.col("id").alias("annotation_id"), F.col("rect").alias("_a"), F.col("anchor_rect").alias("_anchor"))
    f = keyed(fields, "label").select(F.col("id").alias("field_id"), F.col("id").alias("fid"), F.col("rect").alias("_f"), "pair", "page", "lab", "page_width", "page_height")
    rows = pairs.select("annotation_id", "field_id").join(a, "annotation_id").join(f, "field_id").withColumn("raw", g.raw_target(F.col("_a"), F.col("_anchor"), F.col("_f")))
    return guarded(rows, fields).select("annotation_id", "field_id", "target_rect")


def predicted(pairs: DataFrame, boost: float) -> DataFrame:
    """``pairs`` (anchor_text, avisit, label, fvisit and more) with the confidence that a link by hand would have."""
    return scored(pairs, float("-inf"), boost).withColumn("confidence", t.confidence(F.col("score")))


def confirmed(matches: DataFrame, annotations: DataFrame, fields: DataFrame, annotation_id: str, field_id: str, boost: float) -> DataFrame:
    """A link by hand with its target and predicted confidence."""
    pair = matches.sparkSession.createDataFrame([(annotation_id, field_id)], "annotation_id string, field_id string")
    target = manual_targets(pair, annotations, fields).first()
    if target is None:
        raise ValueError(f"no annotation {annotation_id!r} or no field {field_id!r}")
    a = annotations.where(F.col("id") == annotation_id).select("anchor_text", F.col("visit").alias("avisit"), F.lit(1).alias("_k"))
    f = fields.where(F.col("id") == field_id).select("label", F.col("visit").alias("fvisit"), F.lit(1).alias("_k"))
    sure = predicted(a.join(f, "_k").drop("_k"), boost).first()["confidence"]
    out = manual_match(matches, annotation_id, field_id, target["target_rect"])
    return edited(out, "annotation_id", annotation_id, {"confidence": F.lit(sure)})


def counts_of(records: DataFrame, column: str, values: tuple[str, ...], name: str = "n") -> DataFrame:
    """(column, n) for the fixed values, 0 where there is none; other values don't count."""
    fixed = records.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = records.where(F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias(name))
    return fixed.join(counts, column, "left").select(column, F.coalesce(name, F.lit(0)).cast("long").alias(name))


def distinct_forms(records: DataFrame) -> DataFrame:
    return records.agg(F.countDistinct(F.when(F.col("form_name") != "", F.col("form_name"))).alias("forms"))


def exact_rate(matches: DataFrame, annotations: DataFrame) -> DataFrame:
    """(rate): whole per cent of the annotations that have an exact match, rounded half to even; 0 without annotations."""
    n = annotations.agg(F.count("*").alias("n"), F.lit(1).alias("_k"))
    exact = matches.agg(F.count_if(F.col("match_type") == "exact").alias("e"), F.lit(1).alias("_k"))
    return n.join(exact, "_k").select(F.when(F.col("n") == 0, F.lit(0)).otherwise(F.bround(100.0 * F.col("e") / F.col("n"), 0).cast("int")).alias("rate"))


def pending_exact(matches: DataFrame) -> DataFrame:
    return matches.where((F.col("match_type") == "exact") & (F.col("status") == "pending"))


def greatest_page(records: DataFrame, column: str = "page") -> DataFrame:
    return records.agg(F.coalesce(F.max(column), F.lit(1)).alias("page"))


def chosen(matches: DataFrame, types: list[str], states: list[str]) -> DataFrame:
    """By type and state; an empty list doesn't restrict, but two empty ones choose nothing."""
    if not types and not states:
        return matches.where(F.lit(False))
    tests = [F.col(c).isin(v) for c, v in (("match_type", types), ("status", states)) if v]
    return matches.where(reduce(lambda a, b: a & b, tests))


def restored_choice(before: list[str] | None, available: list[str], first: list[str]) -> list[str]:
    """The earlier choice as far as it is still available; ``first`` only if there was none."""
    return [x for x in (first if before is None else before) if x in available]


def page_groups(matches: DataFrame) -> DataFrame:
    """(target_page): pages in order, and 0 (unmatched) last."""
    return matches.select("target_page").distinct().orderBy(F.col("target_page") == 0, "target_page")


def fields_matching(fields: DataFrame, query: str) -> DataFrame:
    return fields.where(F.contains(F.lower("label"), F.lit(query.lower())))


def field_pages(fields: DataFrame) -> DataFrame:
    return fields.groupBy("page").agg(F.count("*").alias("n"))


def enriched(matches: DataFrame, annotations: DataFrame, fields: DataFrame) -> DataFrame:
    """``matches`` with the annotation's content and anchor and the field's label for lists."""
    a = annotations.select(F.col("id").alias("annotation_id"), "content", "anchor_text")
    f = fields.select(F.col("id").alias("field_id"), t.display_label(F.col("label"), F.col("form_name"), F.col("page")).alias("field_label"))
    out = matches.join(a, "annotation_id", "left").join(f, "field_id", "left")
    return out.withColumn("field_label", F.coalesce("field_label", F.lit("—"))).withColumn("short_content", t.shortened(F.col("content"), 40, F.col("annotation_id")))


def suggestions(annotations: DataFrame, fields: DataFrame, threshold: float, boost: float, k: int = 3) -> DataFrame:
    """(aseq, fseq, score, place), and pair where records have one: the k fields of highest score in an annotation's form, the first of equal ones.

    Texts meet in the fuzzy index, so those that can't reach the threshold aren't scored. Annotations of one text and
    visit have the same list, for which each text and visit among the fields gives its first k: lists are
    made once, and never from all pairs of records.
    """
    block = ["pair", "form"]
    a, f = sides_of(annotations, fields, blank=True)
    a, f = stored(a), stored(f)
    edges = near_classes(a, f, block, threshold, boost)
    first = f.withColumn("_k", F.row_number().over(Window.partitionBy(*block, "d").orderBy("fseq"))).where(F.col("_k") <= k).select(*block, "d", "fseq")
    order = Window.partitionBy(*block, "c").orderBy(F.desc("score"), "fseq")
    best = edges.join(first, [*block, "d"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(*block, "c", "fseq", "score", "place")
    out = a.select(*block, "c", "aseq").join(best, [*block, "c"]).select("pair", "aseq", "fseq", "score", "place")
    return out if {"pair", "doc_id"} & set(annotations.columns) else out.drop("pair")


def record_counts(**kinds: DataFrame) -> DataFrame:
    """(kind, n): how many records there are of each kind."""
    return reduce(lambda x, y: x.unionByName(y), [rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, rows in kinds.items()])


def rule_tester(spark: SparkSession, profile: object, content: str, subject: str) -> tuple[str, str]:
    """What the rules say of one text."""
    from quillmatch.functions.rules import classified

    row = spark.createDataFrame([(content, subject)], "content string, subject string").select(classified(profile, F.col("content"), F.col("subject")).alias("c")).first()
    return row["c"]["category"], row["c"]["matched_rule"]
