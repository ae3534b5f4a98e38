"""Links annotations to fields in four passes, for any number of document pairs at once.

A record's key is (pair, seq): pair names the two documents that are linked, seq is the record's
place in its document, whatever the page. Nothing is compared across pairs. Records that come
without pair have it from a table of pairs, or else from doc_id (a document and its new
version of one name), or else are one pair.

Every pass takes the annotations that the earlier ones left and all fields; a field can
be linked again by a later pass. Passes end in tables of the shared folder, so an anti-join
doesn't compute a score again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.functions import geometry as g
from quillmatch.functions import text as t
from quillmatch.operators.assignment import MOST_EDGES, assigned_classes
from quillmatch.operators.graph import components, shuffled, stored
from quillmatch.operators.near import near_pairs
from quillmatch.operators.scan import ROW_GAP, kept_rows, with_rows
from quillmatch.plans.profile import Matching

SOURCE_SIZE = (595.0, 842.0)
KEY = ["pair", "seq"]
MATCHES = ("annotation_id", "field_id", "match_type", "confidence", "target_rect", "target_page", "status", "user_notes", "placement_adjusted")


def paired(records: DataFrame, pairs: DataFrame | None = None, side: str = "source") -> DataFrame:
    """``records`` with pair. ``pairs``: (pair, source, target), documents by doc_id; a document may be in several. Else the column pair, or doc_id, or one pair of an empty name."""
    if pairs is not None:
        return records.drop("pair").join(shuffled(pairs.select(F.col("pair").cast("string").alias("pair"), F.col(side).alias("_doc"))), F.col("doc_id") == F.col("_doc")).drop("_doc")
    if "pair" in records.columns:
        return records.withColumn("pair", F.col("pair").cast("string"))
    return records.withColumn("pair", F.col("doc_id").cast("string") if "doc_id" in records.columns else F.lit(""))


def page_ranks(records: DataFrame) -> DataFrame:
    """(pair, form, page, rank) over all records: a form's pages in order, from 1."""
    pages = paired(records).select("pair", t.norm(F.col("form_name")).alias("form"), "page").distinct()
    return pages.withColumn("rank", F.dense_rank().over(Window.partitionBy("pair", "form").orderBy("page")))


def short(c: Column) -> Column:
    """16 bytes in place of a text that is only compared: forms and labels may be whole lines, and are keys of every shuffle of a pass."""
    return F.unhex(F.md5(c))


def keyed(records: DataFrame, label: str) -> DataFrame:
    """With form and lab, ``short`` for the normal form of the form's name and of a label."""
    return paired(records).withColumns({"form": short(t.norm(F.col("form_name"))), "lab": short(t.norm(F.col(label))), "y0": F.col("rect")[1]})


Ranks = tuple[DataFrame, DataFrame]


def _short_ranks(records: DataFrame) -> DataFrame:
    return page_ranks(records).withColumn("form", short(F.col("form")))


def ranks_of(annotations: DataFrame, fields: DataFrame) -> Ranks:
    """Page ranks of both sides with ``short`` forms, stored: several passes read them."""
    return stored(_short_ranks(annotations)), stored(_short_ranks(fields))


#: A pair of documents of so many records at most is never parted among tasks; a task holds many such pairs.
WHOLE = 100_000
LABEL = ["pair", "form", "lab"]


def large_pairs(annotations: DataFrame, fields: DataFrame) -> DataFrame | None:
    """(pair,) of more than ``WHOLE`` records, if there are any."""
    large = paired(annotations).select("pair").unionByName(paired(fields).select("pair")).groupBy("pair").agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE).select("pair")
    large = stored(large)
    return None if large.isEmpty() else large


def exact_pairs(annotations: DataFrame, fields: DataFrame, all_annotations: DataFrame | None = None, ranks: Ranks | None = None) -> DataFrame:
    """(pair, aseq, fseq): rows of equal form and label in order, extras to the last field. Groups on one page of the source look at all pages of the target, others at the page of the same rank.

    Pairs of at most ``WHOLE`` records are dealt once, by pair, for all windows of ``_in_pairs``. It leaves
    larger pairs, and labels with heights that have to be folded, to ``_in_segments``.
    """
    every = annotations if all_annotations is None else all_annotations
    return _exact(annotations, fields, every, ranks, large_pairs(every, fields))


def _exact(annotations: DataFrame, fields: DataFrame, every: DataFrame, ranks: Ranks | None, large: DataFrame | None) -> DataFrame:
    said = t.strip(F.col("anchor_text")) != ""
    a, f = _rows(annotations.where(said), "anchor_text", True), _rows(fields, "label", False)
    # What is not linked, such as a blank anchor, still counts for the ranks of pages.
    silent = _rows(annotations.where(~F.coalesce(said, F.lit(False))) if every is annotations else every, "anchor_text", True).withColumn("use", F.lit(False))
    rows = a.unionByName(f).unionByName(silent)
    found = stored(_in_pairs(rows if large is None else rows.join(shuffled(large), "pair", "left_anti")))
    out = found.where("not left").select("pair", "aseq", "fseq")
    rest = found.where("left").drop("left", "aseq", "fseq")
    if large is not None:
        rest = rest.unionByName(rows.join(shuffled(large), "pair").where("use").drop("use"))
    elif rest.isEmpty():
        return out
    of_a, of_f = ranks or (_short_ranks(every), _short_ranks(fields))
    side = lambda c: rest.where(c).select(*LABEL, "page", "y0", "seq")
    return stored(out.unionByName(_in_segments(side("source"), side("not source"), of_a, of_f)))


def _rows(records: DataFrame, label: str, source: bool) -> DataFrame:
    rows = keyed(records, label).select(*LABEL, F.col("page").cast("int").alias("page"), F.col("y0").cast("double").alias("y0"), F.col("seq").cast("long").alias("seq"))
    return rows.withColumns({"source": F.lit(source), "use": F.col("lab").isNotNull()}).where("pair is not null and form is not null")


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Links (aseq, fseq) of whole pairs; of a label whose kept fields depend on each other, the rows as they came (left).

    All windows lie within a pair, so rows are dealt by it and stay where they are. The fields that are kept are
    the first of their rows, as long as no row is higher than ROW_GAP.
    """
    rank = F.dense_rank().over(Window.partitionBy("_f", "pair", "form", "source").orderBy("page"))
    u = rows.repartition("pair").withColumn("_f", F.xxhash64("pair", "form")).withColumn("rank", rank).where("use")
    # A hash comes first, as sorts compare 8 bytes before anything else.
    label = ["_l", *LABEL]
    u = u.drop("_f").withColumn("_l", F.xxhash64(*LABEL))
    order = Window.partitionBy(*label, "source").orderBy("page", "y0", "seq")
    upto, page = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*label, "source", "page").orderBy("y0", "seq")
    new = F.coalesce(~F.col("page").eqNullSafe(F.lag("page").over(order)) | (F.abs(F.col("y0") - F.lag("y0").over(order)) > ROW_GAP), F.lit(False))
    first = F.row_number().over(order) == 1
    u = u.withColumns({"new": new, "first": first}).withColumn("new", F.col("new") & ~F.col("first"))
    # The height of the row's start, in a struct because it may be null.
    start = F.last(F.when(F.col("new") | F.col("first"), F.struct("y0")), ignorenulls=True).over(upto)["y0"]
    u = u.withColumns({"row": F.sum(F.col("new").cast("int")).over(upto), "high": ~F.col("source") & F.coalesce(F.abs(F.col("y0") - start) > ROW_GAP, F.lit(False))})
    u = u.withColumn("in_page", F.col("row") - F.min("row").over(page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    key = Window.partitionBy(*label)
    of = F.when(F.col("source"), F.col("page"))
    u = u.withColumns({"many": F.min(of).over(key) < F.max(of).over(key), "left": F.max("high").over(key), "both": F.min("source").over(key) < F.max("source").over(key)}).where("both and many is not null")
    # Of the fields, the first of each row; in a label on many pages, rows with a page.
    u = u.where("left or ((source or new or first) and (not many or page is not null))")
    u = u.withColumns({"part": F.when(F.col("many"), F.col("rank")).otherwise(0), "row": F.when(F.col("many"), F.col("in_page")).otherwise(F.col("row"))})
    kept = F.max(F.when(~F.col("source"), F.col("row"))).over(Window.partitionBy(*label, "left", "part"))
    u = u.withColumn("at", F.when(F.col("left"), F.col("row")).when(F.col("source"), F.least("row", kept)).otherwise(F.col("row")))
    field = F.max(F.when(~F.col("source"), F.col("seq"))).over(Window.partitionBy(*label, "left", "part", "at"))
    u = u.withColumn("fseq", field).where("left or (source and fseq is not null)")
    only = lambda c: F.when(F.col("left"), F.col(c)).alias(c)
    return u.select("pair", "left", *[F.when(~F.col("left"), c).alias(n) for c, n in ((F.col("seq"), "aseq"), (F.col("fseq"), "fseq"))], *[only(c) for c in ("form", "lab", "page", "y0", "seq", "source")])


def _in_segments(a: DataFrame, f: DataFrame, of_a: DataFrame, of_f: DataFrame) -> DataFrame:
    """``exact_pairs`` for keys of any size; ``a`` and ``f``: (pair, form, lab, page, y0, seq)."""
    key = LABEL
    pages = a.groupBy(*key).agg((F.min("page") < F.max("page")).alias("_many"))
    a = a.join(shuffled(pages), key)
    kept = stored(kept_rows(f, key))

    one = with_rows(a.where("not _many"), key)
    last = kept.groupBy(*key).agg(F.count("*").alias("n"))
    first = one.join(shuffled(last), key).withColumn("pos", F.least("row", (F.col("n") - 1).cast("int"))).join(shuffled(kept.select(*key, "pos", F.col("seq").alias("fseq"))), [*key, "pos"]).select("pair", F.col("seq").alias("aseq"), "fseq")

    # A rank is a page of the form, and places on a page follow each other.
    ranked = [*key, "rank"]
    many = with_rows(a.where("_many").join(shuffled(of_a), ["pair", "form", "page"]), ranked)
    by_rank = kept.join(shuffled(of_f), ["pair", "form", "page"]).select(*ranked, "pos", F.col("seq").alias("fseq"))
    last = by_rank.groupBy(*ranked).agg(F.count("*").alias("n"), F.min("pos").alias("_from"))
    second = many.join(shuffled(last), ranked).withColumn("pos", F.col("_from") + F.least("row", (F.col("n") - 1).cast("int"))).join(shuffled(by_rank), [*ranked, "pos"]).select("pair", F.col("seq").alias("aseq"), "fseq")
    return first.union(second)


def scored(pairs: DataFrame, threshold: float, boost: float) -> DataFrame:
    """``pairs`` (anchor_text, avisit, label, fvisit and more) with score, where it reaches ``threshold`` (0 to 100).

    A pair whose lengths can't reach it is dropped first, without loss; each distinct
    pair of texts is scored once.
    """
    bonus = boost * t.visit_match(F.col("avisit"), F.col("fvisit"))
    sorted_ = pairs.withColumns({"_a": t.token_sorted(F.col("anchor_text")), "_f": t.token_sorted(F.col("label")), "_bonus": bonus})
    hopeful = sorted_.where(t.best_possible(F.col("_a"), F.col("_f")) + F.col("_bonus") >= threshold)
    raw = hopeful.select("_a", "_f").distinct().withColumn("_raw", t.indel_ratio(F.col("_a"), F.col("_f")))
    return hopeful.join(shuffled(raw), ["_a", "_f"]).withColumn("score", F.col("_raw") + F.col("_bonus")).where(F.col("score") >= threshold).drop("_a", "_f", "_raw", "_bonus")


def sides_of(annotations: DataFrame, fields: DataFrame, blank: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records that a fuzzy pass compares (``blank``: annotations without an anchor too), with their token-sorted texts and the class (text and visit) that decides their scores."""
    said = annotations if blank else annotations.where(t.strip(F.col("anchor_text")) != "")
    a = paired(said).select("pair", short(t.norm(F.col("form_name"))).alias("form"), "page", F.col("seq").alias("aseq"), t.token_sorted(F.col("anchor_text")).alias("_a"), F.col("visit").alias("avisit"))
    f = paired(fields).select("pair", short(t.norm(F.col("form_name"))).alias("form"), "page", F.col("seq").alias("fseq"), t.token_sorted(F.col("label")).alias("_f"), F.col("visit").alias("fvisit"))
    return a.withColumn("c", F.xxhash64("_a", "avisit")), f.withColumn("d", F.xxhash64("_f", "fvisit"))


#: A table of so many pairs of similar texts at most is copied ``COPIES`` times for its join, as few texts are many blocks' rows.
FEW, COPIES = 100_000, 32


def near_classes(a: DataFrame, f: DataFrame, keys: list[str], threshold: float, boost: float) -> DataFrame:
    """(keys, c, d, score) of the classes of a block that reach the threshold. Only distinct texts are compared.

    Where all texts together make fewer pairs than the texts of the blocks, since they come again in many
    blocks, they are compared once for all blocks.
    """
    least = threshold - max(boost, 0.0)
    if least <= 0:
        return _near_in_blocks(a, f, keys, threshold, boost)
    # The one block is stored too: a join by a literal would be planned as one without a key.
    texts = [stored(side.select(c).distinct().withColumn("_k", F.lit(0))) for side, c in ((a, "_a"), (f, "_f"))]
    one = stored(a.select(*keys, short(F.col("_a")).alias("_a"), "avisit", "c").distinct())
    two = f.select(*keys, short(F.col("_f")).alias("_f"), "fvisit", "d")
    count = lambda side, n: side.groupBy(*keys).agg(F.count("*").alias(n))
    inside = lambda: count(one, "_n").join(shuffled(count(two.distinct(), "_m")), keys).agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0.0
    pairs, rows = texts[0].count() * texts[1].count(), one.count()
    if pairs > rows and pairs > inside():
        return _near_in_blocks(a, f, keys, threshold, boost)
    near = near_pairs(*texts, ["_k"], least)
    near = stored(near.select(short(F.col("_a")).alias("_a"), short(F.col("_f")).alias("_f"), "_raw"))
    hashed = lambda x, by: x.withColumn("_h", F.xxhash64(*by))
    degrees = near.groupBy("_a").agg(F.count("*").alias("_m"))
    reached = one.groupBy("_a").agg(F.count("*").alias("_n")).join(shuffled(degrees), "_a").agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    if reached <= 4 * rows or reached <= inside():
        copies, by = COPIES if near.count() <= FEW else 1, [*keys, "_f"]
        one = one.withColumn("_copy", F.pmod(F.xxhash64(*keys), F.lit(copies)))
        near = near.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
        met = hashed(one.join(shuffled(near), ["_a", "_copy"]), by).join(shuffled(hashed(two, by)), ["_h", *by])
    else:
        met = one.join(shuffled(two.distinct()), keys).join(shuffled(near), ["_a", "_f"])
    score = F.col("_raw") + boost * t.visit_match(F.col("avisit"), F.col("fvisit"))
    return met.withColumn("score", score).where(F.col("score") >= threshold).select(*keys, "c", "d", "score").distinct()


def _near_in_blocks(a: DataFrame, f: DataFrame, keys: list[str], threshold: float, boost: float) -> DataFrame:
    """``near_classes`` of each block by itself."""
    one, two = a.select(*keys, "_a", "avisit", "c").distinct(), f.select(*keys, "_f", "fvisit", "d").distinct()
    near = near_pairs(one.select(*keys, "_a"), two.select(*keys, "_f"), keys, threshold - max(boost, 0.0)).select(*keys, short(F.col("_a")).alias("_a"), short(F.col("_f")).alias("_f"), "_raw")
    one, two = one.withColumn("_a", short(F.col("_a"))), two.withColumn("_f", short(F.col("_f")))
    score = F.col("_raw") + boost * t.visit_match(F.col("avisit"), F.col("fvisit"))
    return near.join(shuffled(one), [*keys, "_a"]).join(shuffled(two), [*keys, "_f"]).withColumn("score", score).where(F.col("score") >= threshold).select(*keys, "c", "d", "score")


class Classes:
    """The problem of a fuzzy pass: edges (pair, g, c, d, score) between classes, and their members (pair, g, c, aseq), (pair, g, d, fseq)."""

    def __init__(self, edges: DataFrame, annotations: DataFrame, fields: DataFrame) -> None:
        self.edges, self.annotations, self.fields = edges, annotations, fields

    def records(self) -> DataFrame:
        """(pair, g, aseq, fseq, score) of all pairs of members; as many as there are."""
        return self.edges.join(shuffled(self.annotations), ["pair", "g", "c"]).join(shuffled(self.fields), ["pair", "g", "d"]).select("pair", "g", "aseq", "fseq", "score")

    def assigned(self, mode: str) -> DataFrame:
        return assigned_classes(self.edges, self.annotations, self.fields, mode)


def same_form(annotations: DataFrame, fields: DataFrame, all_annotations: DataFrame, threshold: float, boost: float, ranks: Ranks | None = None) -> Classes:
    """Annotations and fields of one form on pages of one rank; g is the block."""
    a, f = sides_of(annotations, fields)
    return _same_form(a, stored(f), threshold, boost, ranks or (_short_ranks(all_annotations), _short_ranks(fields)))


def _same_form(a: DataFrame, f: DataFrame, threshold: float, boost: float, ranks: Ranks) -> Classes:
    """``same_form`` of sides. A block is a form's page of the target; annotations get the one that has the rank of theirs."""
    of_a, of_f = ranks
    pages = of_a.withColumnRenamed("page", "_page").join(shuffled(of_f), ["pair", "form", "rank"]).select("pair", "form", "_page", "page")
    a = stored(a.withColumnRenamed("page", "_page").join(shuffled(pages), ["pair", "form", "_page"]).drop("_page"))
    group = F.xxhash64("form", "page").alias("g")
    edges = stored(near_classes(a, f, ["pair", "form", "page"], threshold, boost).select("pair", group, "c", "d", "score"))
    return Classes(edges, a.select("pair", group, "c", "aseq"), f.select("pair", group, "d", "fseq"))


def cross_form(annotations: DataFrame, fields: DataFrame, threshold: float, boost: float, most: int = MOST_EDGES) -> Classes:
    """All annotations and fields of a pair of documents; g is 0 in a pair of few edges, else the component of classes: components can be assigned by themselves."""
    a, f = (stored(x) for x in sides_of(annotations, fields))
    return _cross_form(a, f, threshold, boost, most)


def _cross_form(a: DataFrame, f: DataFrame, threshold: float, boost: float, most: int = MOST_EDGES) -> Classes:
    near = stored(near_classes(a, f, ["pair"], threshold, boost))
    large = near.groupBy("pair").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("pair")
    zero = F.lit(0).cast("long").alias("g")
    if large.isEmpty():
        edges = near.select("pair", zero, "c", "d", "score")
    else:
        node = lambda side, c: F.concat_ws("/", F.lit(side), F.col(c).cast("string"), "pair")
        hot = near.join(large, "pair")
        names = components(hot.select(node("a", "c").alias("a"), node("f", "d").alias("b"))).withColumnRenamed("node", "_n")
        parted = hot.withColumn("_n", node("a", "c")).join(shuffled(names), "_n").select("pair", F.xxhash64("root").alias("g"), "c", "d", "score")
        edges = stored(near.join(large, "pair", "left_anti").select("pair", zero, "c", "d", "score").unionByName(parted))
    of_a, of_f = (shuffled(edges.select("pair", "g", x).distinct()) for x in "cd")
    return Classes(edges, a.join(of_a, ["pair", "c"]).select("pair", "g", "c", "aseq"), f.join(of_f, ["pair", "d"]).select("pair", "g", "d", "fseq"))


def same_form_edges(annotations: DataFrame, fields: DataFrame, all_annotations: DataFrame, threshold: float, boost: float) -> DataFrame:
    """(pair, g, aseq, fseq, score) of ``same_form`` by records."""
    return same_form(annotations, fields, all_annotations, threshold, boost).records()


def cross_form_edges(annotations: DataFrame, fields: DataFrame, threshold: float, boost: float) -> DataFrame:
    """(pair, g, aseq, fseq, score) of ``cross_form`` by records."""
    return cross_form(annotations, fields, threshold, boost).records()


def _with_peer(f: DataFrame) -> DataFrame:
    """Fields (pair, page, lab, fid, fseq, _frect and more) with _peer, the rect of the leftmost other field of the page and label; a page and label are one task."""
    order = Window.partitionBy("_l", "pair", "page", "lab").orderBy(F.col("_frect")[0], "fseq", "fid")
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    field = F.struct(F.col("fid").alias("id"), F.col("_frect").alias("rect"))
    f = f.withColumn("_l", F.xxhash64("pair", "page", "lab"))
    f = f.withColumns({"_one": F.first(field).over(full), "_two": F.nth_value(field, 2).over(full)})
    other = F.when(F.col("_one")["id"] != F.col("fid"), F.col("_one")["rect"]).when(F.col("_two")["id"] != F.col("fid"), F.col("_two")["rect"])
    return f.withColumn("_peer", F.when(F.col("pair").isNotNull() & F.col("page").isNotNull() & F.col("lab").isNotNull(), other)).drop("_l", "_one", "_two")


def _moved(pairs: DataFrame, peer: Column) -> DataFrame:
    off = g.outside(F.col("raw"), F.col("page_width"), F.col("page_height"))
    out = pairs.withColumn("_peer", F.when(off, peer)).withColumn("_rect", F.coalesce("_peer", "raw")).withColumn("target_rect", g.clamped(F.col("_rect"), F.col("page_width"), F.col("page_height")))
    return out.withColumn("placement_adjusted", F.col("_peer").isNotNull() | (F.col("target_rect") != F.col("_rect"))).drop("_two", "_peer", "_rect")


def guarded(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """``pairs`` (raw, pair, page, lab, fid, page_width, page_height and more) with target_rect and placement_adjusted.

    A target outside the page takes the leftmost other field of the page with the
    same label, if there is one, and is then clamped to the page.
    """
    first = F.row_number().over(Window.partitionBy("pair", "page", "lab").orderBy(F.col("rect")[0], "seq", "id"))
    two = keyed(fields, "label").withColumn("_n", first).where("_n <= 2")
    peers = two.groupBy("pair", "page", "lab").agg(F.array_sort(F.collect_list(F.struct(F.col("rect")[0].alias("x0"), "seq", "id", "rect"))).alias("_two")).where(F.size("_two") > 1)
    other = F.get(F.filter("_two", lambda p: p["id"] != F.col("fid")), 0)
    return _moved(pairs.join(shuffled(peers), ["pair", "page", "lab"], "left"), other["rect"])


def linked(pairs: DataFrame, annotations: DataFrame, fields: DataFrame, kind: str | Column, confidence: Column, status: str | Column) -> DataFrame:
    """Match records of (pair, aseq, fseq and what ``confidence`` uses)."""
    a = paired(annotations).select("pair", F.col("seq").alias("aseq"), "id", "rect", "anchor_rect")
    return _linked(pairs.join(shuffled(a), ["pair", "aseq"]), fields, kind, confidence, status)


def _linked(annotations: DataFrame, fields: DataFrame, kind: str | Column, confidence: Column, status: str | Column, whole: bool = False) -> DataFrame:
    """Match records of annotations (pair, aseq, fseq, id, rect, anchor_rect and what ``confidence`` uses). ``whole``: no pair is large."""
    a = annotations.withColumnsRenamed({"id": "annotation_id", "rect": "_arect", "anchor_rect": "_anchor"})
    f = keyed(fields, "label").select("pair", F.col("seq").alias("fseq"), F.col("id").alias("fid"), F.col("rect").alias("_frect"), "page", "lab", "page_width", "page_height")
    rows = a.join(shuffled(_with_peer(f) if whole else f), ["pair", "fseq"]).withColumn("raw", g.raw_target(F.col("_arect"), F.col("_anchor"), F.col("_frect")))
    return (_moved(rows, F.col("_peer")) if whole else guarded(rows, fields)).select(
        "pair",
        F.col("aseq").alias("seq"),
        "annotation_id",
        F.col("fid").alias("field_id"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("match_type"),
        confidence.alias("confidence"),
        "target_rect",
        F.col("page").alias("target_page"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        F.lit("").alias("user_notes"),
        "placement_adjusted",
    )


def _sizes(dims: DataFrame, width: str, height: str) -> tuple[DataFrame, list[str]]:
    """Page sizes, and what they are looked up by: (pair, page), or the page alone where they aren't by document."""
    by = ["pair", "page"] if "pair" in dims.columns or "doc_id" in dims.columns else ["page"]
    return (shuffled(paired(dims)) if len(by) == 2 else dims).select(*by, F.col("width").alias(width), F.col("height").alias(height)), by


def positioned(annotations: DataFrame, fields: DataFrame, source_dims: DataFrame, target_dims: DataFrame, confidence: float) -> DataFrame:
    """Match records by position alone. Both page sizes are looked up by the source's page number; domain labels keep their place, others are scaled if their form is among the pair's fields and stay unmatched if not."""
    forms = paired(fields).select("pair", t.norm(F.col("form_name")).alias("form")).distinct().withColumn("_known", F.lit(True))
    s, by_s = _sizes(source_dims, "sw", "sh")
    d, by_d = _sizes(target_dims, "tw", "th")
    a = paired(annotations).withColumn("form", t.norm(F.col("form_name"))).join(shuffled(forms), ["pair", "form"], "left").join(s, by_s, "left").join(d, by_d, "left")
    sw, sh = F.coalesce("sw", F.lit(SOURCE_SIZE[0])), F.coalesce("sh", F.lit(SOURCE_SIZE[1]))
    label, known = F.col("category") == "domain_label", F.col("_known").isNotNull()
    tw = F.when(label, F.coalesce("tw", F.lit(0.0))).otherwise(F.coalesce(F.col("tw"), sw))
    th = F.when(label, F.coalesce("th", F.lit(0.0))).otherwise(F.coalesce(F.col("th"), sh))
    free = F.when(label, F.col("rect")).when(known, g.scaled(F.col("rect"), sw, sh, tw, th)).otherwise(F.col("rect"))
    a = a.withColumns({"_free": free, "_tw": tw, "_th": th, "_placed": label | known})
    a = a.withColumn("target_rect", F.when(F.col("_placed"), g.clamped(F.col("_free"), F.col("_tw"), F.col("_th"))).otherwise(F.col("_free")))
    return a.select(
        "pair",
        "seq",
        F.col("id").alias("annotation_id"),
        F.lit(None).cast("string").alias("field_id"),
        F.when(F.col("_placed"), "position_only").otherwise("unmatched").alias("match_type"),
        F.when(F.col("_placed"), F.lit(confidence)).otherwise(F.lit(0.0)).alias("confidence"),
        "target_rect",
        F.when(F.col("_placed"), F.col("page")).otherwise(F.lit(0)).alias("target_page"),
        F.lit("re-pairing").alias("status"),
        F.lit("").alias("user_notes"),
        (F.col("target_rect") != F.col("_free")).alias("placement_adjusted"),
    )


def left_over(annotations: DataFrame, *passes: DataFrame) -> DataFrame:
    """The annotations that no pass (pair, aseq and more) has linked."""
    annotations = paired(annotations)
    for p in passes:
        annotations = annotations.join(shuffled(p.select("pair", F.col("aseq").alias("seq"))), KEY, "left_anti")
    return annotations


def match_annotations(
    annotations: DataFrame, fields: DataFrame, source_dims: DataFrame, target_dims: DataFrame, config: Matching | None = None, assignment: str = "greedy", pairs: DataFrame | None = None, at_hand: bool = False
) -> DataFrame:
    """One match record for each annotation of each pair, with pair and seq: exact, fuzzy in the form, fuzzy in all, by position. ``at_hand``: the records are cheap to read again."""
    c = config or Matching()
    if pairs is not None:
        annotations, source_dims = (paired(x, pairs, "source") for x in (annotations, source_dims))
        fields, target_dims = (paired(x, pairs, "target") for x in (fields, target_dims))
    annotations, fields = (x if at_hand else stored(x) for x in (paired(annotations), paired(fields)))
    ranks = ranks_of(annotations, fields)
    large = large_pairs(annotations, fields)
    exact = _exact(annotations, fields, annotations, ranks, large)
    a, f = (stored(x) for x in sides_of(left_over(annotations, exact), fields))
    same = stored(_same_form(a, f, 100 * c.fuzzy_same_form_threshold, c.visit_boost, ranks).assigned(assignment))
    rest = stored(a.join(shuffled(same.select("pair", "aseq")), ["pair", "aseq"], "left_anti"))
    cross = stored(_cross_form(rest, f, 100 * c.fuzzy_cross_form_threshold, c.visit_boost).assigned(assignment))

    links = exact.withColumn("score", F.lit(None).cast("double")).unionByName(same).unionByName(cross)
    used = annotations.select("pair", "seq", "id", "page", "category", "form_name", "rect", "anchor_rect")
    every = stored(used.join(shuffled(links.withColumnRenamed("aseq", "seq")), KEY, "left"))
    exactly = F.col("score").isNull()
    kind, status = F.when(exactly, "exact").otherwise("fuzzy"), F.when(exactly, "approved").otherwise("re-pairing")
    linked_ones = every.where("fseq is not null").select("pair", F.col("seq").alias("aseq"), "fseq", "score", "id", "rect", "anchor_rect")
    found = _linked(linked_ones, fields, kind, F.when(exactly, F.lit(c.exact_threshold)).otherwise(t.confidence(F.col("score"))), status, large is None)
    placed = positioned(every.where("fseq is null").drop("fseq", "score"), fields, source_dims, target_dims, c.position_fallback_confidence)
    return found.unionByName(placed)
