"""Pages of text spans: form names, visits, labels, fields.

``spans``: doc_id, page, seq, text, font_size, bold, rect. All operators work page by
page; a page's spans meet in a join or an aggregation keyed by (doc_id, page), and the
order of a list in other systems is the column seq here: of spans and raw annotations their
place on the page, of records (``annotations_of``, ``fields_of``) their place in the document, which
is unique there. Joins by place compare bands of ``BAND`` points and tiles, not all of a page with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.functions import geometry as g
from quillmatch.functions.rules import excluded, prefixed, visit
from quillmatch.functions.text import found, stable_id, strip
from quillmatch.operators.graph import stored
from quillmatch.plans.profile import Profile

PAGE = ["doc_id", "page"]
KEY = [*PAGE, "seq"]
BAND, TILE = 32.0, 64.0
OVERLAP, LABEL_GAP, TOP_PART = 0.3, 30.0, 0.35

# What makes a span a marker of a field, and the sign of a page of code lists.
CODELIST = r"^Codelist\b"
DATE = r"^\s*(?:(?:MM|DD|MON|YYYY|YY)[\s/\-]*)+\s*$|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
CHECKBOX = r"^\s*(yes|no|y\s*/\s*n|yes\s*/\s*no)\s*$|[□☐☑✓✗]"
TEXT_FIELD = r"_{3,}"


def marker_type(text: Column) -> Column:
    """date_field, checkbox, text_field, or null for a span that is no marker."""
    return F.when(found(text, DATE), "date_field").when(found(text, CHECKBOX), "checkbox").when(found(text, TEXT_FIELD), "text_field")


def bold_span(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(16) != 0) | F.contains(F.lower(font), F.lit("bold"))


def text_spans(blocks: DataFrame) -> DataFrame:
    """Spans of pages whose ``blocks`` are nested: array<struct<type, lines: array<struct<spans: array<struct<text, size, flags, font, bbox>>>>>>. Images and empty spans go."""
    s = (
        blocks.select(*PAGE, F.posexplode("blocks").alias("b", "block"))
        .where("block.type = 0")
        .select(*PAGE, "b", F.posexplode("block.lines").alias("l", "line"))
        .select(*PAGE, "b", "l", F.posexplode("line.spans").alias("s", "span"))
        .withColumn("text", strip(F.col("span.text")))
        .where("text <> ''")
    )
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("b", "l", "s")) - 1
    return s.select(
        *PAGE, order.alias("seq"), "text", F.coalesce("span.size", F.lit(10.0)).alias("font_size"), bold_span(F.col("span.flags"), F.coalesce("span.font", F.lit(""))).alias("bold"), F.col("span.bbox").alias("rect")
    )


def annotation_rects(raw: DataFrame, types: list[str] | None = None) -> DataFrame:
    out = raw if types is None else raw.where(F.lower("subtype").isin([t.lower() for t in types]))
    return out.select(*PAGE, "rect")


def record_seq(page: Column, seq: Column, part: Column | int = 0) -> Column:
    """The place of a record in its document: by page, by part (0 or 1) of the page's records, by place there. Unique and in order for up to 2**31 spans a page."""
    part = F.lit(part) if isinstance(part, int) else part
    return F.shiftleft(page.cast("long"), 32) + F.shiftleft(part.cast("long"), 31) + seq


def _cells(low: Column, high: Column, size: float) -> Column:
    """The numbers of the bands that reach from ``low`` to ``high``."""
    return F.sequence(F.floor(low / size), F.greatest(F.floor(low / size), F.floor(high / size)))


def _tiles(rect: Column) -> Column:
    """The tiles that a rectangle touches, as structs (tx, ty)."""
    return F.flatten(F.transform(_cells(rect[0], rect[2], TILE), lambda x: F.transform(_cells(rect[1], rect[3], TILE), lambda y: F.struct(x.alias("tx"), y.alias("ty")))))


def without_annotated(spans: DataFrame, rects: DataFrame, share: float = OVERLAP) -> DataFrame:
    """Spans of whose area no single annotation covers ``share``.

    Both sides are dealt to the tiles that they touch and meet where the corner of their common part
    lies, so a span meets the annotations around it, each once. Without a positive share
    every span with an annotation on its page would go, which needs no tiles.
    """
    if share <= 0:
        return spans.join(rects.select(*PAGE).distinct(), PAGE, "left_anti")
    s = spans.where(((F.col("rect")[2] - F.col("rect")[0]) * (F.col("rect")[3] - F.col("rect")[1])) > 0).select(*KEY, F.col("rect").alias("_span"), F.inline(_tiles(F.col("rect"))))
    r = rects.select(*PAGE, F.col("rect").alias("_rect"), F.inline(_tiles(F.col("rect"))))
    x, y = (F.floor(F.greatest(F.col("_span")[k], F.col("_rect")[k]) / TILE) for k in (0, 1))
    met = s.join(r, [*PAGE, "tx", "ty"]).where((F.col("tx") == x) & (F.col("ty") == y) & (g.overlap_share(F.col("_span"), F.col("_rect")) >= share))
    return spans.join(met.select(*KEY).distinct(), KEY, "left_anti")


def without_codelists(spans: DataFrame, dims: DataFrame, profile: Profile) -> DataFrame:
    """Without the pages whose top part holds a code list's title."""
    part = profile.form_name_rules.top_region_fraction or TOP_PART
    pages = spans.join(dims, PAGE).where((F.col("height") > 0) & (F.col("rect")[1] <= part * F.col("height")) & found(F.col("text"), CODELIST))
    return spans.join(pages.select(*PAGE).distinct(), PAGE, "left_anti")


def page_text(spans: DataFrame) -> DataFrame:
    """(doc_id, page, page_text): the spans in their order, joined by a space."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return spans.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("page_text"))


def page_visits(spans: DataFrame, profile: Profile) -> DataFrame:
    return page_text(spans).select(*PAGE, visit(profile.visit_rules, F.col("page_text")).alias("visit"))


def form_names(spans: DataFrame, profile: Profile, dims: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, form_name) by the profile's strategy; empty where no span will do. With ``dims`` only the top region counts."""
    c = profile.form_name_rules
    s = spans.withColumn("t", strip(F.col("text")))
    top = s
    if dims is not None and c.top_region_fraction is not None:
        top = s.join(dims.select(*PAGE, "height"), PAGE, "left").where((F.coalesce("height", F.lit(0.0)) <= 0) | (F.col("rect")[1] <= c.top_region_fraction * F.col("height")))
    good = (F.col("t") != "") & ~excluded(profile, F.col("t"))
    if c.strategy == "top_left_block":
        left = F.min(F.col("rect")[0]).over(Window.partitionBy(*PAGE)) + profile.anchor_text_config.left_column_tolerance_px
        top = top.withColumn("_left", left).where((F.col("rect")[0] <= F.col("_left")) & good)
        order = F.struct(F.col("rect")[1], "seq")
    else:
        top = top.where(good & (F.col("font_size") >= c.min_font_size))
        order = F.struct(~F.col("bold"), -F.col("font_size"), F.col("rect")[1], "seq")
    name = top.groupBy(*PAGE).agg(F.min_by("t", order).alias("scanned"))
    pages = s.groupBy(*PAGE).agg(
        *([F.min_by(prefixed(c.label_prefix, F.col("text")), F.when(prefixed(c.label_prefix, F.col("text")).isNotNull(), F.col("seq"))).alias("given")] if c.label_prefix is not None else [F.lit(None).cast("string").alias("given")])
    )
    return pages.join(name, PAGE, "left").select(*PAGE, F.coalesce("given", "scanned", F.lit("")).alias("form_name"))


def nearest_labels(markers: DataFrame, blocks: DataFrame, profile: Profile, most: float | None = None) -> DataFrame:
    """``markers`` (key columns, doc_id, page, seq, rect) with label and label_rect: the nearest span of the page's left column, "" and null without one.

    Nearest: least vertical gap, then least distance of the span's middle from the
    marker's top, then the span's order. The column is measured on all ``blocks``.

    Heights are cut into bands. Spans stand in the bands that they touch, and a marker looks into the bands within
    ``most`` of it; it meets a span once, in the first band that both share. Without ``most`` it looks as far as a
    band first; markers that found nothing there go on to the nearest bands with spans above
    and below them.
    """
    left = F.min(F.col("rect")[0]).over(Window.partitionBy(*PAGE)) + profile.anchor_text_config.left_column_tolerance_px
    b = blocks.withColumn("_left", left).where(F.col("rect")[0] <= F.col("_left")).withColumn("_text", strip(F.col("text")))
    b = b.where((F.col("_text") != "") & ~excluded(profile, F.col("_text"))).select(*PAGE, F.col("seq").alias("_seq"), "_text", F.col("rect").alias("_rect"))
    m = markers.select(*PAGE, "seq", "rect")
    if most is None:
        b = stored(b)  # read three times
    best = _nearest(m, b, BAND if most is None else most)
    if most is None:
        best = best.unionByName(_farther(m.join(best.select(*KEY), KEY, "left_anti"), b))
    return markers.join(best, KEY, "left").select(*markers.columns, F.coalesce("_best._text", F.lit("")).alias("label"), F.col("_best._rect").alias("label_rect"))


def _low_high(rect: Column) -> tuple[Column, Column]:
    return F.least(rect[1], rect[3]), F.greatest(rect[1], rect[3])


def _best(pairs: DataFrame) -> DataFrame:
    order = F.struct(g.vertical_gap(F.col("rect"), F.col("_rect")), g.centre_distance(F.col("rect"), F.col("_rect")), "_seq")
    return pairs.groupBy(*KEY).agg(F.min_by(F.struct("_text", "_rect"), order).alias("_best"))


def _nearest(m: DataFrame, b: DataFrame, far: float) -> DataFrame:
    """(doc_id, page, seq, _best) of the markers that have a span within ``far``."""
    low, high = _low_high(F.col("rect"))
    other_low, other_high = _low_high(F.col("_rect"))
    one = m.select("*", F.explode(_cells(low - far, high + far, BAND)).alias("_band"))
    two = b.select("*", F.explode(_cells(other_low, other_high, BAND)).alias("_band"))
    first = F.greatest(F.floor((low - far) / BAND), F.floor(other_low / BAND)) == F.col("_band")
    return _best(one.join(two, [*PAGE, "_band"]).where(first & (g.vertical_gap(F.col("rect"), F.col("_rect")) <= far)))


def _farther(m: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, page, seq, _best) of markers whose nearest span is more than a band away: it ends in the last band above the marker in which one ends, or starts in the first below it in which one starts."""
    low, high = (F.floor(c / BAND) for c in _low_high(F.col("rect")))
    other_low, other_high = (F.floor(c / BAND) for c in _low_high(F.col("_rect")))
    b = b.withColumns({"_up": other_high, "_down": other_low})
    # As many as a page has bands, whatever stands on it.
    bands = b.groupBy(*PAGE).agg(F.collect_set("_up").alias("_ends"), F.collect_set("_down").alias("_starts"))
    looked = m.join(bands, PAGE).select(*KEY, "rect", F.array_max(F.filter("_ends", lambda x: x < low)).alias("_up"), F.array_min(F.filter("_starts", lambda x: x > high)).alias("_down"))
    columns = [*KEY, "rect", "_seq", "_text", "_rect"]
    return _best(looked.join(b.drop("_down"), [*PAGE, "_up"]).select(*columns).unionByName(looked.join(b.drop("_up"), [*PAGE, "_down"]).select(*columns)))


def section_headers(blocks: DataFrame, profile: Profile) -> DataFrame:
    """Bold or large spans that aren't boilerplate."""
    t = strip(F.col("text"))
    return blocks.where((F.col("bold") | (F.col("font_size") >= profile.form_name_rules.min_font_size)) & ~excluded(profile, t)).withColumn("label", t)


def fields_of(spans: DataFrame, dims: DataFrame, profile: Profile) -> DataFrame:
    """The field records of every page: headers and markers with their labels, the page's visit, and its form name (the topmost, then leftmost label that isn't boilerplate)."""
    typed = stored(without_codelists(spans, dims, profile).withColumn("field_type", marker_type(F.col("text"))))  # read by each step below
    s = typed.drop("field_type")
    blocks, markers = typed.where("field_type is null").drop("field_type"), typed.where("field_type is not null")
    heads = section_headers(blocks, profile).select(*PAGE, "seq", "rect", "label", F.lit("section_header").alias("field_type"), F.lit(0).alias("pass"))
    marked = nearest_labels(markers, blocks, profile, LABEL_GAP).select(
        *PAGE, "seq", "rect", F.when(F.col("label") == "", F.col("text")).otherwise(F.col("label")).alias("label"), "field_type", F.lit(1).alias("pass")
    )
    records = heads.unionByName(marked)
    names = records.where(~excluded(profile, F.col("label"))).groupBy(*PAGE).agg(F.min_by("label", F.struct(F.col("rect")[1], F.col("rect")[0], "pass", "seq")).alias("form_name"))
    return (
        records.join(names, PAGE, "left")
        .join(page_visits(s, profile), PAGE, "left")
        .join(dims, PAGE, "left")
        .select(
            stable_id(F.col("doc_id"), F.col("page"), F.col("pass"), F.col("seq")).alias("id"),
            "doc_id",
            record_seq(F.col("page"), F.col("seq"), F.col("pass")).alias("seq"),
            "page",
            "label",
            F.coalesce("form_name", F.lit("")).alias("form_name"),
            F.coalesce("visit", F.lit("")).alias("visit"),
            "rect",
            "field_type",
            F.coalesce("width", F.lit(0.0)).alias("page_width"),
            F.coalesce("height", F.lit(0.0)).alias("page_height"),
        )
    )


def wanted_annotations(raw: DataFrame, profile: Profile) -> DataFrame:
    """Annotations of the types included, and with content if it has to be there (its length counts unstripped)."""
    f = profile.annotation_filter
    out = raw
    if f.include_types:
        out = out.where(F.col("subtype").isin(f.include_types))
    if f.exclude_empty:
        out = out.where(F.length("content") >= f.min_content_length)
    return out


def annotations_of(raw: DataFrame, spans: DataFrame, profile: Profile, dims: DataFrame | None = None) -> DataFrame:
    """The annotation records: filtered, classified, excluded ones dropped, with the page's form name and visit and the nearest label as anchor. ``spans`` are those of the page without its annotations."""
    from quillmatch.functions.rules import EXCLUDED, classify
    from quillmatch.functions.style import parsed_style, rotation

    d = profile.style_defaults
    kept = classify(wanted_annotations(raw, profile), profile, "content", "subject", "_c").where(F.col("_c.category") != EXCLUDED)
    placed = nearest_labels(kept, spans, profile)
    style = parsed_style(F.col("da"), F.col("rc"), F.col("stroke"), F.col("border_width"), F.col("border_dashes"), F.col("ap_stream"), d.font, d.font_size, d.fill_color)
    return (
        placed.join(form_names(spans, profile, dims), PAGE, "left")
        .join(page_visits(spans, profile), PAGE, "left")
        .select(
            stable_id(F.col("doc_id"), F.col("page"), F.col("seq"), F.lit("annotation")).alias("id"),
            "doc_id",
            record_seq(F.col("page"), F.col("seq")).alias("seq"),
            "page",
            F.col("seq").alias("page_seq"),
            strip(F.col("content")).alias("content"),
            F.coalesce("subject", F.lit("")).alias("domain"),
            F.col("_c.category").alias("category"),
            F.col("_c.matched_rule").alias("matched_rule"),
            "rect",
            F.col("label").alias("anchor_text"),
            F.col("label_rect").alias("anchor_rect"),
            F.coalesce("form_name", F.lit("")).alias("form_name"),
            F.coalesce("visit", F.lit("")).alias("visit"),
            style.alias("style"),
            rotation(F.col("rotation")).alias("rotation"),
        )
    )
