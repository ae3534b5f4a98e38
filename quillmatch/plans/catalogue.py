"""Queries over the sample tables, one or more for each operator, and the SQL that each must equal.

The inputs of the operators (spans, annotations, fields, match records) are derived from
whole tables by SQL that Spark and DuckDB both read, so both sides start from the same
rows; what is compared is the operator. Rectangles are columns x0..y1 in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions import geometry as g
from quillmatch.functions import rules, style
from quillmatch.functions import text as t
from quillmatch.operators import assignment, layout, matching, output, review, versions
from quillmatch.operators.graph import shared_folder, shuffled, stored
from quillmatch.plans.profile import profile_of, standard_profile
from quillmatch.sources import records
from quillmatch.sources.changes import ChangeLog
from quillmatch.sources.session import Session
from quillmatch.streaming.audit import action_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str, wide: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a shared statement over tables of ``sf_dir``; joins with ``wide`` ones don't broadcast."""
    named = {n: read(spark, sf_dir, n) for n in tables} | {n: shuffled(read(spark, sf_dir, n)) for n in wide}
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("<<", "{").replace(">>", "}"), **named)


def duck(sql: str) -> str:
    return sql.replace("<<", "").replace(">>", "")


def with_rect(df: DataFrame, name: str = "rect", prefix: str = "") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")])).drop(*[prefix + c for c in ("x0", "y0", "x1", "y1")])


def corners(c: Column) -> list[Column]:
    return [c[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]


# ---------------------------------------------------------------- inputs

#: Lines of the documents: explode differs between the two engines, the rest doesn't.
_LINE_COLUMNS = """
SELECT CAST(doc_id AS STRING) AS doc_id, i, line,
       CASE i % 9 WHEN 0 THEN 'DM (Demographics ' || CAST(i AS STRING) || ')' WHEN 1 THEN 'Note: ' || line WHEN 2 THEN line || ' [not submitted]'
                  WHEN 3 THEN 'See page ' || CAST(i AS STRING) WHEN 4 THEN line || chr(10) || 'second' WHEN 5 THEN '' WHEN 6 THEN 'see RelRec' ELSE line END AS content,
       CASE i % 5 WHEN 0 THEN 'sticky note' ELSE 'DM' END AS subject
FROM lines
"""
_SPAN_COLUMNS = """
SELECT CAST(doc_id AS STRING) AS doc_id, CAST(1 + (i - i % 40) / 40 AS INT) AS page, CAST(i % 40 AS BIGINT) AS seq,
       CASE i % 17 WHEN 3 THEN 'DD/MM/YYYY' WHEN 7 THEN 'Yes / No' WHEN 11 THEN 'Name: ____' WHEN 13 THEN 'Page ' || CAST(i AS STRING) || ' of 9'
                   WHEN 15 THEN 'Form:  ' || line WHEN 16 THEN CASE WHEN doc_id % 4 = 0 THEN 'Codelist: ' || line ELSE 'Week ' || CAST(doc_id % 12 AS STRING) END ELSE line END AS text,
       CAST(8 + length(line) % 12 AS DOUBLE) AS font_size, i % 7 = 0 AS bold,
       CAST(50 + 120 * (i % 3) AS DOUBLE) AS x0, CAST(20 * (i % 40) AS DOUBLE) AS y0, CAST(150 + 120 * (i % 3) AS DOUBLE) AS x1, CAST(20 * (i % 40) + 12 AS DOUBLE) AS y1
FROM lines
"""
_DUCK_LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
CONTENTS_SQL = f"{_DUCK_LINES}, contents AS ({_LINE_COLUMNS.replace('STRING', 'VARCHAR')})"
SPANS_SQL = f"{_DUCK_LINES}, spans AS ({_SPAN_COLUMNS.replace('STRING', 'VARCHAR').replace('(i - i % 40) / 40', '(i - i % 40) // 40')})"
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LINE_COLUMNS.replace("FROM lines", "FROM {lines}"), lines=_lines(spark, sf_dir))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rect(spark.sql(_SPAN_COLUMNS.replace("FROM lines", "FROM {lines}"), lines=_lines(spark, sf_dir)))


def dims(s: DataFrame) -> DataFrame:
    return s.select("doc_id", "page").distinct().withColumns({"width": F.lit(PAGE_WIDTH), "height": F.lit(PAGE_HEIGHT)})


ANNOTATIONS_SQL = """
SELECT 'A' || CAST(p_partkey AS STRING) AS id, CAST(p_partkey AS BIGINT) AS seq, CAST(1 + p_size % 5 AS INT) AS page, 'content ' || p_name AS content, 'DM' AS domain,
       CASE WHEN p_partkey % 20 = 0 THEN 'domain_label' WHEN p_partkey % 31 = 0 THEN 'note' ELSE 'sdtm_mapping' END AS category, 'rule' AS matched_rule,
       CASE WHEN p_partkey % 10 = 0 THEN ' ' ELSE p_name END AS anchor_text, p_brand || ' ' || p_type AS form_name, 'Week ' || CAST(p_partkey % 4 AS STRING) AS visit,
       CAST((p_partkey * 37) % 500 AS DOUBLE) AS x0, CAST((p_partkey * 53) % 760 AS DOUBLE) AS y0, CAST((p_partkey * 37) % 500 + 120 AS DOUBLE) AS x1, CAST((p_partkey * 53) % 760 + 14 AS DOUBLE) AS y1,
       CASE WHEN p_partkey % 3 > 0 THEN CAST(50 AS DOUBLE) END AS ax0, CASE WHEN p_partkey % 3 > 0 THEN CAST((p_partkey * 53) % 760 AS DOUBLE) END AS ay0
FROM <<part>>
"""
FIELDS_SQL = """
SELECT 'F' || CAST(p_partkey AS STRING) AS id, CAST(p_partkey AS BIGINT) AS seq, CAST(1 + p_size % 5 AS INT) AS page,
       CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN p_name || 's' ELSE p_name END AS label,
       CASE WHEN p_partkey % 7 = 0 THEN 'Other ' || p_type ELSE lower(p_brand || ' ' || p_type) END AS form_name, 'week ' || CAST(p_partkey % 3 AS STRING) AS visit,
       CAST((p_partkey * 41) % 560 AS DOUBLE) AS x0, CAST((p_partkey * 29) % 760 AS DOUBLE) AS y0, CAST((p_partkey * 41) % 560 + 80 AS DOUBLE) AS x1, CAST((p_partkey * 29) % 760 + 12 AS DOUBLE) AS y1,
       CASE p_partkey % 5 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'date_field' WHEN 2 THEN 'section_header' ELSE 'text_field' END AS field_type,
       CAST(595 AS DOUBLE) AS page_width, CAST(842 AS DOUBLE) AS page_height
FROM <<part>>
"""
MATCHES_SQL = """
SELECT CAST(o_orderkey AS BIGINT) AS seq, 'A' || CAST(o_orderkey AS STRING) AS annotation_id,
       CASE WHEN o_orderkey % 6 < 3 THEN 'F' || CAST(o_custkey AS STRING) END AS field_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'manual' WHEN 3 THEN 'position_only' WHEN 4 THEN 'unmatched' ELSE 'new' END AS match_type,
       CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence, CAST(o_custkey % 400 AS DOUBLE) AS x0, CAST(o_custkey % 700 AS DOUBLE) AS y0, CAST(o_custkey % 400 + 90 AS DOUBLE) AS x1, CAST(o_custkey % 700 + 14 AS DOUBLE) AS y1,
       CAST(CASE WHEN o_orderkey % 6 = 4 THEN 0 ELSE o_custkey % 9 END AS INT) AS target_page,
       CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 're-pairing' ELSE 'pending' END AS status, '' AS user_notes, o_orderkey % 11 = 0 AS placement_adjusted
FROM <<orders>>
"""
A_SQL, F_SQL, M_SQL = (duck(s).replace("STRING", "VARCHAR") for s in (ANNOTATIONS_SQL, FIELDS_SQL, MATCHES_SQL))
AF_SQL = f"a AS ({A_SQL}), f AS ({F_SQL})"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = with_rect(view(spark, sf_dir, ANNOTATIONS_SQL, "part"))
    anchor = F.when(F.col("ax0").isNotNull(), F.array(F.col("ax0"), F.col("ay0"), F.col("ax0") + 100.0, F.col("ay0") + 12.0))
    rgb = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    s = F.struct(F.lit("Arial").alias("font"), F.lit(10.0).alias("font_size"), rgb.alias("text_color"), rgb.alias("border_color"), F.lit(None).cast("array<double>").alias("fill_color"), F.lit(1.0).alias("border_width"), F.lit(None).cast("array<int>").alias("border_dashes"))
    return a.withColumns({"anchor_rect": anchor, "style": s, "rotation": F.lit(0)}).drop("ax0", "ay0")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rect(view(spark, sf_dir, FIELDS_SQL, "part"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rect(view(spark, sf_dir, MATCHES_SQL, "orders"), "target_rect")


def page_sizes(spark: SparkSession, width: float, height: float, pages: int) -> DataFrame:
    return spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page"), F.lit(width).alias("width"), F.lit(height).alias("height"))


# ---------------------------------------------------------------- rules

_CASE = """CASE WHEN length(trim(content)) <= 0 OR lower(subject) = 'sticky note' THEN '_exclude' WHEN contains(lower(content), '[not submitted]') THEN 'not_submitted'
 WHEN regexp_matches(trim(content), '^([A-Z]{2,4}) \\(([A-Za-z0-9 ,''-]+)\\)$', 'i') THEN 'domain_label'
 WHEN regexp_matches(content, '\\bSee\\s+(page|pg\\.?)\\s*\\d+|\\bRefer\\s+to\\b', 'i') THEN 'sdtm_mapping'
 WHEN contains(trim(content, ' ' || chr(9) || chr(10) || chr(13)), chr(10)) OR contains(content, chr(13)) THEN 'note' WHEN starts_with(lower(trim(content)), 'note:') THEN 'note' WHEN contains(lower(content), 'relrec') THEN 'note' ELSE 'sdtm_mapping' END"""


@query(
    "q_classify_counts",
    f"""WITH {CONTENTS_SQL}, c AS (SELECT {_CASE} AS category FROM contents), k AS (SELECT unnest(['domain_label', 'sdtm_mapping', 'not_submitted', 'note', 'cross_reference']) AS category)
SELECT k.category, count(c.category) AS n FROM k LEFT JOIN c USING (category) GROUP BY 1""",
)
def q_classify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rules.classify(contents(spark, sf_dir), standard_profile(), "content", "subject", "c").select("c.*")
    return review.counts_of(made.where(F.col("category") != rules.EXCLUDED), "category", review.CATEGORIES)


_CHAT = {
    "meta": {"name": "chat"},
    "domain_codes": ["La", "The", "Le", "El"],
    "classification_rules": [
        {"conditions": {"subject_is": "SYSTEM"}, "category": "_exclude"},
        {"conditions": {"regex": r"^(\w+)\b", "domain_in": "domain_codes", "min_length": 20}, "category": "domain_label"},
        {"conditions": {"domain_in": "domain_codes"}, "category": "never"},
        {"conditions": {"subject_is": "user", "max_length": 200}, "category": "note"},
        {"conditions": {"contains": ", and", "starts_with": "th"}, "category": "cross_reference"},
    ],
}


@query(
    "q_classify_chat_subject",
    """SELECT CASE WHEN role = 'system' THEN '_exclude' WHEN regexp_extract(trim(text), '^([A-Za-z]+)([^A-Za-zÀ-ÿ]|$)', 1) IN ('La', 'The', 'Le', 'El') AND length(trim(text)) >= 20 THEN 'domain_label'
 WHEN role = 'user' AND length(trim(text)) <= 200 THEN 'note' WHEN contains(lower(text), ', and') AND starts_with(lower(trim(text)), 'th') THEN 'cross_reference' ELSE 'sdtm_mapping' END AS category,
 count(*) AS n FROM conversations GROUP BY 1""",
)
def q_classify_chat_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rules.classified(profile_of(_CHAT), F.col("text"), F.col("role"))
    return read(spark, sf_dir, "conversations").groupBy(c["category"].alias("category")).agg(F.count("*").alias("n"))


@query("q_annotation_filter", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND length(text) >= 100")
def q_annotation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile_of({"meta": {"name": "f"}, "domain_codes": [], "classification_rules": [], "annotation_filter": {"include_types": ["user", "assistant"], "min_content_length": 100}})
    return layout.wanted_annotations(read(spark, sf_dir, "conversations").withColumnsRenamed({"role": "subtype", "text": "content"}), p).select("conv_id", "turn")


_VISITS = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'at week  ' || CAST(o_custkey AS STRING) || ' done' WHEN 1 THEN 'SCREENING day' WHEN 2 THEN 'the baseline' WHEN 3 THEN 'early termination' WHEN 4 THEN 'runningrecord' ELSE o_orderpriority END AS said FROM <<orders>>"


@query(
    "q_visit_extract",
    f"""SELECT o_orderkey, CASE WHEN regexp_matches(said, 'Screen(ing)?', 'i') THEN 'Screening' WHEN regexp_matches(said, 'Baseline', 'i') THEN 'Baseline'
 WHEN regexp_matches(said, 'Week\\s*(\\d+)', 'i') THEN 'Week ' || regexp_extract(said, 'Week\\s*(\\d+)', 1, 'i') WHEN regexp_matches(said, 'End of Study|Termination', 'i') THEN 'End of Study'
 WHEN regexp_matches(said, 'Running\\s*Records?', 'i') THEN 'Running Records' ELSE '' END AS visit FROM ({duck(_VISITS).replace('STRING', 'VARCHAR')})""",
)
def q_visit_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _VISITS, "orders").select("o_orderkey", rules.visit(standard_profile().visit_rules, F.col("said")).alias("visit"))


# ---------------------------------------------------------------- layout

_EXCLUDE = "regexp_matches(t, '^CDISC$|^Study\\b|^Design\\s*:|^Codelist\\s*:|^Assessment Date|\\bPage\\s+\\d+\\s+of\\s+\\d+\\b', 'i')"
_STRIPPED = "s AS (SELECT *, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS t FROM spans)"


@query("q_page_text", f"WITH {SPANS_SQL} SELECT doc_id, page, md5(string_agg(text, ' ' ORDER BY seq)) AS text_md5 FROM spans GROUP BY 1, 2")
def q_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_text(spans(spark, sf_dir)).select("doc_id", "page", F.md5("page_text").alias("text_md5"))


@query(
    "q_page_visits",
    f"""WITH {SPANS_SQL}, p AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY seq) AS said FROM spans GROUP BY 1, 2)
SELECT doc_id, page, CASE WHEN regexp_matches(said, 'Screen(ing)?', 'i') THEN 'Screening' WHEN regexp_matches(said, 'Baseline', 'i') THEN 'Baseline' WHEN regexp_matches(said, 'Week\\s*(\\d+)', 'i') THEN 'Week ' || regexp_extract(said, 'Week\\s*(\\d+)', 1, 'i')
 WHEN regexp_matches(said, 'End of Study|Termination', 'i') THEN 'End of Study' WHEN regexp_matches(said, 'Running\\s*Records?', 'i') THEN 'Running Records' ELSE '' END AS visit FROM p""",
)
def q_page_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_visits(spans(spark, sf_dir), standard_profile())


@query(
    "q_form_name_bold",
    f"""WITH {SPANS_SQL}, {_STRIPPED}, r AS (SELECT doc_id, page, t, row_number() OVER (PARTITION BY doc_id, page ORDER BY NOT bold, -font_size, y0, seq) AS k FROM s
 WHERE t <> '' AND NOT {_EXCLUDE} AND font_size >= 6.5 AND y0 <= 0.35 * 842)
SELECT p.doc_id, p.page, coalesce(t, '') AS form_name FROM (SELECT DISTINCT doc_id, page FROM spans) p LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON r.doc_id = p.doc_id AND r.page = p.page""",
)
def q_form_name_bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return layout.form_names(s, standard_profile(), dims(s))


def _profile_with(**rules_: object) -> object:
    base = standard_profile()
    return profile_of({"meta": {"name": "x"}, "domain_codes": [], "classification_rules": [], "form_name_rules": {"exclude_patterns": base.form_name_rules.exclude_patterns, "min_font_size": 6.5} | rules_})


@query(
    "q_form_name_topleft",
    f"""WITH {SPANS_SQL}, {_STRIPPED}, m AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS lx FROM s), r AS (SELECT doc_id, page, t, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, seq) AS k FROM m
 WHERE x0 <= lx + 50 AND t <> '' AND NOT {_EXCLUDE})
SELECT p.doc_id, p.page, coalesce(t, '') AS form_name FROM (SELECT DISTINCT doc_id, page FROM spans) p LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON r.doc_id = p.doc_id AND r.page = p.page""",
)
def q_form_name_topleft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.form_names(spans(spark, sf_dir), _profile_with(strategy="top_left_block"))


@query(
    "q_label_prefix",
    f"""WITH {SPANS_SQL}, {_STRIPPED}, g AS (SELECT doc_id, page, arg_min(trim(regexp_extract(t, '^Form\\s*:\\s*(.+)$', 1, 'i')), seq) AS v FROM s WHERE regexp_matches(t, '^Form\\s*:\\s*(.+)$', 'i') GROUP BY 1, 2),
r AS (SELECT doc_id, page, arg_min(t, {{'a': NOT bold, 'b': -font_size, 'c': y0, 'd': seq}}) AS v FROM s WHERE t <> '' AND NOT {_EXCLUDE} AND font_size >= 6.5 GROUP BY 1, 2)
SELECT p.doc_id, p.page, coalesce(g.v, r.v, '') AS form_name FROM (SELECT DISTINCT doc_id, page FROM spans) p LEFT JOIN g ON g.doc_id = p.doc_id AND g.page = p.page LEFT JOIN r ON r.doc_id = p.doc_id AND r.page = p.page""",
)
def q_label_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.form_names(spans(spark, sf_dir), _profile_with(label_prefix="Form:"))


_MARKER = """CASE WHEN regexp_matches(text, '^\\s*((MM|DD|MON|YYYY|YY)[\\s/\\-]*)+\\s*$|\\b\\d{1,2}/\\d{1,2}/\\d{2,4}\\b', 'i') THEN 'date_field'
 WHEN regexp_matches(text, '^\\s*(yes|no|y\\s*/\\s*n|yes\\s*/\\s*no)\\s*$|[□☐☑✓✗]', 'i') THEN 'checkbox' WHEN regexp_matches(text, '_{3,}') THEN 'text_field' ELSE 'none' END"""


@query("q_marker_types", f"WITH {SPANS_SQL} SELECT {_MARKER} AS field_type, count(*) AS n FROM spans GROUP BY 1")
def q_marker_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).groupBy(F.coalesce(layout.marker_type(F.col("text")), F.lit("none")).alias("field_type")).agg(F.count("*").alias("n"))


_NO_CODELISTS = "kept AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans c WHERE c.doc_id = s.doc_id AND c.page = s.page AND c.y0 <= 0.35 * 842 AND regexp_matches(c.text, '^Codelist\\b', 'i')))"


@query("q_codelist_drop", f"WITH {SPANS_SQL}, {_NO_CODELISTS} SELECT doc_id, page, count(*) AS n FROM kept GROUP BY 1, 2")
def q_codelist_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return layout.without_codelists(s, dims(s), standard_profile()).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


@query(
    "q_nearest_label",
    f"""WITH {SPANS_SQL}, {_STRIPPED}, k AS (SELECT *, {_MARKER} AS ft FROM s), b AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS lx FROM k WHERE ft = 'none'),
c AS (SELECT m.doc_id, m.page, m.seq, b.t, row_number() OVER (PARTITION BY m.doc_id, m.page, m.seq ORDER BY greatest(0.0, greatest(m.y0, b.y0) - least(m.y1, b.y1)), abs((b.y0 + b.y1) / 2 - m.y0), b.seq) AS r
 FROM (SELECT * FROM k WHERE ft <> 'none') m JOIN (SELECT * FROM b WHERE x0 <= lx + 50 AND t <> '' AND NOT {_EXCLUDE}) b ON b.doc_id = m.doc_id AND b.page = m.page WHERE greatest(0.0, greatest(m.y0, b.y0) - least(m.y1, b.y1)) <= 30)
SELECT k.doc_id, k.page, k.seq, coalesce(c.t, '') AS label FROM k LEFT JOIN (SELECT * FROM c WHERE r = 1) c ON c.doc_id = k.doc_id AND c.page = k.page AND c.seq = k.seq WHERE k.ft <> 'none'""",
)
def q_nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).withColumn("ft", layout.marker_type(F.col("text")))
    return layout.nearest_labels(s.where("ft is not null"), s.where("ft is null"), standard_profile(), layout.LABEL_GAP).select("doc_id", "page", "seq", "label")


_RECTS = "SELECT doc_id, page, x0 - 20 AS x0, y0 - 4 AS y0, x0 + 40 AS x1, y0 + 8 AS y1 FROM spans WHERE seq % 6 = 0"


@query(
    "q_overlap_anti",
    f"""WITH {SPANS_SQL}, r AS ({_RECTS}) SELECT doc_id, page, seq FROM spans s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND r.page = s.page
 AND greatest(0.0, least(s.x1, r.x1) - greatest(s.x0, r.x0)) * greatest(0.0, least(s.y1, r.y1) - greatest(s.y0, r.y0)) / ((s.x1 - s.x0) * (s.y1 - s.y0)) >= 0.3)""",
)
def q_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    r = s.where("seq % 6 = 0").select("doc_id", "page", F.array(F.col("rect")[0] - 20, F.col("rect")[1] - 4, F.col("rect")[0] + 40, F.col("rect")[1] + 8).alias("rect"))
    return layout.without_annotated(s, r).select("doc_id", "page", "seq")


@query(
    "q_fields",
    f"""WITH {SPANS_SQL}, {_NO_CODELISTS}, s AS (SELECT *, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS t, {_MARKER} AS ft FROM kept), b AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS lx FROM s WHERE ft = 'none'),
c AS (SELECT m.doc_id, m.page, m.seq, b.t, row_number() OVER (PARTITION BY m.doc_id, m.page, m.seq ORDER BY greatest(0.0, greatest(m.y0, b.y0) - least(m.y1, b.y1)), abs((b.y0 + b.y1) / 2 - m.y0), b.seq) AS r
 FROM (SELECT * FROM s WHERE ft <> 'none') m JOIN (SELECT * FROM b WHERE x0 <= lx + 50 AND t <> '' AND NOT {_EXCLUDE}) b ON b.doc_id = m.doc_id AND b.page = m.page WHERE greatest(0.0, greatest(m.y0, b.y0) - least(m.y1, b.y1)) <= 30),
rec AS (SELECT doc_id, page, seq, x0, y0, t AS label, 'section_header' AS field_type, 0 AS p FROM s WHERE ft = 'none' AND (bold OR font_size >= 6.5) AND NOT {_EXCLUDE}
 UNION ALL SELECT s.doc_id, s.page, s.seq, s.x0, s.y0, coalesce(c.t, s.text), s.ft, 1 FROM s LEFT JOIN (SELECT * FROM c WHERE r = 1) c ON c.doc_id = s.doc_id AND c.page = s.page AND c.seq = s.seq WHERE s.ft <> 'none'),
n AS (SELECT doc_id, page, arg_min(label, {{'a': y0, 'b': x0, 'c': p, 'd': seq}}) AS form_name FROM (SELECT *, label AS t FROM rec) WHERE NOT {_EXCLUDE} GROUP BY 1, 2)
SELECT rec.doc_id, rec.page, field_type, label, coalesce(form_name, '') AS form_name, x0, y0 FROM rec LEFT JOIN n ON n.doc_id = rec.doc_id AND n.page = rec.page""",
)
def q_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    return layout.fields_of(s, dims(s), standard_profile()).select("doc_id", "page", "field_type", "label", "form_name", *corners(F.col("rect"))[:2])


_NOTE_COLUMNS = """
SELECT doc_id, CAST(1 + (i - i % 40) / 40 AS INT) AS page, CAST(i % 40 AS BIGINT) AS seq, 'FreeText' AS subtype, content, subject,
       CAST(10 + 30 * (i % 5) AS DOUBLE) AS x0, CAST(20 * (i % 40) + 5 AS DOUBLE) AS y0, CAST(70 + 30 * (i % 5) AS DOUBLE) AS x1, CAST(20 * (i % 40) + 15 AS DOUBLE) AS y1
FROM <<contents>> WHERE i % 8 = 3
"""


def _raw_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = with_rect(spark.sql(_NOTE_COLUMNS.replace("<<contents>>", "{contents}"), contents=contents(spark, sf_dir)))
    none = F.lit(None)
    return notes.withColumns({"rotation": F.lit("0"), "da": F.lit(""), "rc": F.lit(""), "stroke": none.cast("array<double>"), "border_width": none.cast("double"), "border_dashes": none.cast("array<int>"), "ap_stream": F.lit("")})


@query(
    "q_annotations",
    f"""WITH {SPANS_SQL}, {_STRIPPED}, contents AS ({_LINE_COLUMNS.replace('STRING', 'VARCHAR')}), notes AS ({duck(_NOTE_COLUMNS).replace('(i - i % 40) / 40', '(i - i % 40) // 40')}),
k AS (SELECT * FROM (SELECT *, {_CASE} AS category FROM notes WHERE length(content) > 0) WHERE category <> '_exclude'), b AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS lx FROM s),
c AS (SELECT m.doc_id, m.page, m.seq, b.t, b.x0 AS bx, row_number() OVER (PARTITION BY m.doc_id, m.page, m.seq ORDER BY greatest(0.0, greatest(m.y0, b.y0) - least(m.y1, b.y1)), abs((b.y0 + b.y1) / 2 - m.y0), b.seq) AS r
 FROM k m JOIN (SELECT * FROM b WHERE x0 <= lx + 50 AND t <> '' AND NOT {_EXCLUDE}) b ON b.doc_id = m.doc_id AND b.page = m.page),
n AS (SELECT doc_id, page, t, row_number() OVER (PARTITION BY doc_id, page ORDER BY NOT bold, -font_size, y0, seq) AS r FROM s WHERE t <> '' AND NOT {_EXCLUDE} AND font_size >= 6.5 AND y0 <= 0.35 * 842),
p AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY seq) AS said FROM spans GROUP BY 1, 2),
v AS (SELECT doc_id, page, CASE WHEN regexp_matches(said, 'Screen(ing)?', 'i') THEN 'Screening' WHEN regexp_matches(said, 'Baseline', 'i') THEN 'Baseline' WHEN regexp_matches(said, 'Week\\s*(\\d+)', 'i') THEN 'Week ' || regexp_extract(said, 'Week\\s*(\\d+)', 1, 'i')
 WHEN regexp_matches(said, 'End of Study|Termination', 'i') THEN 'End of Study' WHEN regexp_matches(said, 'Running\\s*Records?', 'i') THEN 'Running Records' ELSE '' END AS visit FROM p)
SELECT k.doc_id, k.page, k.seq, k.subject AS domain, category, coalesce(c.t, '') AS anchor_text, c.bx AS anchor_x0, coalesce(n.t, '') AS form_name, coalesce(v.visit, '') AS visit, k.x0 FROM k LEFT JOIN (SELECT * FROM c WHERE r = 1) c USING (doc_id, page, seq)
 LEFT JOIN (SELECT * FROM n WHERE r = 1) n USING (doc_id, page) LEFT JOIN v USING (doc_id, page)""",
)
def q_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, raw = spans(spark, sf_dir), _raw_notes(spark, sf_dir)
    out = layout.annotations_of(raw, s, standard_profile(), dims(s))
    return out.select("doc_id", "page", F.col("page_seq").alias("seq"), "domain", "category", "anchor_text", F.col("anchor_rect")[0].alias("anchor_x0"), "form_name", "visit", F.col("rect")[0].alias("x0"))


# ---------------------------------------------------------------- ranks and rows

_LINEITEM_FORMS = "SELECT l_orderkey, l_linenumber, p_brand || ' ' || p_type AS form_name, CAST(l_suppkey % 23 AS INT) AS page FROM <<lineitem>> JOIN <<part>> ON l_partkey = p_partkey"


@query("q_page_rank", f"SELECT DISTINCT form, page, rank FROM (SELECT lower(form_name) AS form, page, CAST(dense_rank() OVER (PARTITION BY lower(form_name) ORDER BY page) AS INT) AS rank FROM ({duck(_LINEITEM_FORMS)}))")
def q_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.page_ranks(view(spark, sf_dir, _LINEITEM_FORMS, "lineitem", "part")).drop("pair")


_EVENT_ROWS = "SELECT user_id, CAST(event_id % 3 AS INT) AS page, value AS y0, event_id AS seq FROM <<events>>"


@query(
    "q_row_index",
    f"""WITH e AS ({duck(_EVENT_ROWS)}), d AS (SELECT *, coalesce(page <> lag(page) OVER w OR abs(y0 - lag(y0) OVER w) > 5, false) AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY page, y0, seq))
SELECT user_id, seq, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY page, y0, seq ROWS UNBOUNDED PRECEDING) AS INT) AS row FROM d""",
)
def q_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.with_rows(view(spark, sf_dir, _EVENT_ROWS, "events"), ["user_id"]).select("user_id", "seq", "row")


_KEPT = """s AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY page, y0, seq) AS k FROM {source}),
z AS (SELECT *, true AS kept, page AS lp, y0 AS ly FROM s WHERE k = 1 UNION ALL
 SELECT s.*, s.page <> z.lp OR abs(s.y0 - z.ly) > 5, CASE WHEN s.page <> z.lp OR abs(s.y0 - z.ly) > 5 THEN s.page ELSE z.lp END, CASE WHEN s.page <> z.lp OR abs(s.y0 - z.ly) > 5 THEN s.y0 ELSE z.ly END
 FROM z JOIN s ON {join} AND s.k = z.k + 1)"""


@query("q_keep_last_dedupe", f"WITH RECURSIVE e AS ({duck(_EVENT_ROWS)}), {_KEPT.format(key='user_id', source='e', join='s.user_id = z.user_id')} SELECT user_id, seq FROM z WHERE kept")
def q_keep_last_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.kept_rows(view(spark, sf_dir, _EVENT_ROWS, "events"), ["user_id"]).select("user_id", "seq")


# ---------------------------------------------------------------- matching

_EXACT = f"""{AF_SQL}, fk0 AS (SELECT lower(trim(form_name)) AS form, lower(trim(label)) AS lab, page, y0, seq FROM f), {_KEPT.format(key='form, lab', source='fk0', join='s.form = z.form AND s.lab = z.lab')},
kf AS (SELECT form, lab, page, seq, row_number() OVER (PARTITION BY form, lab ORDER BY k) - 1 AS pos FROM z WHERE kept),
ra AS (SELECT DISTINCT lower(trim(form_name)) AS form, page, dense_rank() OVER (PARTITION BY lower(trim(form_name)) ORDER BY page) AS rank FROM a),
rf AS (SELECT DISTINCT lower(trim(form_name)) AS form, page, dense_rank() OVER (PARTITION BY lower(trim(form_name)) ORDER BY page) AS rank FROM f),
ak AS (SELECT *, max(page) OVER (PARTITION BY form, lab) > min(page) OVER (PARTITION BY form, lab) AS many FROM (SELECT lower(trim(form_name)) AS form, lower(trim(anchor_text)) AS lab, page, y0, seq FROM a WHERE trim(anchor_text) <> '')),
ar AS (SELECT ak.*, CASE WHEN many THEN rank ELSE 0 END AS rank FROM ak JOIN ra USING (form, page)),
an AS (SELECT *, coalesce(page <> lag(page) OVER w OR abs(y0 - lag(y0) OVER w) > 5, false) AS new FROM ar WINDOW w AS (PARTITION BY form, lab, rank ORDER BY page, y0, seq)),
ai AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY form, lab, rank ORDER BY page, y0, seq ROWS UNBOUNDED PRECEDING) AS ridx FROM an),
fr AS (SELECT form, lab, 0 AS rank, seq, pos FROM kf UNION ALL SELECT form, lab, rank, seq, row_number() OVER (PARTITION BY form, lab, rank ORDER BY pos) - 1 FROM kf JOIN rf USING (form, page)),
fn AS (SELECT form, lab, rank, count(*) AS n FROM fr GROUP BY ALL),
xp AS (SELECT ai.seq AS aseq, fr.seq AS fseq FROM ai JOIN fn USING (form, lab, rank) JOIN fr ON fr.form = ai.form AND fr.lab = ai.lab AND fr.rank = ai.rank AND fr.pos = least(ai.ridx, fn.n - 1))"""


@query("q_exact_match", f"WITH RECURSIVE {_EXACT} SELECT aseq, fseq FROM xp")
def q_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.exact_pairs(annotations(spark, sf_dir), fields(spark, sf_dir)).drop("pair")


_RAW = """raw AS (SELECT a.seq AS aseq, f.id AS fid, f.page, lower(trim(f.label)) AS lab,
 CASE WHEN ax0 IS NOT NULL THEN f.x0 + (a.x0 - ax0) ELSE f.x0 END AS x0, CASE WHEN ax0 IS NOT NULL THEN f.y0 + (a.y0 - ay0) ELSE f.y0 END AS y0,
 CASE WHEN ax0 IS NOT NULL THEN f.x0 + (a.x0 - ax0) + (a.x1 - a.x0) ELSE f.x1 END AS x1, CASE WHEN ax0 IS NOT NULL THEN f.y0 + (a.y0 - ay0) + (a.y1 - a.y0) ELSE f.y1 END AS y1
 FROM {pairs} p JOIN a ON a.seq = p.aseq JOIN f ON f.seq = p.fseq),
gd AS (SELECT raw.aseq, raw.fid, raw.page, raw.x0 < 0 OR raw.y0 < 0 OR raw.x1 > 595 OR raw.y1 > 842 AS off, raw.x0, raw.y0, raw.x1, raw.y1, arg_min({{'x0': q.x0, 'y0': q.y0, 'x1': q.x1, 'y1': q.y1}}, {{'a': q.x0, 'b': q.seq}}) AS peer, count(q.id) AS peers
 FROM raw LEFT JOIN f q ON q.page = raw.page AND lower(trim(q.label)) = raw.lab AND q.id <> raw.fid GROUP BY ALL),
gp AS (SELECT aseq, fid, page, off AND peers > 0 AS moved, CASE WHEN off AND peers > 0 THEN peer.x0 ELSE x0 END AS x0, CASE WHEN off AND peers > 0 THEN peer.y0 ELSE y0 END AS y0,
 CASE WHEN off AND peers > 0 THEN peer.x1 ELSE x1 END AS x1, CASE WHEN off AND peers > 0 THEN peer.y1 ELSE y1 END AS y1 FROM gd),
gc AS (SELECT aseq, fid, page, moved OR x0 <> greatest(0, least(x0, 595)) OR y0 <> greatest(0, least(y0, 842)) OR x1 <> greatest(0, least(x1, 595)) OR y1 <> greatest(0, least(y1, 842)) AS placement_adjusted,
 greatest(0, least(x0, 595)) AS x0, greatest(0, least(y0, 842)) AS y0, greatest(0, least(x1, 595)) AS x1, greatest(0, least(y1, 842)) AS y1 FROM gp)"""


@query("q_placement_guard", f"WITH RECURSIVE {_EXACT}, {_RAW.format(pairs='xp')} SELECT aseq, fid AS field_id, page AS target_page, placement_adjusted, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM gc")
def q_placement_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, f = annotations(spark, sf_dir), fields(spark, sf_dir)
    out = matching.linked(matching.exact_pairs(a, f), a, f, "exact", F.lit(1.0), "approved")
    return out.select(F.col("seq").alias("aseq"), "field_id", "target_page", "placement_adjusted", *corners(F.col("target_rect")))


_LCS = """lcs AS (SELECT x, y, 0 AS i, list_transform(range(length(y) + 1), lambda j: 0) AS row FROM texts UNION ALL
 SELECT x, y, i + 1, list_transform(range(length(y) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k: CASE WHEN k = 0 THEN 0 ELSE greatest(row[k + 1], row[k] + CASE WHEN x[i + 1] = y[k] THEN 1 ELSE 0 END) END))) FROM lcs WHERE i < length(x)),
sim AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN CAST(100 AS DOUBLE) ELSE CAST(200 AS DOUBLE) * row[length(y) + 1] / (length(x) + length(y)) END AS raw FROM lcs WHERE i = length(x))"""
_SORTED = "list_aggregate(list_sort(string_split(trim({0}), ' ')), 'string_agg', ' ')"
_BONUS = "CASE WHEN {0} = '' OR {1} = '' THEN CAST(0 AS DOUBLE) WHEN lower({0}) = lower({1}) THEN CAST(5 AS DOUBLE) WHEN contains(lower({0}), lower({1})) OR contains(lower({1}), lower({0})) THEN CAST(2.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


@query(
    "q_token_sort",
    f"WITH RECURSIVE {AF_SQL}, texts AS (SELECT DISTINCT {_SORTED.format('p.p_name')} AS x, {_SORTED.format('f.label')} AS y FROM (SELECT DISTINCT p_name FROM part) p, (SELECT DISTINCT label FROM f) f), {_LCS} SELECT x, y, raw FROM sim",
)
def q_token_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both sides are the few distinct names, and the list of all their pairs is what is asked for.
    x = read(spark, sf_dir, "part").select(t.token_sorted(F.col("p_name")).alias("x")).distinct()
    y = fields(spark, sf_dir).select(t.token_sorted(F.col("label")).alias("y")).distinct()
    return x.crossJoin(y).withColumn("raw", t.indel_ratio(F.col("x"), F.col("y")))


@query("q_visit_boost", f"WITH v AS (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, upper(substr(n_name, 1, n_nationkey % 4)) FROM nation UNION ALL SELECT n_name, upper(n_name) FROM nation) SELECT a, b, {_BONUS.format('a', 'b')} / 5 AS visit FROM v")
def q_visit_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    pairs = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    pairs = pairs.union(n.select("n_name", F.upper(F.substring("n_name", F.lit(1), (F.col("n_nationkey") % 4).cast("int"))))).union(n.select("n_name", F.upper("n_name")))
    return pairs.withColumn("visit", t.visit_match(F.col("a"), F.col("b")))


_SAME = f"""{AF_SQL}, ra AS (SELECT DISTINCT lower(form_name) AS form, page, dense_rank() OVER (PARTITION BY lower(form_name) ORDER BY page) AS rank FROM a),
rf AS (SELECT DISTINCT lower(form_name) AS form, page, dense_rank() OVER (PARTITION BY lower(form_name) ORDER BY page) AS rank FROM f),
pr AS (SELECT a.seq AS aseq, f.seq AS fseq, {_SORTED.format('a.anchor_text')} AS x, {_SORTED.format('f.label')} AS y, {_BONUS.format('a.visit', 'f.visit')} AS bonus FROM a JOIN ra ON ra.form = lower(a.form_name) AND ra.page = a.page
 JOIN rf ON rf.form = ra.form AND rf.rank = ra.rank JOIN f ON lower(f.form_name) = rf.form AND f.page = rf.page WHERE trim(a.anchor_text) <> ''), texts AS (SELECT DISTINCT x, y FROM pr), {_LCS}"""


@query("q_fuzzy_edges_same", f"WITH RECURSIVE {_SAME} SELECT aseq, fseq, raw + bonus AS score FROM pr JOIN sim USING (x, y) WHERE raw + bonus >= 80")
def q_fuzzy_edges_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, f = annotations(spark, sf_dir), fields(spark, sf_dir)
    return matching.same_form_edges(a, f, a, 80.0, 5.0).select("aseq", "fseq", "score")


_CROSS = f"""{AF_SQL}, aa AS (SELECT *, {_SORTED.format('anchor_text')} AS x FROM a WHERE trim(anchor_text) <> ''), ff AS (SELECT *, {_SORTED.format('label')} AS y FROM f),
texts AS (SELECT x, y FROM (SELECT DISTINCT x FROM aa), (SELECT DISTINCT y FROM ff)), {_LCS},
ed AS (SELECT aa.seq AS aseq, ff.seq AS fseq, raw + {_BONUS.format('aa.visit', 'ff.visit')} AS score FROM aa JOIN sim USING (x) JOIN ff USING (y) WHERE raw >= 85)"""


@query("q_fuzzy_edges_cross", f"WITH RECURSIVE {_CROSS} SELECT aseq, count(*) AS n, min(fseq) AS least, max(score) AS best FROM ed WHERE score >= 90 GROUP BY 1")
def q_fuzzy_edges_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = matching.cross_form_edges(annotations(spark, sf_dir), fields(spark, sf_dir), 90.0, 5.0)
    return e.groupBy("aseq").agg(F.count("*").alias("n"), F.min("fseq").alias("least"), F.max("score").alias("best"))


def _picks(e: str, o: str, w: str) -> str:
    """Greedy pairs (fseq null where none is free) of edges ``e`` as ``w``."""
    return f"""{o} AS (SELECT g, aseq, row_number() OVER (PARTITION BY g ORDER BY aseq) AS k, list({{'f': fseq, 's': score}} ORDER BY score DESC, fseq) AS c FROM {e} GROUP BY g, aseq),
{w} AS (SELECT g, k, aseq, c[1].f AS fseq, c[1].s AS score, [c[1].f] AS used FROM {o} WHERE k = 1 UNION ALL
 SELECT {o}.g, {o}.k, {o}.aseq, h.f, h.s, CASE WHEN h.f IS NULL THEN {w}.used ELSE list_append({w}.used, h.f) END FROM {w} JOIN {o} ON {o}.g = {w}.g AND {o}.k = {w}.k + 1, LATERAL (SELECT list_filter({o}.c, lambda z: NOT list_contains({w}.used, z.f))[1] AS h) q)"""


_GREEDY = """e AS (SELECT DISTINCT pr.aseq, pr.fseq, raw + bonus AS score, lower(a.form_name) || '#' || ra.rank AS g FROM pr JOIN sim USING (x, y) JOIN a ON a.seq = pr.aseq JOIN ra ON ra.form = lower(a.form_name) AND ra.page = a.page WHERE raw + bonus >= 80),
""" + _picks("e", "o", "w")


@query("q_assign_greedy", f"WITH RECURSIVE {_SAME}, {_GREEDY} SELECT aseq, fseq, score FROM w WHERE fseq IS NOT NULL")
def q_assign_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, f = annotations(spark, sf_dir), fields(spark, sf_dir)
    return assignment.assigned(matching.same_form_edges(a, f, a, 80.0, 5.0), "greedy").drop("pair")


@query("q_assign_optimal")
def q_assign_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, f = annotations(spark, sf_dir), fields(spark, sf_dir)
    return assignment.assigned(matching.same_form_edges(a, f, a, 80.0, 5.0), "optimal").drop("pair")


_POSITION = f"""{AF_SQL}, k AS (SELECT DISTINCT lower(trim(form_name)) AS form FROM f), p AS (SELECT a.*, category = 'domain_label' AS dl, k.form IS NOT NULL AS known, page <= 3 AS sized FROM a LEFT JOIN k ON k.form = lower(trim(a.form_name))),
q AS (SELECT *, CASE WHEN sized THEN CAST(612 AS DOUBLE) WHEN dl THEN 0 ELSE CAST(595 AS DOUBLE) END AS tw, CASE WHEN sized THEN CAST(792 AS DOUBLE) WHEN dl THEN 0 ELSE CAST(842 AS DOUBLE) END AS th FROM p),
s AS (SELECT *, CASE WHEN dl OR NOT known THEN x0 ELSE x0 * (tw / 595) END AS sx0, CASE WHEN dl OR NOT known THEN y0 ELSE y0 * (th / 842) END AS sy0, CASE WHEN dl OR NOT known THEN x1 ELSE x1 * (tw / 595) END AS sx1, CASE WHEN dl OR NOT known THEN y1 ELSE y1 * (th / 842) END AS sy1, (dl OR known) AND tw > 0 AND th > 0 AS clamp FROM q),
c AS (SELECT *, CASE WHEN clamp THEN greatest(0, least(sx0, tw)) ELSE sx0 END AS cx0, CASE WHEN clamp THEN greatest(0, least(sy0, th)) ELSE sy0 END AS cy0, CASE WHEN clamp THEN greatest(0, least(sx1, tw)) ELSE sx1 END AS cx1, CASE WHEN clamp THEN greatest(0, least(sy1, th)) ELSE sy1 END AS cy1 FROM s)"""


@query(
    "q_position_pass",
    f"""WITH {_POSITION} SELECT seq, CASE WHEN dl OR known THEN 'position_only' ELSE 'unmatched' END AS match_type, CASE WHEN dl OR known THEN page ELSE 0 END AS target_page, CAST(CASE WHEN dl OR known THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence,
 cx0 <> sx0 OR cy0 <> sy0 OR cx1 <> sx1 OR cy1 <> sy1 AS placement_adjusted, cx0 AS x0, cy0 AS y0, cx1 AS x1, cy1 AS y1 FROM c""",
)
def q_position_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.positioned(annotations(spark, sf_dir), fields(spark, sf_dir), page_sizes(spark, 595.0, 842.0, 3), page_sizes(spark, 612.0, 792.0, 3), 0.5)
    return out.select("seq", "match_type", "target_page", "confidence", "placement_adjusted", *corners(F.col("target_rect")))


def cascade(spark: SparkSession, sf_dir: str, mode: str = "greedy") -> DataFrame:
    return matching.match_annotations(annotations(spark, sf_dir), fields(spark, sf_dir), page_sizes(spark, 595.0, 842.0, 5), page_sizes(spark, 612.0, 792.0, 5), standard_profile().matching_config, mode)


_PLACED = """pk AS (SELECT DISTINCT lower(trim(form_name)) AS form FROM f), pp AS (SELECT r3.*, category = 'domain_label' AS dl, pk.form IS NOT NULL AS known FROM r3 LEFT JOIN pk ON pk.form = lower(trim(r3.form_name))),
pq AS (SELECT *, CAST(612 AS DOUBLE) AS tw, CAST(792 AS DOUBLE) AS th FROM pp),
ps AS (SELECT *, CASE WHEN dl OR NOT known THEN x0 ELSE x0 * (tw / 595) END AS sx0, CASE WHEN dl OR NOT known THEN y0 ELSE y0 * (th / 842) END AS sy0, CASE WHEN dl OR NOT known THEN x1 ELSE x1 * (tw / 595) END AS sx1, CASE WHEN dl OR NOT known THEN y1 ELSE y1 * (th / 842) END AS sy1 FROM pq),
pc AS (SELECT *, CASE WHEN dl OR known THEN greatest(0, least(sx0, tw)) ELSE sx0 END AS cx0, CASE WHEN dl OR known THEN greatest(0, least(sy0, th)) ELSE sy0 END AS cy0, CASE WHEN dl OR known THEN greatest(0, least(sx1, tw)) ELSE sx1 END AS cx1, CASE WHEN dl OR known THEN greatest(0, least(sy1, th)) ELSE sy1 END AS cy1 FROM ps)"""
#: The four passes one after the other, each on what those before it left.
_CASCADE = f"""{_EXACT}, r1 AS (SELECT * FROM a WHERE seq NOT IN (SELECT aseq FROM xp)),
pr AS (SELECT r1.seq AS aseq, f.seq AS fseq, {_SORTED.format('r1.anchor_text')} AS x, {_SORTED.format('f.label')} AS y, {_BONUS.format('r1.visit', 'f.visit')} AS bonus, ra.form || '#' || ra.rank AS g FROM r1 JOIN ra ON ra.form = lower(trim(r1.form_name)) AND ra.page = r1.page
 JOIN rf ON rf.form = ra.form AND rf.rank = ra.rank JOIN f ON lower(trim(f.form_name)) = rf.form AND f.page = rf.page WHERE trim(r1.anchor_text) <> ''),
texts AS (SELECT x, y FROM (SELECT DISTINCT {_SORTED.format('anchor_text')} AS x FROM r1 WHERE trim(anchor_text) <> ''), (SELECT DISTINCT {_SORTED.format('label')} AS y FROM f)), {_LCS},
e AS (SELECT DISTINCT g, aseq, fseq, raw + bonus AS score FROM pr JOIN sim USING (x, y) WHERE raw + bonus >= 80), {_picks('e', 'o', 'w')},
r2 AS (SELECT * FROM r1 WHERE seq NOT IN (SELECT aseq FROM w WHERE fseq IS NOT NULL)),
e2 AS (SELECT 'all' AS g, r.seq AS aseq, ff.seq AS fseq, raw + {_BONUS.format('r.visit', 'ff.visit')} AS score FROM (SELECT *, {_SORTED.format('anchor_text')} AS x FROM r2 WHERE trim(anchor_text) <> '') r JOIN sim USING (x) JOIN (SELECT *, {_SORTED.format('label')} AS y FROM f) ff USING (y) WHERE raw + {_BONUS.format('r.visit', 'ff.visit')} >= 90),
{_picks('e2', 'o2', 'w2')}, r3 AS (SELECT * FROM r2 WHERE seq NOT IN (SELECT aseq FROM w2 WHERE fseq IS NOT NULL)),
ap AS (SELECT aseq, fseq, 'exact' AS match_type, CAST(1 AS DOUBLE) AS confidence, 'approved' AS status FROM xp UNION ALL SELECT aseq, fseq, 'fuzzy', least(score / 100, 1), 're-pairing' FROM w WHERE fseq IS NOT NULL UNION ALL SELECT aseq, fseq, 'fuzzy', least(score / 100, 1), 're-pairing' FROM w2 WHERE fseq IS NOT NULL),
{_RAW.format(pairs='ap')}, {_PLACED},
al AS (SELECT ap.aseq AS seq, 'A' || ap.aseq AS annotation_id, fid AS field_id, match_type, confidence, page AS target_page, status, placement_adjusted, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM gc JOIN ap ON ap.aseq = gc.aseq
 UNION ALL SELECT seq, id, NULL, CASE WHEN dl OR known THEN 'position_only' ELSE 'unmatched' END, CAST(CASE WHEN dl OR known THEN 0.5 ELSE 0 END AS DOUBLE), CASE WHEN dl OR known THEN page ELSE 0 END, 're-pairing', cx0 <> sx0 OR cy0 <> sy0 OR cx1 <> sx1 OR cy1 <> sy1, CAST(cx0 AS DOUBLE), CAST(cy0 AS DOUBLE), CAST(cx1 AS DOUBLE), CAST(cy1 AS DOUBLE) FROM pc)"""


@query("q_cascade", f"WITH RECURSIVE {_CASCADE} SELECT * FROM al")
def q_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cascade(spark, sf_dir)
    return out.select("seq", "annotation_id", "field_id", "match_type", "confidence", "target_page", "status", "placement_adjusted", *corners(F.col("target_rect")))


@query("q_cascade_counts", f"WITH RECURSIVE {_CASCADE}, k AS (SELECT unnest(['exact', 'fuzzy', 'position_only', 'manual', 'unmatched']) AS match_type) SELECT k.match_type, count(al.seq) AS n FROM k LEFT JOIN al USING (match_type) GROUP BY 1")
def q_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counts_of(cascade(spark, sf_dir), "match_type", output.TYPES)


# ---------------------------------------------------------------- many pairs of documents

_WORDS = "list_aggregate(list_sort(list_filter(string_split_regex({0}, '\\s+'), lambda t: t <> '')), 'string_agg', ' ')"


def cascade_sql(sim: str, same: float, cross: float, boost: float, sizes: str, sized: str = "") -> str:
    """All passes by pair, over a (pair, seq, id, page, category, anchor_text, form_name, visit, x0..y1, ax0, ay0) and f (pair, seq, id, page, label, form_name, visit, x0..y1).

    ``sim`` makes sim (x, y, raw) of texts (x, y); ``sizes``: sw, sh, tw, th of a row of r3, joined with ``sized``.
    """
    bonus = f"{boost / 5} * ({_BONUS.format('r.visit', 'q.visit')})"
    return f"""ka AS (SELECT *, lower(trim(form_name)) AS form, lower(trim(anchor_text)) AS lab, {_WORDS.format('anchor_text')} AS x FROM a),
fk AS (SELECT *, lower(trim(form_name)) AS form, lower(trim(label)) AS lab, coalesce({_WORDS.format('label')}, '') AS y FROM f), fk0 AS (SELECT pair, form, lab, page, y0, seq FROM fk),
{_KEPT.format(key='pair, form, lab', source='fk0', join='s.pair = z.pair AND s.form = z.form AND s.lab = z.lab')},
kf AS (SELECT pair, form, lab, page, seq, row_number() OVER (PARTITION BY pair, form, lab ORDER BY k) - 1 AS pos FROM z WHERE kept),
ra AS (SELECT DISTINCT pair, form, page, dense_rank() OVER (PARTITION BY pair, form ORDER BY page) AS rank FROM ka),
rf AS (SELECT DISTINCT pair, form, page, dense_rank() OVER (PARTITION BY pair, form ORDER BY page) AS rank FROM fk),
ak AS (SELECT pair, form, lab, page, y0, seq, max(page) OVER (PARTITION BY pair, form, lab) > min(page) OVER (PARTITION BY pair, form, lab) AS many FROM ka WHERE trim(anchor_text) <> ''),
ar AS (SELECT ak.*, CASE WHEN many THEN rank ELSE 0 END AS rank FROM ak JOIN ra USING (pair, form, page)),
an AS (SELECT *, coalesce(page <> lag(page) OVER w OR abs(y0 - lag(y0) OVER w) > 5, false) AS new FROM ar WINDOW w AS (PARTITION BY pair, form, lab, rank ORDER BY page, y0, seq)),
ai AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY pair, form, lab, rank ORDER BY page, y0, seq ROWS UNBOUNDED PRECEDING) AS ridx FROM an),
fr AS (SELECT pair, form, lab, 0 AS rank, seq, pos FROM kf UNION ALL SELECT pair, form, lab, rank, seq, row_number() OVER (PARTITION BY pair, form, lab, rank ORDER BY pos) - 1 FROM kf JOIN rf USING (pair, form, page)),
fn AS (SELECT pair, form, lab, rank, count(*) AS n FROM fr GROUP BY ALL),
xp AS (SELECT ai.pair, ai.seq AS aseq, fr.seq AS fseq FROM ai JOIN fn USING (pair, form, lab, rank) JOIN fr ON fr.pair = ai.pair AND fr.form = ai.form AND fr.lab = ai.lab AND fr.rank = ai.rank AND fr.pos = least(ai.ridx, fn.n - 1)),
r1 AS (SELECT * FROM ka WHERE (pair, seq) NOT IN (SELECT (pair, aseq) FROM xp)),
c1 AS (SELECT r.pair, r.seq AS aseq, q.seq AS fseq, r.x, q.y, {bonus} AS bonus, r.pair || '#' || ra.form || '#' || ra.rank AS g FROM r1 r JOIN ra ON ra.pair = r.pair AND ra.form = r.form AND ra.page = r.page
 JOIN rf ON rf.pair = ra.pair AND rf.form = ra.form AND rf.rank = ra.rank JOIN fk q ON q.pair = rf.pair AND q.form = rf.form AND q.page = rf.page WHERE trim(r.anchor_text) <> ''),
texts AS (SELECT DISTINCT r.x, q.y FROM r1 r JOIN fk q USING (pair) WHERE trim(r.anchor_text) <> ''), {sim},
e AS (SELECT DISTINCT g, aseq, fseq, raw + bonus AS score FROM c1 JOIN sim USING (x, y) WHERE raw + bonus >= {same}), {_picks('e', 'o', 'w')},
w1 AS (SELECT split_part(g, '#', 1) AS pair, aseq, fseq, score FROM w WHERE fseq IS NOT NULL),
r2 AS (SELECT * FROM r1 WHERE (pair, seq) NOT IN (SELECT (pair, aseq) FROM w1)),
e2 AS (SELECT r.pair AS g, r.seq AS aseq, q.seq AS fseq, raw + {bonus} AS score FROM r2 r JOIN fk q USING (pair) JOIN sim ON sim.x = r.x AND sim.y = q.y WHERE trim(r.anchor_text) <> '' AND raw + {bonus} >= {cross}),
{_picks('e2', 'o2', 'w2')}, w3 AS (SELECT g AS pair, aseq, fseq, score FROM w2 WHERE fseq IS NOT NULL), r3 AS (SELECT * FROM r2 WHERE (pair, seq) NOT IN (SELECT (pair, aseq) FROM w3)),
ap AS (SELECT pair, aseq, fseq, 'exact' AS match_type, CAST(1 AS DOUBLE) AS confidence, 'approved' AS status FROM xp UNION ALL SELECT pair, aseq, fseq, 'fuzzy', least(score / 100, 1), 're-pairing' FROM w1 UNION ALL SELECT pair, aseq, fseq, 'fuzzy', least(score / 100, 1), 're-pairing' FROM w3),
raw AS (SELECT p.pair, p.aseq, p.match_type, p.confidence, p.status, q.id AS fid, q.seq AS fseq, q.page, q.lab, q.pw, q.ph, CASE WHEN ax0 IS NOT NULL THEN q.x0 + (a.x0 - ax0) ELSE q.x0 END AS x0, CASE WHEN ax0 IS NOT NULL THEN q.y0 + (a.y0 - ay0) ELSE q.y0 END AS y0,
 CASE WHEN ax0 IS NOT NULL THEN q.x0 + (a.x0 - ax0) + (a.x1 - a.x0) ELSE q.x1 END AS x1, CASE WHEN ax0 IS NOT NULL THEN q.y0 + (a.y0 - ay0) + (a.y1 - a.y0) ELSE q.y1 END AS y1 FROM ap p JOIN ka a ON a.pair = p.pair AND a.seq = p.aseq JOIN fk q ON q.pair = p.pair AND q.seq = p.fseq),
gd AS (SELECT raw.*, raw.x0 < 0 OR raw.y0 < 0 OR raw.x1 > pw OR raw.y1 > ph AS off FROM raw),
pe AS (SELECT gd.pair, gd.aseq, arg_min({{'x0': q.x0, 'y0': q.y0, 'x1': q.x1, 'y1': q.y1}}, {{'a': q.x0, 'b': q.seq}}) AS peer FROM gd JOIN fk q ON q.pair = gd.pair AND q.page = gd.page AND q.lab = gd.lab AND q.seq <> gd.fseq WHERE off GROUP BY ALL),
gp AS (SELECT gd.pair, aseq, match_type, confidence, status, fid, page, pw, ph, peer IS NOT NULL AS moved, coalesce(peer.x0, x0) AS x0, coalesce(peer.y0, y0) AS y0, coalesce(peer.x1, x1) AS x1, coalesce(peer.y1, y1) AS y1 FROM gd LEFT JOIN pe USING (pair, aseq)),
gc AS (SELECT *, greatest(0, least(x0, pw)) AS cx0, greatest(0, least(y0, ph)) AS cy0, greatest(0, least(x1, pw)) AS cx1, greatest(0, least(y1, ph)) AS cy1 FROM gp),
pk AS (SELECT DISTINCT pair, form FROM fk), pp AS (SELECT r3.*, category = 'domain_label' AS dl, pk.form IS NOT NULL AS known, {sizes} FROM r3 LEFT JOIN pk USING (pair, form) {sized}),
ps AS (SELECT *, dl OR known AS placed, CASE WHEN dl OR NOT known THEN x0 ELSE x0 * (tw / sw) END AS sx0, CASE WHEN dl OR NOT known THEN y0 ELSE y0 * (th / sh) END AS sy0, CASE WHEN dl OR NOT known THEN x1 ELSE x1 * (tw / sw) END AS sx1, CASE WHEN dl OR NOT known THEN y1 ELSE y1 * (th / sh) END AS sy1 FROM pp),
pc AS (SELECT *, placed AND tw > 0 AND th > 0 AS clamp, greatest(0, least(sx0, tw)) AS cx0, greatest(0, least(sy0, th)) AS cy0, greatest(0, least(sx1, tw)) AS cx1, greatest(0, least(sy1, th)) AS cy1 FROM ps),
al AS (SELECT pair, aseq AS seq, fid AS field_id, match_type, confidence, page AS target_page, status, moved OR x0 <> cx0 OR y0 <> cy0 OR x1 <> cx1 OR y1 <> cy1 AS placement_adjusted, cx0 AS x0, cy0 AS y0, cx1 AS x1, cy1 AS y1 FROM gc
 UNION ALL SELECT pair, seq, NULL, CASE WHEN placed THEN 'position_only' ELSE 'unmatched' END, CAST(CASE WHEN placed THEN 0.5 ELSE 0 END AS DOUBLE), CASE WHEN placed THEN page ELSE 0 END, 're-pairing', clamp AND (cx0 <> sx0 OR cy0 <> sy0 OR cx1 <> sx1 OR cy1 <> sy1),
 CASE WHEN clamp THEN cx0 ELSE sx0 END, CASE WHEN clamp THEN cy0 ELSE sy0 END, CASE WHEN clamp THEN cx1 ELSE sx1 END, CASE WHEN clamp THEN cy1 ELSE sy1 END FROM pc)"""


_LINKS = ("pair", "seq", "field_id", "match_type", "confidence", "target_page", "status", "placement_adjusted")
_LINKS_SQL = "SELECT pair, seq, field_id, match_type, confidence, CAST(target_page AS INT) AS target_page, status, placement_adjusted, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM al"

#: A pair for each supplier; places are counted anew in each, so they and the pages repeat from pair to pair.
_ITEMS = """
SELECT 'S' || CAST(l_suppkey AS STRING) AS pair, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS seq, l_orderkey, l_partkey, l_linenumber, p_name, p_brand, p_type, p_size
FROM <<lineitem>> JOIN <<part>> ON l_partkey = p_partkey
"""
_PAIR_ANNOTATIONS = """
SELECT pair, seq, 'A' || CAST(seq AS STRING) AS id, CAST(1 + l_linenumber AS INT) AS page, CASE WHEN l_orderkey % 20 = 0 THEN 'domain_label' ELSE 'sdtm_mapping' END AS category,
       CASE WHEN l_orderkey % 10 = 0 THEN ' ' ELSE p_name END AS anchor_text, p_type AS form_name, 'Week ' || CAST(l_orderkey % 4 AS STRING) AS visit,
       CAST((l_orderkey * 37) % 500 AS DOUBLE) AS x0, CAST((l_orderkey * 53) % 760 AS DOUBLE) AS y0, CAST((l_orderkey * 37) % 500 + 120 AS DOUBLE) AS x1, CAST((l_orderkey * 53) % 760 + 14 AS DOUBLE) AS y1,
       CASE WHEN l_orderkey % 3 > 0 THEN CAST(50 AS DOUBLE) END AS ax0, CASE WHEN l_orderkey % 3 > 0 THEN CAST((l_orderkey * 53) % 760 AS DOUBLE) END AS ay0
FROM <<items>>
"""
_PAIR_FIELDS = """
SELECT pair, seq, 'F' || CAST(seq AS STRING) AS id, CAST(1 + l_linenumber AS INT) AS page,
       CASE l_orderkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN p_name || 's' ELSE p_name END AS label,
       CASE WHEN l_orderkey % 7 = 0 THEN 'Other ' || p_type ELSE lower(p_type) END AS form_name, 'week ' || CAST(l_orderkey % 3 AS STRING) AS visit,
       CAST((l_orderkey * 41) % 560 AS DOUBLE) AS x0, CAST((l_orderkey * 29) % 760 AS DOUBLE) AS y0, CAST((l_orderkey * 41) % 560 + 80 AS DOUBLE) AS x1, CAST((l_orderkey * 29) % 760 + 12 AS DOUBLE) AS y1, CAST(595 AS DOUBLE) AS page_width, CAST(842 AS DOUBLE) AS page_height
FROM <<items>>
"""
_PAIRS_SQL = f"items AS ({duck(_ITEMS)}), a AS ({duck(_PAIR_ANNOTATIONS)}), f AS (SELECT *, page_width AS pw, page_height AS ph FROM ({duck(_PAIR_FIELDS)}))".replace("STRING", "VARCHAR")


def pair_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = stored(view(spark, sf_dir, _ITEMS, "lineitem", wide=("part",)))
    a, f = (with_rect(spark.sql(q.replace("<<items>>", "{items}"), items=items)) for q in (_PAIR_ANNOTATIONS, _PAIR_FIELDS))
    return a.withColumn("anchor_rect", F.when(F.col("ax0").isNotNull(), F.array(F.col("ax0"), F.col("ay0"), F.col("ax0") + 100.0, F.col("ay0") + 12.0))).drop("ax0", "ay0"), f


_PAIR_SIZES = "CAST(595 AS DOUBLE) AS sw, CAST(842 AS DOUBLE) AS sh, CAST(612 AS DOUBLE) AS tw, CAST(792 AS DOUBLE) AS th"


@query("q_cascade_pairs", f"WITH RECURSIVE {_PAIRS_SQL}, {cascade_sql(_LCS, 80, 90, 5, _PAIR_SIZES)} {_LINKS_SQL}")
def q_cascade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair by itself, all at once."""
    a, f = pair_records(spark, sf_dir)
    out = matching.match_annotations(a, f, page_sizes(spark, 595.0, 842.0, 9), page_sizes(spark, 612.0, 792.0, 9), standard_profile().matching_config, at_hand=True)
    return out.select(*_LINKS, *corners(F.col("target_rect")))


#: The new version of a document: pages moved on in every other document, lines a little lower, some words added.
_TARGET_COLUMNS = "SELECT doc_id, CAST(page + CAST(doc_id AS BIGINT) % 2 AS INT) AS page, seq, CASE WHEN seq % 10 = 4 THEN text || ' (new)' ELSE text END AS text, font_size, bold, x0, y0 + 3 AS y0, x1, y1 + 3 AS y1 FROM <<spans>>"
_EQUAL_TEXTS = "sim AS (SELECT x, y, CAST(100 AS DOUBLE) AS raw FROM texts WHERE x = y)"
_DOC_ANNOTATIONS = f"""ss AS (SELECT *, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS t FROM spans), contents AS ({_LINE_COLUMNS.replace('STRING', 'VARCHAR')}), notes AS ({duck(_NOTE_COLUMNS).replace('(i - i % 40) / 40', '(i - i % 40) // 40')}),
nk AS (SELECT * FROM (SELECT *, {_CASE} AS category FROM notes WHERE length(content) > 0) WHERE category <> '_exclude'), nb AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS lx FROM ss),
nc AS (SELECT m.doc_id, m.page, m.seq, b.t, b.x0 AS bx, b.y0 AS by, row_number() OVER (PARTITION BY m.doc_id, m.page, m.seq ORDER BY greatest(0.0, greatest(m.y0, b.y0) - least(m.y1, b.y1)), abs((b.y0 + b.y1) / 2 - m.y0), b.seq) AS r
 FROM nk m JOIN (SELECT * FROM nb WHERE x0 <= lx + 50 AND t <> '' AND NOT {_EXCLUDE}) b ON b.doc_id = m.doc_id AND b.page = m.page),
nn AS (SELECT doc_id, page, t, row_number() OVER (PARTITION BY doc_id, page ORDER BY NOT bold, -font_size, y0, seq) AS r FROM ss WHERE t <> '' AND NOT {_EXCLUDE} AND font_size >= 6.5 AND y0 <= 0.35 * 842),
a AS (SELECT nk.doc_id AS pair, (CAST(page AS BIGINT) << 32) + seq AS seq, page, category, coalesce(nc.t, '') AS anchor_text, coalesce(nn.t, '') AS form_name, '' AS visit, nk.x0, nk.y0, nk.x1, nk.y1, nc.bx AS ax0, nc.by AS ay0
 FROM nk LEFT JOIN (SELECT * FROM nc WHERE r = 1) nc USING (doc_id, page, seq) LEFT JOIN (SELECT * FROM nn WHERE r = 1) nn USING (doc_id, page))"""
_DOC_FIELDS = f"""tg AS ({duck(_TARGET_COLUMNS)}), tk AS (SELECT * FROM tg s WHERE NOT EXISTS (SELECT 1 FROM tg c WHERE c.doc_id = s.doc_id AND c.page = s.page AND c.y0 <= 0.35 * 792 AND regexp_matches(c.text, '^Codelist\\b', 'i'))),
ts AS (SELECT *, trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS t, {_MARKER} AS ft FROM tk), tb AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS lx FROM ts WHERE ft = 'none'),
tc AS (SELECT m.doc_id, m.page, m.seq, b.t, row_number() OVER (PARTITION BY m.doc_id, m.page, m.seq ORDER BY greatest(0.0, greatest(m.y0, b.y0) - least(m.y1, b.y1)), abs((b.y0 + b.y1) / 2 - m.y0), b.seq) AS r
 FROM (SELECT * FROM ts WHERE ft <> 'none') m JOIN (SELECT * FROM tb WHERE x0 <= lx + 50 AND t <> '' AND NOT {_EXCLUDE}) b ON b.doc_id = m.doc_id AND b.page = m.page WHERE greatest(0.0, greatest(m.y0, b.y0) - least(m.y1, b.y1)) <= 30),
rec AS (SELECT doc_id, page, seq, x0, y0, x1, y1, t AS label, 0 AS p FROM ts WHERE ft = 'none' AND (bold OR font_size >= 6.5) AND NOT {_EXCLUDE}
 UNION ALL SELECT ts.doc_id, ts.page, ts.seq, ts.x0, ts.y0, ts.x1, ts.y1, coalesce(tc.t, ts.text), 1 FROM ts LEFT JOIN (SELECT * FROM tc WHERE r = 1) tc ON tc.doc_id = ts.doc_id AND tc.page = ts.page AND tc.seq = ts.seq WHERE ts.ft <> 'none'),
tn AS (SELECT doc_id, page, arg_min(label, {{'a': y0, 'b': x0, 'c': p, 'd': seq}}) AS form_name FROM (SELECT *, label AS t FROM rec) WHERE NOT {_EXCLUDE} GROUP BY 1, 2),
f AS (SELECT doc_id AS pair, (CAST(page AS BIGINT) << 32) + (CAST(p AS BIGINT) << 31) + seq AS seq, sha256(doc_id || '/' || page || '/' || p || '/' || seq) AS id, page, label, coalesce(form_name, '') AS form_name, '' AS visit, x0, y0, x1, y1, CAST(612 AS DOUBLE) AS pw, CAST(792 AS DOUBLE) AS ph
 FROM rec LEFT JOIN tn USING (doc_id, page))"""
_DOC_SIZES = """tz.page IS NOT NULL AS sized, CAST(595 AS DOUBLE) AS sw, CAST(842 AS DOUBLE) AS sh, CASE WHEN sized THEN CAST(612 AS DOUBLE) WHEN category = 'domain_label' THEN 0 ELSE CAST(595 AS DOUBLE) END AS tw,
 CASE WHEN sized THEN CAST(792 AS DOUBLE) WHEN category = 'domain_label' THEN 0 ELSE CAST(842 AS DOUBLE) END AS th"""


@query("q_documents_linked", f"WITH RECURSIVE {SPANS_SQL}, {_DOC_ANNOTATIONS}, {_DOC_FIELDS}, {cascade_sql(_EQUAL_TEXTS, 100, 100, 0, _DOC_SIZES, 'LEFT JOIN (SELECT DISTINCT doc_id, page FROM tg) tz ON tz.doc_id = r3.pair AND tz.page = r3.page')} {_LINKS_SQL}")
def q_documents_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From spans and raw annotations to links, every document with its own new version. Fuzzy passes ask for equal words in any order, which SQL can say of long lines."""
    s = stored(spans(spark, sf_dir))
    source = layout.annotations_of(_raw_notes(spark, sf_dir), s, standard_profile(), dims(s))
    t_ = with_rect(spark.sql(_TARGET_COLUMNS.replace("<<spans>>", "{spans}"), spans=s.select("*", *corners(F.col("rect"))).drop("rect")))
    sizes = dims(t_).withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    fields_ = layout.fields_of(t_, sizes, standard_profile())
    config = profile_of({"meta": {"name": "w"}, "domain_codes": [], "classification_rules": [], "matching_config": {"fuzzy_same_form_threshold": 1.0, "fuzzy_cross_form_threshold": 1.0, "visit_boost": 0.0}}).matching_config
    out = matching.match_annotations(source, fields_, dims(s), sizes, config)
    return out.select(*_LINKS, *corners(F.col("target_rect")))


@query(
    "q_geometry",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_extendedprice / 100 AS y0, l_quantity + 30 AS x1, l_extendedprice / 100 + 12 AS y1 FROM lineitem),
s AS (SELECT *, CAST(612 AS DOUBLE) / CAST(595 AS DOUBLE) AS sx, CAST(792 AS DOUBLE) / CAST(842 AS DOUBLE) AS sy FROM r)
SELECT l_orderkey, l_linenumber, x0 < 0 OR y0 < 0 OR x1 > 595 OR y1 > 842 AS off, greatest(0, least(y0, 842)) AS cy0, greatest(0, least(x1, 595)) AS cx1, x0 * sx AS sx0, y1 * sy AS sy1, CAST(100 AS DOUBLE) + (x0 - 50) AS ax0, CAST(300 AS DOUBLE) + (y0 - 40) + (y1 - y0) AS ay1 FROM s""",
)
def q_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_extendedprice") / 100
    r = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity").cast("double"), p, F.col("l_quantity") + 30, p + 12).alias("r"))
    w, h = F.lit(595.0), F.lit(842.0)
    c, s = g.clamped(F.col("r"), w, h), g.scaled(F.col("r"), w, h, F.lit(612.0), F.lit(792.0))
    a = g.anchored(F.col("r"), g.rect(F.lit(50.0), F.lit(40.0), F.lit(90.0), F.lit(52.0)), g.rect(F.lit(100.0), F.lit(300.0), F.lit(140.0), F.lit(312.0)))
    return r.select("l_orderkey", "l_linenumber", g.outside(F.col("r"), w, h).alias("off"), c[1].alias("cy0"), c[2].alias("cx1"), s[0].alias("sx0"), s[3].alias("sy1"), a[0].alias("ax0"), a[3].alias("ay1"))


# ---------------------------------------------------------------- style

_FONTS = "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Arial,BoldItalic' WHEN 1 THEN 'TimesNewRoman' WHEN 2 THEN 'Times-Italic' WHEN 3 THEN 'CourierNew,Bold' WHEN 4 THEN 'hebi' WHEN 5 THEN 'Cour-Oblique' WHEN 6 THEN 'TIBO' ELSE p_name END AS font FROM <<part>>"


@query(
    "q_style_resolve",
    f"""WITH n AS (SELECT p_partkey, regexp_matches(font, '(bold|hebo|hebi|cobo|cobi|tibo|tibi)', 'i') AS bold, regexp_matches(font, '(italic|oblique|heit|hebi|coit|cobi|tiit|tibi)', 'i') AS italic,
 CASE WHEN regexp_matches(font, '(times|tiro|tiit|tibo|tibi)', 'i') THEN 'Times' WHEN regexp_matches(font, '(courier|cour|coit|cobo|cobi)', 'i') THEN 'Courier' ELSE 'Helvetica' END AS family FROM ({duck(_FONTS)}))
SELECT p_partkey, family || CASE WHEN NOT bold AND NOT italic THEN CASE family WHEN 'Times' THEN '-Roman' ELSE '' END ELSE '-' || CASE WHEN bold THEN 'Bold' ELSE '' END || CASE WHEN italic THEN CASE family WHEN 'Times' THEN 'Italic' ELSE 'Oblique' END ELSE '' END END AS name, bold, italic FROM n""",
)
def q_style_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = style.standard_font(F.col("font"))
    return view(spark, sf_dir, _FONTS, "part").select("p_partkey", f["name"].alias("name"), f["bold"].alias("bold"), f["italic"].alias("italic"))


_COLOURS = "SELECT p_partkey, '0.' || CAST(p_size AS STRING) || ' 1 .5 rg /F' || CAST(p_size % 3 AS STRING) || ' 9.5 Tf 0 0 0 rg' AS da, 'background-color:#ffffff; color:#' || substr('0123456789abcdef0123', 1 + p_size % 14, 6) || ';' AS rc FROM <<part>>"


@query(
    "q_colors",
    f"""SELECT p_partkey, CAST(regexp_extract(da, '^(\\S+)', 1) AS DOUBLE) AS red, regexp_extract(da, '/(\\S+) ', 1) AS font,
 CAST(('0x' || substr(regexp_extract(rc, ' color:#(.{{6}})', 1), 1, 2))::INT AS DOUBLE) / 255 AS r, CAST(('0x' || substr(regexp_extract(rc, ' color:#(.{{6}})', 1), 5, 2))::INT AS DOUBLE) / 255 AS b, '#' || regexp_extract(rc, ' color:#(.{{6}})', 1) AS hex FROM ({duck(_COLOURS).replace('STRING', 'VARCHAR')})""",
)
def q_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = style.rich_text_rgb(F.col("rc"))
    none = F.lit(None)
    made = style.parsed_style(F.col("da"), F.col("rc"), none.cast("array<double>"), none.cast("double"), none.cast("array<int>"), none.cast("string"), "Arial", 10.0, None)
    rows = view(spark, sf_dir, _COLOURS, "part").select("p_partkey", style.device_rgb(F.col("da"))[0].alias("red"), made["font"].alias("font"), rgb.alias("c"))
    return rows.select("p_partkey", "red", "font", F.col("c")[0].alias("r"), F.col("c")[2].alias("b"), style.hex_rgb(*[F.col("c")[k] for k in range(3)]).alias("hex"))


# ---------------------------------------------------------------- review

_EXISTING = "SELECT CAST(c_custkey AS STRING) AS id, c_custkey AS seq, c_name AS label, c_mktsegment AS form_name FROM <<customer>>"
_INCOMING = "SELECT CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'x' || CAST(o_custkey AS STRING) ELSE CAST(o_custkey AS STRING) END AS id, o_orderpriority AS label, o_orderstatus AS form_name, o_orderkey AS row FROM <<orders>>"


@query(
    "q_upsert",
    f"""WITH e AS ({duck(_EXISTING)}), i AS ({duck(_INCOMING)}), l AS (SELECT id, arg_max(label, row) AS label, arg_max(form_name, row) AS form_name FROM i WHERE id <> '' GROUP BY id)
SELECT e.seq, CASE WHEN l.id IS NULL THEN e.label ELSE l.label END AS label, CASE WHEN l.id IS NULL THEN e.form_name ELSE l.form_name END AS form_name FROM e LEFT JOIN l USING (id)
UNION ALL SELECT (SELECT max(seq) FROM e) + 1 + row, label, form_name FROM i WHERE id = ''""".replace("STRING", "VARCHAR"),
)
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.upsert(view(spark, sf_dir, _EXISTING, "customer"), view(spark, sf_dir, _INCOMING, "orders"))[0].select("seq", "label", "form_name")


_PARTIAL = f"{_INCOMING} WHERE o_custkey % 5 > 0"


@query("q_flag_missing", f"WITH e AS ({duck(_EXISTING)}), i AS ({duck(_PARTIAL)}) SELECT id, seq FROM e WHERE id NOT IN (SELECT id FROM i)".replace("STRING", "VARCHAR"))
def q_flag_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.upsert(view(spark, sf_dir, _EXISTING, "customer"), view(spark, sf_dir, _PARTIAL, "orders"))[1]


@query("q_update_matches", f"WITH m AS ({M_SQL}) SELECT seq, CASE seq % 3 WHEN 0 THEN status WHEN 1 THEN 're-pairing' ELSE 'approved' END AS status, CASE seq % 3 WHEN 1 THEN NULL ELSE field_id END AS field_id FROM m")
def q_update_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    new = m.where("seq % 3 > 0").withColumns({"row": F.col("seq"), "status": F.when(F.col("seq") % 3 == 1, "rejected").otherwise("modified"), "field_id": F.when(F.col("seq") % 3 == 1, F.lit("")).otherwise(F.coalesce("field_id", F.lit("")))}).drop("seq")
    return review.update_matches(m, new)[0].select("seq", "status", "field_id")


@query("q_manual_update", f"WITH m AS ({M_SQL}) SELECT seq, CASE WHEN seq = 7 THEN 'F1' ELSE field_id END AS field_id, CASE WHEN seq = 7 THEN 'manual' ELSE match_type END AS match_type, CASE WHEN seq = 7 THEN 'approved' ELSE status END AS status, CASE WHEN seq = 7 THEN 1.0 ELSE x0 END AS x0 FROM m")
def q_manual_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.manual_match(matches(spark, sf_dir), "A7", "F1", [1.0, 2.0, 3.0, 4.0]).select("seq", "field_id", "match_type", "status", F.col("target_rect")[0].alias("x0"))


@query("q_batch_approve", f"WITH m AS ({M_SQL}) SELECT seq, CASE WHEN match_type = 'exact' THEN 'approved' ELSE status END AS status FROM m")
def q_batch_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.approve_exact(matches(spark, sf_dir)).select("seq", "status")


@query("q_reopen", f"WITH m AS ({M_SQL}) SELECT seq, CASE WHEN annotation_id = 'A6' THEN 're-pairing' ELSE status END AS status FROM m")
def q_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reopened(matches(spark, sf_dir), "A6").select("seq", "status")


@query("q_remove", f"WITH m AS ({F_SQL}) SELECT id FROM m WHERE seq % 3 <> 0")
def q_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir)
    return review.removed(f, f.where("seq % 3 = 0")).select("id")


@query("q_add", f"WITH f AS ({F_SQL}) SELECT seq, label, page, y1 FROM f UNION ALL SELECT max(seq) + 1, 'new', 1, 20 FROM f")
def q_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.added(fields(spark, sf_dir), {"id": "n", "label": "new"}).select("seq", "label", "page", F.col("rect")[3].alias("y1"))


@query("q_review_filter", f"WITH m AS ({M_SQL}) SELECT seq FROM m WHERE match_type IN ('exact', 'fuzzy') AND status IN ('approved', 'pending')")
def q_review_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.chosen(matches(spark, sf_dir), ["exact", "fuzzy"], ["approved", "pending"]).select("seq")


@query("q_review_filter_none", f"WITH m AS ({M_SQL}) SELECT seq FROM m WHERE false")
def q_review_filter_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.chosen(matches(spark, sf_dir), [], []).select("seq")


@query("q_page_groups", f"WITH m AS ({M_SQL}) SELECT DISTINCT target_page FROM m")
def q_page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.page_groups(matches(spark, sf_dir))


@query("q_counts_zero_filled", f"WITH m AS ({M_SQL}), k AS (SELECT unnest(['exact', 'fuzzy', 'position_only', 'manual', 'unmatched']) AS match_type) SELECT k.match_type, count(m.seq) AS n FROM k LEFT JOIN m USING (match_type) GROUP BY 1")
def q_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counts_of(matches(spark, sf_dir), "match_type", output.TYPES)


@query("q_counts_field_type", f"WITH f AS ({F_SQL}), k AS (SELECT unnest(['text_field', 'checkbox', 'date_field', 'table_row', 'section_header']) AS field_type) SELECT k.field_type, count(f.seq) AS n FROM k LEFT JOIN f USING (field_type) GROUP BY 1")
def q_counts_field_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counts_of(fields(spark, sf_dir), "field_type", review.FIELD_TYPES)


@query("q_distinct_forms", f"WITH f AS ({F_SQL}) SELECT count(DISTINCT nullif(form_name, '')) AS forms FROM f")
def q_distinct_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.distinct_forms(fields(spark, sf_dir))


@query("q_match_rate", f"WITH m AS ({M_SQL}) SELECT CAST(round_even(CAST(100 AS DOUBLE) * count(*) FILTER (match_type = 'exact') / (SELECT count(*) FROM part), 0) AS INT) AS rate FROM m")
def q_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.exact_rate(matches(spark, sf_dir), annotations(spark, sf_dir))


@query("q_pending_exact", f"WITH m AS ({M_SQL}) SELECT count(*) AS n FROM m WHERE match_type = 'exact' AND status = 'pending'")
def q_pending_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.pending_exact(matches(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("q_label_search", f"WITH f AS ({F_SQL}) SELECT page, count(*) AS n FROM f WHERE contains(lower(label), 'ring') GROUP BY 1")
def q_label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.field_pages(review.fields_matching(fields(spark, sf_dir), "RING"))


@query("q_greatest_page", f"WITH f AS ({F_SQL}) SELECT coalesce(max(page), 1) AS page FROM f")
def q_greatest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.greatest_page(fields(spark, sf_dir))


@query(
    "q_top3",
    f"""WITH RECURSIVE {AF_SQL}, pr AS (SELECT a.seq AS aseq, f.seq AS fseq, {_SORTED.format('a.anchor_text')} AS x, {_SORTED.format('f.label')} AS y, {_BONUS.format('a.visit', 'f.visit')} AS bonus FROM a JOIN f ON lower(f.form_name) = lower(a.form_name)),
texts AS (SELECT DISTINCT x, y FROM pr), {_LCS}, r AS (SELECT aseq, fseq, raw + bonus AS score, row_number() OVER (PARTITION BY aseq ORDER BY raw + bonus DESC, fseq) AS place FROM pr JOIN sim USING (x, y) WHERE raw + bonus >= 60)
SELECT aseq, fseq, score, CAST(place AS INT) AS place FROM r WHERE place <= 3""",
)
def q_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.suggestions(annotations(spark, sf_dir), fields(spark, sf_dir), 60.0, 5.0)


@query("q_enriched", f"WITH m AS ({M_SQL}), {AF_SQL} SELECT m.seq, coalesce(f.label || '  ·  ' || f.form_name || '  ·  p.' || f.page, '—') AS field_label, substr(coalesce(a.content, m.annotation_id), 1, 40) AS short_content FROM m LEFT JOIN a ON a.id = m.annotation_id LEFT JOIN f ON f.id = m.field_id")
def q_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.enriched(matches(spark, sf_dir), annotations(spark, sf_dir), fields(spark, sf_dir)).select("seq", "field_label", "short_content")


# ---------------------------------------------------------------- output

_WRITTEN = f"m AS ({M_SQL}), {AF_SQL}, w AS (SELECT m.*, a.id IS NOT NULL AND status = 'approved' AND target_page BETWEEN 1 AND 6 AS written, a.content, a.category FROM m LEFT JOIN a ON a.id = m.annotation_id)"


@query("q_write_manifest", f"WITH {_WRITTEN} SELECT annotation_id, target_page, content, x0, CASE WHEN category = 'domain_label' THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS font, CAST(12 AS DOUBLE) AS size, CAST(0.75 AS DOUBLE) AS fill, CAST(1 AS DOUBLE) AS border_width FROM w WHERE written")
def q_write_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profile_of({"meta": {"name": "w"}, "domain_codes": [], "classification_rules": [], "style_defaults": {"use_source_style": False, "font_size": 12.0, "domain_label_font_size": 12.0}}).style_defaults
    m = output.placement_manifest(matches(spark, sf_dir), annotations(spark, sf_dir), 6, s)
    return m.select("annotation_id", "target_page", "content", F.col("target_rect")[0].alias("x0"), F.col("text_style.name").alias("font"), F.col("text_style.size").alias("size"), F.col("fill_color")[0].alias("fill"), "border_width")


@query(
    "q_qc_report",
    f"""WITH {_WRITTEN} SELECT count(*) AS total_matches, count(*) FILTER (written) AS written, count(*) FILTER (NOT written) AS skipped, count(*) FILTER (match_type = 'exact') AS exact,
 md5(string_agg(annotation_id, ',' ORDER BY seq) FILTER (match_type = 'unmatched')) AS unmatched, md5(string_agg(annotation_id, ',' ORDER BY seq) FILTER (status = 're-pairing')) AS re_pairing, md5(string_agg(annotation_id, ',' ORDER BY seq) FILTER (placement_adjusted)) AS adjusted FROM w""",
)
def q_qc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = output.qc_report(output.writable(matches(spark, sf_dir), annotations(spark, sf_dir), 6))
    ids = {"unmatched": "unmatched_annotation_ids", "re_pairing": "re_pairing_annotation_ids", "adjusted": "placement_adjusted_ids"}
    return r.select("total_matches", "written", "skipped", F.col("counts_by_match_type")["exact"].alias("exact"), *[F.md5(F.array_join(c, ",")).alias(n) for n, c in ids.items()])


@query("q_qc_ids", f"WITH {_WRITTEN} SELECT 'unmatched' AS list, seq, annotation_id FROM w WHERE match_type = 'unmatched' UNION ALL SELECT 're_pairing', seq, annotation_id FROM w WHERE status = 're-pairing' UNION ALL SELECT 'placement_adjusted', seq, annotation_id FROM w WHERE placement_adjusted")
def q_qc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.qc_ids(output.writable(matches(spark, sf_dir), annotations(spark, sf_dir), 6))


@query("q_write_eligibility", f"WITH {_WRITTEN} SELECT seq, written FROM w")
def q_write_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return output.writable(matches(spark, sf_dir), annotations(spark, sf_dir), 6).select("seq", "written")


# ---------------------------------------------------------------- sources and sinks


@query("q_csv_round_trip", f"WITH f AS ({F_SQL}) SELECT id, page, label, form_name, visit, x0, y1, field_type, page_width FROM f")
def q_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    records.export_csv(fields(spark, sf_dir), path, "fields")
    return records.import_csv(spark, path, "fields").select("id", "page", "label", "form_name", "visit", F.col("rect")[0].alias("x0"), F.col("rect")[3].alias("y1"), "field_type", "page_width")


@query("q_json_round_trip", f"WITH m AS ({M_SQL}) SELECT seq, annotation_id, field_id, match_type, confidence, target_page, status, placement_adjusted, x0 FROM m")
def q_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved in several files; the order comes back as seq."""
    path = shared_folder(spark)
    records.save_json(matches(spark, sf_dir).repartition(7, "annotation_id"), path, "matches")
    out = records.load_json(spark, path, "matches")
    return out.select("seq", "annotation_id", "field_id", "match_type", "confidence", "target_page", "status", "placement_adjusted", F.col("target_rect")[0].alias("x0"))


@query("q_csv_matches", f"WITH m AS ({M_SQL}) SELECT annotation_id, coalesce(field_id, '') AS field_id, match_type, confidence, target_page, status, placement_adjusted, y1 FROM m")
def q_csv_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    records.export_csv(matches(spark, sf_dir), path, "matches")
    out = records.import_csv(spark, path, "matches")
    return out.select("annotation_id", "field_id", "match_type", "confidence", "target_page", "status", "placement_adjusted", F.col("target_rect")[3].alias("y1"))


@query("q_csv_annotations", f"WITH a AS ({A_SQL}) SELECT id, page, content, domain, category, CASE WHEN trim(anchor_text) = '' THEN ' ' ELSE anchor_text END AS anchor_text, form_name, visit, x0, ax0, CAST(10 AS DOUBLE) AS size, 0 AS rotation FROM a")
def q_csv_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With style, anchor and rotation."""
    path = shared_folder(spark)
    records.export_csv(annotations(spark, sf_dir), path, "annotations")
    out = records.import_csv(spark, path, "annotations")
    return out.select("id", "page", "content", "domain", "category", "anchor_text", "form_name", "visit", F.col("rect")[0].alias("x0"), F.col("anchor_rect")[0].alias("ax0"), F.col("style.font_size").alias("size"), "rotation")


@query("q_distinct_choices", f"WITH f AS ({F_SQL}) SELECT DISTINCT visit FROM f WHERE visit <> ''")
def q_distinct_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.distinct_values(fields(spark, sf_dir), "visit")


@query("q_page_filter", f"WITH f AS ({F_SQL}) SELECT count(*) FILTER (page = 3) AS shown, count(*) AS total FROM f")
def q_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(spark, sf_dir)
    return review.shown_of(review.on_page(f, 3), f)


@query("q_audit_counts", "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H') AS hour, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")
def q_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("action"))
    return action_counts(log).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "action", "n")


# ---------------------------------------------------------------- spans, styles, edits and versions


@query(
    "q_text_spans",
    """WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(range(len(l))) AS b, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
p AS (SELECT doc_id, b, unnest(range(len(l))) AS k, unnest(l) AS said FROM (SELECT doc_id, b, string_split(line, '. ') AS l FROM b WHERE b % 5 <> 4)), t AS (SELECT *, trim(said, ' ' || chr(9) || chr(13) || chr(10)) AS text FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, k) - 1 AS seq, md5(text) AS text_md5, CAST(CASE WHEN k % 4 = 3 THEN 10 ELSE 8 + k % 4 END AS DOUBLE) AS font_size, b % 3 = 0 OR k % 2 = 1 AS bold, CAST(20 * b AS DOUBLE) AS y0 FROM t WHERE text <> ''""",
)
def q_text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a document: a block a line, some of them images, and a span a sentence."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))

    def span(b: Column) -> Callable[[Column, Column], Column]:
        return lambda said, k: F.struct(
            said.alias("text"), F.when(k % 4 != 3, 8.0 + k % 4).alias("size"), F.when(b % 3 == 0, 16).otherwise(0).alias("flags"), F.when(k % 2 == 1, "Arial-BOLD").otherwise("Arial").alias("font"), g.rect(F.lit(0.0), 20.0 * b, F.lit(9.0), 20.0 * b + 9).alias("bbox")
        )

    blocks = docs.select("doc_id", "page", F.transform("lines", lambda line, b: F.struct(F.when(b % 5 == 4, 1).otherwise(0).alias("type"), F.array(F.struct(F.transform(F.split(line, "\\. "), span(b)).alias("spans"))).alias("lines"))).alias("blocks"))
    return layout.text_spans(blocks).select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5("text").alias("text_md5"), "font_size", "bold", F.col("rect")[1].alias("y0"))


@query("q_annotation_rects", "SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS INT) AS page, CAST(10 * turn AS DOUBLE) AS x0, CAST(length(text) AS DOUBLE) AS x1 FROM conversations WHERE lower(role) IN ('user', 'system')")
def q_annotation_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("double")
    raw = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.col("role").alias("subtype"), g.rect(10 * turn, F.lit(0.0), F.length("text").cast("double"), F.lit(1.0)).alias("rect"))
    return layout.annotation_rects(raw, ["USER", "System"]).select("doc_id", "page", F.col("rect")[0].alias("x0"), F.col("rect")[2].alias("x1"))


@query("q_qc_saved", f"WITH {_WRITTEN} SELECT count(*) AS total_matches, count(*) FILTER (written) AS written, count(*) FILTER (match_type = 'fuzzy') AS fuzzy, count(*) FILTER (placement_adjusted) AS adjusted FROM w")
def q_qc_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as a run's folder keeps it."""
    run = Session(spark, shared_folder(spark))
    run.save_report(output.qc_report(output.writable(matches(spark, sf_dir), annotations(spark, sf_dir), 6)))
    return run.load_report().select("total_matches", "written", F.col("counts_by_match_type.fuzzy").alias("fuzzy"), F.size("placement_adjusted_ids").cast("long").alias("adjusted"))


_BY_HAND = "SELECT p_partkey AS aseq, (p_partkey * 7) % 1999 + 1 AS fseq FROM <<part>>"


@query("q_manual_targets", f"WITH {AF_SQL}, px AS ({duck(_BY_HAND)}), {_RAW.format(pairs='px')} SELECT 'A' || aseq AS annotation_id, fid AS field_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM gc")
def q_manual_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, _BY_HAND, "part").select(F.concat(F.lit("A"), "aseq").alias("annotation_id"), F.concat(F.lit("F"), "fseq").alias("field_id"))
    return review.manual_targets(pairs, annotations(spark, sf_dir), fields(spark, sf_dir)).select("annotation_id", "field_id", *corners(F.col("target_rect")))


_HAND_TEXTS = f"px AS ({duck(_BY_HAND)}), pr AS (SELECT a.seq AS aseq, {_SORTED.format('a.anchor_text')} AS x, {_SORTED.format('f.label')} AS y, {_BONUS.format('a.visit', 'f.visit')} AS bonus FROM px JOIN a ON a.seq = px.aseq JOIN f ON f.seq = px.fseq), texts AS (SELECT DISTINCT x, y FROM pr)"


@query("q_predicted", f"WITH RECURSIVE {AF_SQL}, {_HAND_TEXTS}, {_LCS} SELECT aseq, CAST(least((raw + bonus) / 100, 1) AS DOUBLE) AS confidence FROM pr JOIN sim USING (x, y)")
def q_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotations(spark, sf_dir).select(F.col("seq").alias("aseq"), "anchor_text", F.col("visit").alias("avisit"))
    f = fields(spark, sf_dir).select(F.col("seq").alias("fseq"), "label", F.col("visit").alias("fvisit"))
    return review.predicted(view(spark, sf_dir, _BY_HAND, "part").join(a, "aseq").join(f, "fseq"), 5.0).select("aseq", "confidence")


@query(
    "q_confirmed",
    f"""WITH RECURSIVE {AF_SQL}, m AS ({M_SQL}), px AS (SELECT 7 AS aseq, 12 AS fseq), {_RAW.format(pairs='px')}, pr AS (SELECT {_SORTED.format('a.anchor_text')} AS x, {_SORTED.format('f.label')} AS y, {_BONUS.format('a.visit', 'f.visit')} AS bonus FROM a, f WHERE a.seq = 7 AND f.seq = 12), texts AS (SELECT x, y FROM pr), {_LCS}
SELECT m.seq, CASE WHEN gc.aseq IS NULL THEN m.field_id ELSE gc.fid END AS field_id, CASE WHEN gc.aseq IS NULL THEN m.match_type ELSE 'manual' END AS match_type, CASE WHEN gc.aseq IS NULL THEN m.status ELSE 'approved' END AS status,
 CAST(CASE WHEN gc.aseq IS NULL THEN m.confidence ELSE (SELECT least((raw + bonus) / 100, 1) FROM pr JOIN sim USING (x, y)) END AS DOUBLE) AS confidence, CAST(CASE WHEN gc.aseq IS NULL THEN m.x0 ELSE gc.x0 END AS DOUBLE) AS x0 FROM m LEFT JOIN gc ON gc.aseq = m.seq""",
)
def q_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.confirmed(matches(spark, sf_dir), annotations(spark, sf_dir), fields(spark, sf_dir), "A7", "F12", 5.0)
    return out.select("seq", "field_id", "match_type", "status", "confidence", F.col("target_rect")[0].alias("x0"))


@query("q_edit_delete", f"WITH f AS ({F_SQL}) SELECT seq, CASE WHEN id = 'F5' THEN 'edited' ELSE label END AS label, CASE WHEN id = 'F5' THEN page + 1 ELSE page END AS page FROM f WHERE id <> 'F6'")
def q_edit_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = {"label": F.lit("edited"), "page": F.col("page") + 1}
    return review.deleted(review.edited(fields(spark, sf_dir), "id", "F5", changes), "id", "F6").select("seq", "label", "page")


@query("q_record_counts", f"WITH {AF_SQL} SELECT 'annotations' AS kind, count(*) AS n FROM a UNION ALL SELECT 'fields', count(*) FROM f UNION ALL SELECT 'matches', count(*) FROM orders")
def q_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.record_counts(annotations=annotations(spark, sf_dir), fields=fields(spark, sf_dir), matches=matches(spark, sf_dir))


_STREAMS = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'q 0 0 1 rg' WHEN 1 THEN '1 0 0 RG 0.' || CAST(p_size AS STRING) || ' .5 1 RG S' WHEN 2 THEN CAST(p_size AS STRING) || ' 0 2 RG' WHEN 3 THEN '0 0.25 1.0 RG Q' END AS stream, CASE p_partkey % 4 WHEN 0 THEN CAST(90 * (p_size % 4) AS STRING) WHEN 1 THEN 'none' WHEN 2 THEN '' END AS turn FROM <<part>>"


@query(
    "q_stroke_rotation",
    f"""WITH s AS ({duck(_STREAMS).replace('STRING', 'VARCHAR')}), l AS (SELECT *, regexp_extract_all(stream, '[0-9.]+\\s+[0-9.]+\\s+[0-9.]+\\s+RG\\b')[-1] AS last FROM s),
c AS (SELECT *, CAST(nullif(split_part(last, ' ', 1), '') AS DOUBLE) AS r, CAST(nullif(split_part(last, ' ', 2), '') AS DOUBLE) AS gr, CAST(nullif(split_part(last, ' ', 3), '') AS DOUBLE) AS b FROM l)
SELECT p_partkey, CASE WHEN greatest(r, gr, b) <= 1 THEN r END AS r, CASE WHEN greatest(r, gr, b) <= 1 THEN gr END AS gr, CASE WHEN greatest(r, gr, b) <= 1 THEN b END AS b, coalesce(TRY_CAST(turn AS INT), 0) AS rotation FROM c""",
)
def q_stroke_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = style.stroke_rgb(F.col("stream"))
    return view(spark, sf_dir, _STREAMS, "part").select("p_partkey", rgb[0].alias("r"), rgb[1].alias("gr"), rgb[2].alias("b"), style.rotation(F.col("turn")).alias("rotation"))


@query("q_stable_ids", "SELECT l_orderkey, l_linenumber, l_partkey, sha256(l_orderkey || '/' || l_linenumber || '/' || l_returnflag) AS id FROM lineitem")
def q_stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t.stable_id(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")).alias("id"))


#: A later version: a word added here and there, pages without their last spans, and pages that are new.
_LATER = "SELECT doc_id, page, seq, CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 AND seq = 4 THEN text || ' (new)' ELSE text END AS text FROM <<spans>> WHERE NOT (CAST(doc_id AS BIGINT) % 5 = 1 AND page = 2) UNION ALL SELECT doc_id, page + 1000, seq, text FROM <<spans>> WHERE CAST(doc_id AS BIGINT) % 7 = 2"


@query(
    "q_changed_pages",
    f"""WITH {SPANS_SQL}, later AS ({duck(_LATER)}), o AS (SELECT doc_id, page, md5(string_agg(seq || ':' || text, chr(0) ORDER BY seq)) AS h FROM spans GROUP BY 1, 2), n AS (SELECT doc_id, page, md5(string_agg(seq || ':' || text, chr(0) ORDER BY seq)) AS h FROM later GROUP BY 1, 2)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.page, n.page) AS page, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.page = n.page WHERE o.h IS DISTINCT FROM n.h""",
)
def q_changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).select("doc_id", "page", "seq", "text")
    later = spark.sql(_LATER.replace("<<spans>>", "{spans}"), spans=s)
    return versions.changed_pages(stored(versions.page_prints(s)), stored(versions.page_prints(later)))


_CHANGES = "SELECT 'F' || CAST(o_custkey AS STRING) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'put' END AS op, o_orderkey AS row, o_orderpriority AS label, o_orderstatus AS form_name FROM <<orders>> WHERE o_orderkey % 3 = {k}"
_FIRST = "SELECT 'F' || CAST(p_partkey AS STRING) AS id, p_name AS label, p_brand AS form_name FROM <<part>>"


@query(
    "q_snapshot_as_of",
    f"""WITH b AS ({duck(_FIRST)}), c AS ({' UNION ALL '.join(f'SELECT *, {k + 1} AS version FROM ({duck(_CHANGES).format(k=k)})' for k in range(2))}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, row DESC) AS r FROM c) WHERE r = 1)
SELECT id, label, form_name FROM b WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT id, label, form_name FROM l WHERE op = 'put'""".replace("STRING", "VARCHAR"),
)
def q_snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sets of edits, read as of the second."""
    log = ChangeLog.created(view(spark, sf_dir, _FIRST, "part"), shared_folder(spark))
    for k in range(3):
        log.append(view(spark, sf_dir, _CHANGES.format(k=k), "orders"))
    return log.as_of(2)


def entry(spark: SparkSession) -> DataFrame:
    """How many annotations each pass links, over the smallest tables."""
    return q_cascade_counts(spark, "/root/testdata/sf0.001")
