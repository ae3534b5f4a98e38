"""Records as JSON arrays and as CSV, and page texts from PDF files where a reader for them is installed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.functions.text import page_number

RECT = "array<double>"
STYLE = "struct<font:string,font_size:double,text_color:array<double>,border_color:array<double>,fill_color:array<double>,border_width:double,border_dashes:array<int>>"
SPANS = f"doc_id string, page int, seq bigint, text string, font_size double, bold boolean, rect {RECT}"
RAW_ANNOTATIONS = (
    f"doc_id string, page int, seq bigint, subtype string, content string, subject string, rect {RECT}, rotation string, da string, rc string, "
    "stroke array<double>, border_width double, border_dashes array<int>, ap_stream string"
)
PAGE_DIMS = "doc_id string, page int, width double, height double"
ANNOTATIONS = (
    f"id string, page int, content string, domain string, category string, matched_rule string, rect {RECT}, anchor_text string, anchor_rect {RECT}, form_name string, visit string, style {STYLE}, rotation int"
)
FIELDS = f"id string, page int, label string, form_name string, visit string, rect {RECT}, field_type string, page_width double, page_height double"
MATCHES = f"annotation_id string, field_id string, match_type string, confidence double, target_rect {RECT}, target_page int, status string, user_notes string, placement_adjusted boolean"
KINDS = {"annotations": ANNOTATIONS, "fields": FIELDS, "matches": MATCHES}

# Cells that the usual CSV reader takes for missing ones.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def schema(kind: str) -> T.StructType:
    return T._parse_datatype_string(KINDS[kind])


def numbered(rows: DataFrame, name: str = "seq") -> DataFrame:
    """With the order of the rows of one file, from 0: the reader keeps it, and an array file or a multi-line CSV is read by one task."""
    return rows.select("*", F.monotonically_increasing_id().alias(name))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of a JSON array or of JSON lines, with seq: as stored, or else the order in the file. A path that isn't there is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    first = spark.read.text(path).where("trim(value) <> ''").first()
    whole = bool(first and first["value"].lstrip().startswith("["))
    rows = numbered(spark.read.schema(schema(kind).add("seq", T.LongType())).option("multiLine", whole).json(path), "_at")
    return rows.withColumn("seq", F.coalesce("seq", "_at")).drop("_at")


def save_json(records: DataFrame, path: str, kind: str) -> None:
    """Overwrites ``path`` with the records and their seq, so their order doesn't depend on how files are read."""
    rows = records if "seq" in records.columns else numbered(records)
    rows.orderBy("seq").select(*schema(kind).names, F.col("seq").cast("long").alias("seq")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _text(f: T.StructField) -> Column:
    if isinstance(f.dataType, (T.ArrayType, T.StructType)):
        return F.coalesce(F.to_json(F.col(f.name), {"ignoreNullFields": "false"}), F.lit("null")).alias(f.name)
    return F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name)


def export_csv(records: DataFrame, path: str, kind: str) -> None:
    """Nested values are JSON text; a field id that is null is an empty cell. Quotes are doubled, so any text comes back."""
    rows = records.orderBy("seq") if "seq" in records.columns else records
    columns = [_text(f) for f in schema(kind).fields]
    rows.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _value(f: T.StructField) -> Column:
    cell = F.col(f.name)
    c = F.when(cell.isNull() | cell.isin(*MISSING), F.lit("")).otherwise(cell)
    if isinstance(f.dataType, (T.ArrayType, T.StructType)):
        return F.from_json(F.when(c != "", c), f.dataType).alias(f.name)
    if f.name in ("page", "target_page"):
        return page_number(c).alias(f.name) if f.name == "page" else F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0)).alias(f.name)
    if isinstance(f.dataType, T.StringType):
        return c.alias(f.name)
    return c.try_cast(f.dataType).alias(f.name)


def import_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a CSV file with ``row``, their order; missing columns are empty."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    fields = schema(kind).fields
    have = numbered(raw, "row")
    have = have.select("row", *[F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string").alias(f.name) for f in fields])
    return have.select(*[_value(f) for f in fields], "row")


def read_pdf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, raw annotations, page sizes) of PDF files, each file read whole by one task. Needs PyMuPDF on the executors."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading PDF files needs PyMuPDF; give tables of spans, annotations and page sizes instead") from e
    from quillmatch.sources.pdf import read

    return read(spark, path)
