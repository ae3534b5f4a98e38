"""PDF files as tables, by PyMuPDF on the executors. Only imported where it is installed."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.operators.graph import stored
from quillmatch.sources.records import PAGE_DIMS, RAW_ANNOTATIONS, SPANS

BOLD_BIT = 16


def _key(doc: object, xref: int, name: str) -> str:
    """A key of an object as text; empty where it isn't there."""
    kind, value = doc.xref_get_key(xref, name)
    return "" if kind == "null" else value


def _appearance(doc: object, xref: int) -> str:
    """The normal appearance stream of an annotation."""
    kind, value = doc.xref_get_key(xref, "AP/N")
    return (doc.xref_stream(int(value.split()[0])) or b"").decode("latin-1") if kind == "xref" else ""


def _facts(path: str, content: bytes) -> Iterator[tuple[str, str, str]]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for number, page in enumerate(doc, 1):
            yield "dims", path, json.dumps({"doc_id": path, "page": number, "width": page.rect.width, "height": page.rect.height})
            for seq, a in enumerate(list(page.annots() or ())):
                da, rc, turn = (_key(doc, a.xref, name) for name in ("DA", "RC", "Rotate"))
                row = {
                    "doc_id": path, "page": number, "seq": seq, "subtype": a.type[1], "content": a.info.get("content", ""), "subject": a.info.get("subject", ""),
                    "rect": list(a.rect), "rotation": turn, "da": da, "rc": rc, "stroke": a.colors.get("stroke"), "border_width": a.border.get("width"),
                    "border_dashes": list(a.border.get("dashes") or ()), "ap_stream": _appearance(doc, a.xref),
                }
                yield "raw", path, json.dumps(row)
            while a := page.first_annot:
                page.delete_annot(a)
            seq = 0
            for block in page.get_text("dict")["blocks"]:
                for line in block.get("lines", ()) if block.get("type") == 0 else ():
                    for span in line["spans"]:
                        if text := span["text"].strip():
                            bold = bool(span.get("flags", 0) & BOLD_BIT) or "bold" in span.get("font", "").lower()
                            yield "spans", path, json.dumps({"doc_id": path, "page": number, "seq": seq, "text": text, "font_size": span.get("size", 10.0), "bold": bold, "rect": list(span["bbox"])})
                            seq += 1


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(_facts(p, content), columns=["kind", "path", "fact"])

    # Stored, so that each file is parsed once for all three tables.
    facts = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "kind string, path string, fact string")
    facts = stored(facts)
    return tuple(facts.where(F.col("kind") == k).select(F.from_json("fact", s).alias("x")).select("x.*") for k, s in (("spans", SPANS), ("raw", RAW_ANNOTATIONS), ("dims", PAGE_DIMS)))
