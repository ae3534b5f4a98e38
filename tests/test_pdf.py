"""The PDF adapter with a stand-in for its reader."""

import json
import sys
import types

from pyspark.sql import functions as F

from quillmatch.functions.style import parsed_style
from quillmatch.plans.profile import with_rule, without_rule
from quillmatch.sources import pdf


class Note:
    def __init__(self, xref):
        self.xref, self.type, self.rect = xref, (2, "FreeText"), (1.0, 2.0, 3.0, 4.0)
        self.info, self.colors, self.border = {"content": "DM", "subject": "S"}, {"stroke": ()}, {"width": 1.5, "dashes": ()}


class Page:
    def __init__(self):
        self.rect = types.SimpleNamespace(width=595.0, height=842.0)
        self.notes = [Note(7), Note(8)]

    def annots(self):
        return iter(self.notes)

    @property
    def first_annot(self):
        return self.notes[0] if self.notes else None

    def delete_annot(self, note):
        self.notes.remove(note)

    def get_text(self, kind):
        return {"blocks": [{"type": 0, "lines": [{"spans": [{"text": " Sex ", "font": "Arial-Bold", "size": 9.0, "flags": 0, "bbox": (0, 1, 2, 3)}, {"text": " "}]}]}, {"type": 1}]}


class Document:
    keys = {(7, "DA"): ("string", "0 0 1 rg /Arial 9 Tf"), (7, "AP/N"): ("xref", "12 0 R"), (8, "Rotate"): ("int", "90")}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def __iter__(self):
        return iter([Page()])

    def xref_get_key(self, xref, name):
        return self.keys.get((xref, name), ("null", "null"))

    def xref_stream(self, xref):
        return b"1 0 0 RG 0 0 10 10 re S" if xref == 12 else None


def test_facts_of_a_page(monkeypatch, spark):
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda **_: Document()))
    facts = [(kind, json.loads(fact)) for kind, _, fact in pdf._facts("a.pdf", b"")]
    assert [k for k, _ in facts] == ["dims", "raw", "raw", "spans"]
    one, two = (f for k, f in facts if k == "raw")
    assert one["ap_stream"] == "1 0 0 RG 0 0 10 10 re S" and one["da"] == "0 0 1 rg /Arial 9 Tf" and one["rc"] == "" and one["border_width"] == 1.5
    assert two["ap_stream"] == "" and two["rotation"] == "90" and two["da"] == ""
    assert facts[-1][1]["text"] == "Sex" and facts[-1][1]["bold"]
    row = spark.createDataFrame([(one["da"], one["rc"], one["ap_stream"])], "da string, rc string, ap string")
    none = F.lit(None)
    style = row.select(parsed_style(F.col("da"), F.col("rc"), none.cast("array<double>"), none.cast("double"), none.cast("array<int>"), F.col("ap"), "Arial", 10.0, None).alias("s")).first()["s"]
    assert style["border_color"] == [1.0, 0.0, 0.0] and style["text_color"] == [0.0, 0.0, 1.0]


def test_edits_of_rules():
    assert with_rule([1, 2], 3) == [1, 2, 3] and with_rule([1, 2], 3, 0) == [3, 2] and without_rule([1, 2], 0) == [2]
