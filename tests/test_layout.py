from pyspark.sql import functions as F

from quillmatch.operators import layout
from quillmatch.plans.profile import profile_of, standard_profile

SPANS = "doc_id string, page int, seq bigint, text string, font_size double, bold boolean, rect array<double>"


def spans(spark, *rows):
    return spark.createDataFrame([("d", p, k, t, s, b, [x, y, x + 80.0, y + 10.0]) for k, (p, t, s, b, x, y) in enumerate(rows)], SPANS)


def dims(spark, pages=1):
    return spark.createDataFrame([("d", p, 595.0, 842.0) for p in range(1, pages + 1)], "doc_id string, page int, width double, height double")


def profile(**rules):
    return profile_of({"meta": {"name": "t"}, "domain_codes": [], "classification_rules": [], "form_name_rules": {"min_font_size": 6.5} | rules})


def name(df):
    return {r["page"]: r["form_name"] for r in df.collect()}


def test_form_name_prefers_bold_then_size(spark):
    s = spans(spark, (1, "small", 10.0, True, 50.0, 30.0), (1, "BIG", 36.0, True, 50.0, 200.0), (2, "plain", 36.0, False, 50.0, 20.0), (2, "bold", 8.0, True, 50.0, 40.0))
    assert name(layout.form_names(s, profile())) == {1: "BIG", 2: "bold"}


def test_form_name_region_exclusion_and_prefix(spark):
    s = spans(spark, (1, "CDISC", 20.0, True, 50.0, 10.0), (1, "Vitals", 12.0, True, 50.0, 40.0), (1, "Form : Heart", 8.0, False, 50.0, 800.0), (1, "FOOT", 30.0, True, 50.0, 800.0))
    assert name(layout.form_names(s, standard_profile(), dims(spark))) == {1: "Vitals"}
    assert name(layout.form_names(s, profile(label_prefix="Form:"))) == {1: "Heart"}


def test_top_left_block(spark):
    s = spans(spark, (1, "right", 20.0, True, 300.0, 5.0), (1, "left", 5.0, False, 50.0, 30.0), (1, "lower", 20.0, True, 60.0, 60.0))
    assert name(layout.form_names(s, profile(strategy="top_left_block"))) == {1: "left"}


def test_nearest_label(spark):
    m = spans(spark, (1, "____", 10.0, False, 300.0, 100.0))
    b = spans(spark, (1, "far", 10.0, False, 50.0, 300.0), (1, "near", 10.0, False, 50.0, 98.0), (1, "nearer but right", 10.0, False, 250.0, 100.0))
    assert [r["label"] for r in layout.nearest_labels(m, b, standard_profile()).collect()] == ["near"]
    assert [r["label"] for r in layout.nearest_labels(m, b.where("text = 'far'"), standard_profile(), 30.0).collect()] == [""]


def test_markers(spark):
    texts = ["MM/DD/YYYY", "12/31/2024", "Yes / No", "y/n", "☐ a", "Name ___", "Sex: Yes / No", "__"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["m"] for r in df.select(layout.marker_type(F.col("t")).alias("m")).collect()]
    assert got == ["date_field", "date_field", "checkbox", "checkbox", "checkbox", "text_field", None, None]


def test_fields_of_a_page(spark):
    s = spans(
        spark,
        (1, "DEMOGRAPHICS", 18.0, True, 50.0, 50.0), (1, "Subject ID: ____", 10.0, False, 50.0, 100.0), (1, "Birth", 5.0, False, 50.0, 130.0), (1, "MM/DD/YYYY", 10.0, False, 200.0, 130.0),
        (2, "Codelist: x", 10.0, False, 50.0, 20.0), (2, "DATA", 18.0, True, 50.0, 90.0), (3, "Baseline", 10.0, False, 50.0, 30.0),
    )
    got = {(r["page"], r["field_type"], r["label"], r["form_name"], r["visit"]) for r in layout.fields_of(s, dims(spark, 3), standard_profile()).collect()}
    assert got == {
        (1, "section_header", "DEMOGRAPHICS", "DEMOGRAPHICS", ""), (1, "text_field", "Birth", "DEMOGRAPHICS", ""), (1, "date_field", "Birth", "DEMOGRAPHICS", ""), (3, "section_header", "Baseline", "Baseline", "Baseline"),
    }


def test_overlap_is_with_one_rectangle(spark):
    s = spans(spark, (1, "half", 10.0, False, 0.0, 0.0), (1, "twice a quarter", 10.0, False, 0.0, 100.0))
    r = spark.createDataFrame([("d", 1, [0.0, 0.0, 40.0, 10.0]), ("d", 1, [0.0, 100.0, 20.0, 110.0]), ("d", 1, [60.0, 100.0, 80.0, 110.0])], "doc_id string, page int, rect array<double>")
    assert [x["text"] for x in layout.without_annotated(s, r).collect()] == ["twice a quarter"]


def test_annotations(spark):
    raw = spark.createDataFrame(
        [("d", 1, 0, "FreeText", "BRTHDTC", "DM", [150.0, 90.0, 350.0, 110.0], "0", "/Helv 18 Tf 1 0 0 rg", "color:#00ff00", None, 0.0, None, "0 0 1 RG"), ("d", 1, 1, "Text", "sticky", "", [0.0, 0.0, 1.0, 1.0], None, "", "", None, None, None, ""), ("d", 1, 2, "FreeText", "  ", "DM", [0.0, 0.0, 1.0, 1.0], "x", "", "", None, None, None, "")],
        "doc_id string, page int, seq bigint, subtype string, content string, subject string, rect array<double>, rotation string, da string, rc string, stroke array<double>, border_width double, border_dashes array<int>, ap_stream string",
    )
    s = spans(spark, (1, "DEMOGRAPHICS", 18.0, True, 50.0, 50.0), (1, "Date of Birth", 10.0, False, 50.0, 98.0))
    (r,) = layout.annotations_of(raw, s, standard_profile(), dims(spark)).collect()
    assert (r["content"], r["category"], r["anchor_text"], r["form_name"], r["rotation"]) == ("BRTHDTC", "sdtm_mapping", "Date of Birth", "DEMOGRAPHICS", 0)
    assert (r["style"]["font"], r["style"]["font_size"], r["style"]["text_color"], r["style"]["border_color"], r["style"]["border_width"]) == ("Helv", 18.0, [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], 1.0)


def test_nested_spans(spark):
    df = spark.createDataFrame(
        [("d", 1, [(0, [([(" a ", 9.0, 16, "F", [0.0, 0.0, 1.0, 1.0]), ("  ", 9.0, 0, "F", [0.0, 0.0, 1.0, 1.0])],)]), (1, [([("image", 1.0, 0, "F", [0.0] * 4)],)]), (0, [([("b", None, 0, "X-Bold", [0.0] * 4)],)])])],
        "doc_id string, page int, blocks array<struct<type:int,lines:array<struct<spans:array<struct<text:string,size:double,flags:int,font:string,bbox:array<double>>>>>>>",
    )
    assert [(r["seq"], r["text"], r["font_size"], r["bold"]) for r in layout.text_spans(df).orderBy("seq").collect()] == [(0, "a", 9.0, True), (1, "b", 10.0, True)]
