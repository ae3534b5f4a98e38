import pytest
from pyspark.sql import functions as F

from quillmatch.operators import review
from quillmatch.plans import catalogue
from quillmatch.sources import records
from quillmatch.sources.session import Session, fingerprint, valid_name

ROW = ("f1", 2, 'a "quoted", \n label', "", "Week 1", [1.5, 2.0, 3.0, 4.0], "checkbox", 595.0, 842.0)


def fields(spark, *rows):
    return records.numbered(spark.createDataFrame(list(rows), records.FIELDS).coalesce(1))


def test_csv_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/f.csv"
    records.export_csv(fields(spark, ROW), path, "fields")
    (got,) = records.import_csv(spark, path, "fields").drop("row").collect()
    assert tuple(got) == ROW


def test_csv_missing_cells(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,page,label,rect\n,abc,NA,null\nf1,2.0,ok,\"[1,2,3,4]\"\n")
    a, b = records.import_csv(spark, f"file://{tmp_path}/x.csv", "fields").orderBy("row").collect()
    assert (a["id"], a["page"], a["label"], a["rect"], a["form_name"]) == ("", 1, "", None, "") and (b["page"], b["rect"]) == (2, [1.0, 2.0, 3.0, 4.0])


def test_upsert(spark):
    have = fields(spark, ROW, ("f2", 1, "two", "", "", [0.0] * 4, "checkbox", 0.0, 0.0))
    new = spark.createDataFrame([("f1", 3, "first", "", "", [0.0] * 4, "checkbox", 0.0, 0.0, 0), ("f1", 4, "last", "", "", [0.0] * 4, "checkbox", 0.0, 0.0, 1), ("", 5, "new", "", "", [0.0] * 4, "checkbox", 0.0, 0.0, 2), ("zz", 6, "unknown", "", "", [0.0] * 4, "checkbox", 0.0, 0.0, 3)], records.FIELDS + ", row bigint")
    out, missing = review.upsert(have, new)
    assert [(r["label"], r["page"]) for r in out.orderBy("seq").collect()] == [("last", 4), ("two", 1), ("new", 5)]
    assert [r["id"] for r in missing.collect()] == ["f2"]


def test_json_and_session(spark, tmp_path):
    s = Session(spark, tmp_path, "session_one")
    f = fields(spark, ROW)
    s.save(f, "fields")
    assert [tuple(r)[:-1] for r in s.load("fields").collect()] == [ROW]
    with pytest.raises(FileNotFoundError):
        s.load("matches")
    (tmp_path / "array.json").write_text('[\n {"id": "f1", "page": 1, "rect": [1, 2, 3, 4]},\n {"id": "f2"}\n]')
    assert [r["id"] for r in records.load_json(spark, f"file://{tmp_path}/array.json", "fields").orderBy("seq").collect()] == ["f1", "f2"]
    s.log("start", {"n": 1})
    s.log("end", {"action": "stop"})
    assert [r["action"] for r in s.audit().collect()] == ["start", "stop"]
    s.complete(1, "x")
    s.complete(2)
    s.complete(3)
    s.complete(1, "y")
    assert s.is_complete(2) and not s.is_complete(3) and not s.is_complete(1, "x") and s.unlocked(3) and not s.unlocked(4)
    assert fingerprint(f) == fingerprint(f.repartition(3))
    s.save(spark.createDataFrame([], records.ANNOTATIONS), "annotations")
    assert Session.latest(spark, tmp_path).name == "session_one" and Session.names(tmp_path) == ["session_one"]
    Session.delete(Session.rename(s.folder, "session_two"))
    assert Session.names(tmp_path) == [] and not valid_name("session_a/b") and not valid_name("x")


def test_order_of_several_files(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('f', id) AS id", "1 AS page", "'x' AS label", "'' AS form_name", "'' AS visit", "array(1.0D) AS rect", "'checkbox' AS field_type", "0.0D AS page_width", "0.0D AS page_height", "id AS seq")
    records.save_json(rows.repartition(9, "id"), f"file://{tmp_path}/many", "fields")
    assert [r["id"] for r in records.load_json(spark, f"file://{tmp_path}/many", "fields").orderBy("seq").collect()] == [f"f{k}" for k in range(500)]
    null = rows.withColumn("id", F.when(F.col("seq") > 0, F.col("id")))
    assert review.deleted(null, "id", "f3").count() == 499


def test_stream_of_the_log(spark, tmp_path):
    from quillmatch.streaming.audit import action_counts, append, stream_log

    for action in ("a", "b", "a"):
        append(spark, f"{tmp_path}/log", action, {})
    q = action_counts(stream_log(spark, f"{tmp_path}/log"), "1 day").writeStream.outputMode("complete").format("memory").queryName("log").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["action"], r["n"]) for r in spark.table("log").groupBy("action").sum("n").toDF("action", "n").collect()} == {("a", 2), ("b", 1)}


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    import glob
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    df = catalogue.QUERIES[name](spark, sf)
    want = con.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert rows == sorted(repr(r) for r in want.fetchall())
