"""Many pairs of documents at once, the fuzzy index, assignment by classes, scans and joins by place, against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmatch.functions import text
from quillmatch.operators import assignment, layout, matching, near, scan
from quillmatch.plans.profile import Matching, profile_of, standard_profile

RAW = "doc_id string, page int, seq bigint, subtype string, content string, subject string, rect array<double>, rotation string, da string, rc string, stroke array<double>, border_width double, border_dashes array<int>, ap_stream string"
SPANS = "doc_id string, page int, seq bigint, text string, font_size double, bold boolean, rect array<double>"
DIMS = "doc_id string, page int, width double, height double"


def ratio(a, b):
    return 100.0 if not a and not b else 200 * text.lcs_length(a, b) / (len(a) + len(b))


def labels(rng, n):
    words = ["heart", "rate", "date", "of", "birth", "sex", "weight", "visit", "é", "start date", "adverse", "event", "aaaa"]
    made = {" ".join(sorted(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))).split())) for _ in range(n)}
    return [x + rng.choice(["", "s", "xy", " 12"]) for x in made] + ["", "a", "aa"]


@pytest.mark.parametrize("direct", [0, 10**9])
def test_near_pairs_lose_none(spark, monkeypatch, direct):
    monkeypatch.setattr(near, "DIRECT", direct)
    rng = random.Random(1)
    x, y = ([(k, s) for k in ("p", "q") for s in labels(rng, 90)] for _ in range(2))
    one, two = spark.createDataFrame(x + x[:9], "k string, _a string"), spark.createDataFrame(y + y[:9], "k string, _f string")
    for least in (85.0, 60.0):
        got = [(r["k"], r["_a"], r["_f"], round(r["_raw"], 9)) for r in near.near_pairs(one, two, ["k"], least).collect()]
        want = {(k, a, f, round(ratio(a, f), 9)) for k, a in x for j, f in y if j == k and ratio(a, f) >= least}
        assert len(got) == len(set(got)) and set(got) == want
    empty = one.limit(0)
    assert near.near_pairs(empty, two, ["k"], 85.0).count() == 0


def test_few_candidates_are_verified(spark):
    rng = random.Random(2)
    say = lambda: " ".join(sorted("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(2, 5))))
    x = [say() for _ in range(400)]
    y = [a[:-1] + "s" for a in x[:200]] + [say() for _ in range(200)]
    frame = lambda rows, c: spark.createDataFrame([("p", s) for s in rows], f"k string, {c} string")
    r = near.effort(frame(x, "_a"), frame(y, "_f"), ["k"], 85.0).first()
    assert r["pairs"] == 160_000 and r["links"] >= 190 and r["verified"] <= r["met"] < 0.5 * r["pairs"] and r["verified"] < 50 * r["links"]


def problem(rng, a, f, scores):
    """Class edges, members, and the same as records."""
    one = {c: np.array(sorted(rng.sample(range(100), rng.randint(0, 4)))) for c in range(a)}
    two = {d: np.array(sorted(rng.sample(range(100), rng.randint(0, 4)))) for d in range(f)}
    taken = set()
    for members in (one, two):
        taken.clear()
        for k, v in members.items():
            members[k] = np.array([x for x in v if x not in taken], np.int64)
            taken.update(v.tolist())
    edges = {c: [(d, float(rng.choice(scores))) for d in range(f) if rng.random() < 0.6] for c in range(a)}
    records = [(int(x), int(y), s) for c, near_ in edges.items() for d, s in near_ for x in one[c] for y in two[d]]
    return edges, one, two, pd.DataFrame(records, columns=["aseq", "fseq", "score"])


def test_classes_give_what_records_give():
    rng = random.Random(3)
    for k in range(300):
        edges, one, two, records = problem(rng, rng.randint(1, 5), rng.randint(1, 5), [80, 81, 90] if k % 2 else range(80, 106))
        want = assignment.greedy_pairs(records)
        assert sorted(assignment.greedy_classes(edges, one, two)) == sorted(zip(want["aseq"], want["fseq"], want["score"], strict=True))
        best = assignment.optimal_classes(edges, one, two)
        scores = {(a, f): s for a, f, s in records.itertuples(index=False)}
        assert all(scores[a, f] == s for a, f, s in best)
        assert len({a for a, _, _ in best}) == len({f for _, f, _ in best}) == len(best)
        assert np.isclose(sum(s for _, _, s in best), assignment.optimal_pairs(records)["score"].sum() if len(records) else 0)


def test_hot_classes_need_no_pairs():
    n = 100_000
    same = {0: [(0, 100.0), (1, 90.0)], 1: [(0, 100.0)]}
    one, two = {0: np.arange(0, n, 2), 1: np.arange(1, n, 2)}, {0: np.arange(0, 60_000), 1: np.arange(60_000, 120_000)}
    for solve in (assignment.greedy_classes, assignment.optimal_classes):
        found = solve(same, one, two)
        assert len({f for _, f, _ in found}) == len(found) and sum(s for *_, s in found) == (60_000 * 100 + 20_000 * 90 if solve is assignment.greedy_classes else 60_000 * 100 + 40_000 * 90)


def test_greedy_in_blocks(spark):
    rng = random.Random(4)
    cells = [(p, 7, a << 32, 3 * f, float(rng.randint(80, 84))) for p in ("x", "y") for a in range(30) for f in range(25) if rng.random() < 0.4]
    edges = spark.createDataFrame(cells, "pair string, g long, aseq long, fseq long, score double")
    got = [tuple(r) for r in assignment.assigned(edges, "greedy", most=60).collect()]
    want = []
    for p in ("x", "y"):
        one = assignment.greedy_pairs(pd.DataFrame([c[2:] for c in cells if c[0] == p], columns=["aseq", "fseq", "score"]))
        want += [(p, *x) for x in zip(one["aseq"], one["fseq"], one["score"], strict=True)]
    assert sorted(got) == sorted(want)


def plain_rows(rows):
    out, row, before = {}, 0, None
    for page, y, seq in sorted(rows):
        if before and (page != before[0] or abs(y - before[1]) > 5):
            row += 1
        before = (page, y)
        out[seq] = row
    return out


def plain_kept(rows):
    out, last = {}, None
    for page, y, seq in sorted(rows):
        if last is None or page != last[0] or abs(y - last[1]) > 5:
            last = (page, y)
            out[seq] = len(out)
    return out


def test_scans_of_a_hot_key(spark):
    rng = random.Random(5)
    groups = {"hot": 900, "small": 7, "one": 1}
    rows = [(k, rng.randint(1, 4), float(rng.choice([rng.randint(0, 840), rng.randint(0, 3000) / 10])), 1000 * j + i) for j, (k, n) in enumerate(groups.items()) for i in range(n)]
    rows += [(None, 1, 3.0, 9000), (None, 1, 9.0, 9001), ("neg", 1, -70.0, 9100), ("neg", 1, -64.0, 9101), ("neg", 1, 2.0, 9102)]
    frame = spark.createDataFrame(rows, "k string, page int, y0 double, seq long")
    got = {r["seq"]: r["row"] for r in scan.with_rows(frame, ["k"]).collect()}
    kept = [(r["seq"], r["pos"]) for r in scan.kept_rows(frame, ["k"]).collect()]
    want_rows, want_kept = {}, {}
    for k in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == k]
        want_rows |= plain_rows(own)
        want_kept |= plain_kept(own)
    assert got == want_rows and len(kept) == len(want_kept) and dict(kept) == want_kept
    assert scan.kept_rows(frame.limit(0), ["k"]).collect() == []


def test_running_sums_of_a_hot_key(spark):
    rows = [("a", 1 + i % 3, float(i * 7 % 400), i, i % 5) for i in range(300)]
    frame = scan.segmented(spark.createDataFrame(rows, "k string, page int, y0 double, seq long, v int"))
    got = {r["seq"]: r["upto"] for r in scan.with_running(frame, ["k"], F.col("v"), "upto").collect()}
    total, want = 0, {}
    for _, _, _, seq, v in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        total += v
        want[seq] = total
    assert got == want


def gap(a, b):
    return max(0.0, max(a[1], b[1]) - min(a[3], b[3]))


@pytest.mark.parametrize("most", [None, 30.0])
def test_nearest_label_by_bands(spark, most):
    rng = random.Random(6)
    rect = lambda x, y: [x, y, x + 80.0, y + rng.choice([0.0, 10.0, 90.0])]
    blocks = [("d", p, k, f"w{k}" if k % 7 else " ", 10.0, False, rect(rng.choice([10.0, 40.0, 300.0]), float(rng.randint(0, 60) if p == 2 else rng.randint(-50, 900)))) for p in (1, 2, 3) for k in range(40 if p < 3 else 1)]
    marks = [("d", p, 100 + k, rect(200.0, float(rng.randint(-100, 1500)))) for p in (1, 2, 3, 4) for k in range(25)]
    profile = standard_profile()
    out = layout.nearest_labels(spark.createDataFrame(marks, "doc_id string, page int, seq bigint, rect array<double>"), spark.createDataFrame(blocks, SPANS), profile, most)
    got = {(r["page"], r["seq"]): r["label"] for r in out.collect()}
    for _, page, seq, m in marks:
        own = [b for b in blocks if b[1] == page]
        edge = min((b[6][0] for b in own), default=0) + profile.anchor_text_config.left_column_tolerance_px
        near_ = [(gap(m, b[6]), abs((b[6][1] + b[6][3]) / 2 - m[1]), b[2], b[3]) for b in own if b[6][0] <= edge and b[3].strip() and (most is None or gap(m, b[6]) <= most)]
        assert got[page, seq] == (min(near_)[3] if near_ else ""), (page, seq)


def test_overlap_by_tiles(spark):
    rng = random.Random(7)
    rect = lambda: (lambda x, y: [x, y, x + rng.choice([0.0, 5.0, 60.0, 300.0]), y + rng.choice([4.0, 12.0, 200.0])])(rng.randint(-80, 500) / 1.0, rng.randint(-80, 700) / 1.0)
    spans = [("d", p, k, "t", 10.0, False, rect()) for p in (1, 2) for k in range(80)]
    rects = [("d", 1, rect()) for _ in range(60)] + [("e", 2, rect()) for _ in range(5)]

    def share(a, b):
        area = (a[2] - a[0]) * (a[3] - a[1])
        w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return w * h / area if area > 0 else 0.0

    for least in (0.3, 0.9):
        got = {(r["page"], r["seq"]) for r in layout.without_annotated(spark.createDataFrame(spans, SPANS), spark.createDataFrame(rects, "doc_id string, page int, rect array<double>"), least).collect()}
        want = {(s[1], s[2]) for s in spans if not any(r[:2] == s[:2] and share(s[6], r[2]) >= least for r in rects)}
        assert got == want and 0 < len(want) < len(spans)


def test_places_repeat_on_pages_and_in_documents(spark):
    """The way from spans and raw annotations to links: places start again on every page, and documents have pages of one number."""
    line = lambda doc, page, seq, said, y: (doc, page, seq, said, 12.0, seq == 0, [50.0, float(y), 150.0, y + 12.0])
    note = lambda doc, page, y: (doc, page, 0, "FreeText", f"DM.{page}", "DM", [200.0, float(y), 260.0, y + 10.0], "0", "", "", None, None, None, "")
    spans = [x for d in ("one", "two") for p in (1, 2) for x in (line(d, p, 0, f"Form {p}", 20), line(d, p, 1, f"Question {d} {p}", 300), line(d, p, 2, "____", 302))]
    raw = [note(d, p, 301) for d in ("one", "two") for p in (1, 2)]
    s = spark.createDataFrame(spans, SPANS)
    dims = spark.createDataFrame([(d, p, 595.0, 842.0) for d in ("one", "two") for p in (1, 2)], DIMS)
    profile = profile_of({"meta": {"name": "x"}, "domain_codes": [], "classification_rules": []})
    a, f = layout.annotations_of(spark.createDataFrame(raw, RAW), s, profile, dims), layout.fields_of(s, dims, profile)
    assert a.select("doc_id", "seq").distinct().count() == a.count() == 4 and f.select("doc_id", "seq").distinct().count() == f.count()
    out = matching.match_annotations(a, f, dims, dims, Matching()).collect()
    named = {r["id"]: (r["doc_id"], r["page"], r["label"]) for r in f.collect()}
    assert len(out) == 4 and {(r["pair"], r["match_type"], *named[r["field_id"]]) for r in out} == {(d, "exact", d, p, f"Question {d} {p}") for d in ("one", "two") for p in (1, 2)}
    # A document in several pairs: "one" with itself and with "two".
    pairs = spark.createDataFrame([("same", "one", "one"), ("other", "one", "two")], "pair string, source string, target string")
    out = matching.match_annotations(a, f, dims, dims, Matching(), pairs=pairs).collect()
    assert len(out) == 4 and {(r["pair"], named[r["field_id"]][0] if r["field_id"] else None) for r in out} == {("same", "one"), ("other", "two")}
    assert {r["match_type"] for r in out if r["pair"] == "same"} == {"exact"} and "exact" not in {r["match_type"] for r in out if r["pair"] == "other"}


def test_nothing_that_grows_is_broadcast(spark, tmp_path, monkeypatch):
    """Files of few bytes may hold millions of rows; only the page sizes, nine rows that the query makes, may go through the driver."""
    from quillmatch.operators import assignment, graph, near
    from quillmatch.plans import catalogue

    spark.sql("SELECT id AS l_orderkey, id % 40 AS l_partkey, id % 3 AS l_suppkey, CAST(id % 7 AS INT) AS l_linenumber, 1.0D AS l_extendedprice, 1.0D AS l_quantity FROM range(600)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS p_partkey, concat('name ', id % 9, ' of ', id) AS p_name, 'Brand#1' AS p_brand, CAST(id % 2 AS STRING) AS p_type, 1 AS p_size FROM range(40)").write.parquet(f"{tmp_path}/part.parquet")
    plans, keep = [], graph.stored
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    for module in (assignment, graph, matching, near):
        monkeypatch.setattr(module, "stored", lambda df: plans.append(plan(df)) or keep(df))
    monkeypatch.setattr(near, "DIRECT", 100)
    out = catalogue.q_cascade_pairs(spark, str(tmp_path))
    assert out.count() == 600 and len(plans) > 8
    assert not [p for p in plans if "Broadcast" in p]
    joins = [x for x in plan(out).splitlines() if "Broadcast" in x]
    assert len(joins) == 2 and all("[page" in x for x in joins), joins


def test_texts_of_many_documents_are_compared_once(spark, monkeypatch):
    """Labels come again in every pair of documents; the number of pairs must not multiply the comparisons."""
    rng = random.Random(11)
    said = ["heart rate", "date of birth", "weight", "sex", "visit date", "aaaa"]
    rows = lambda c: [(f"p{k % 40}", rng.choice(said) + rng.choice(["", "s", " x"]), rng.choice(["Week 1", "", "week 2"]), k) for k in range(1200)]
    a = spark.createDataFrame(rows("a"), "pair string, _a string, avisit string, aseq long").withColumn("c", F.xxhash64("_a", "avisit"))
    f = spark.createDataFrame(rows("f"), "pair string, _f string, fvisit string, fseq long").withColumn("d", F.xxhash64("_f", "fvisit"))
    want = sorted(map(tuple, matching._near_in_blocks(a, f, ["pair"], 80.0, 5.0).collect()))
    compared, plain = [], matching.near_pairs
    monkeypatch.setattr(matching, "near_pairs", lambda x, y, keys, least: compared.append(x.distinct().count() * y.distinct().count()) or plain(x, y, keys, least))
    for few in (10**5, 0):
        monkeypatch.setattr(matching, "FEW", few, raising=False)
        assert sorted(map(tuple, matching.near_classes(a, f, ["pair"], 80.0, 5.0).collect())) == want and len(want) > 1000
    assert compared == [18 * 18] * 2


@pytest.mark.parametrize("whole", [10**6, 60, 0])
def test_exact_pass_of_whole_pairs_and_of_parts(spark, monkeypatch, whole):
    """Windows over whole pairs link what the scans in segments link, with heights to be folded, nulls, blank anchors and large pairs."""
    rng = random.Random(12)
    tall = lambda: rng.choice([None, 10.0, 13.0, 16.0, 19.0, 22.0, 300.0, float(rng.randint(0, 60)), float("nan")])
    rows = lambda n: [(rng.choice(["x", "y", "y", "y", None]), k, rng.choice(["A", "a ", "b", None]), rng.choice(["q", "Q", "r", "s", " ", None]), rng.choice([1, 1, 2, 3, None]), [0.0, tall(), 1.0, 1.0]) for k in range(n)]
    frame = lambda n, c: spark.createDataFrame(rows(n), f"pair string, seq long, form_name string, {c} string, page int, rect array<double>")
    a, f = frame(150, "anchor_text").localCheckpoint(), frame(200, "label").localCheckpoint()
    for every in (a, frame(50, "anchor_text").withColumn("seq", F.col("seq") + 1000).unionByName(a).localCheckpoint()):
        side = lambda r, c: matching.keyed(r, c).select(*matching.LABEL, "page", "y0", "seq")
        want = matching._in_segments(side(a.where("trim(anchor_text) <> ''"), "anchor_text"), side(f, "label"), matching._short_ranks(every), matching._short_ranks(f))
        want = sorted(map(tuple, want.collect()))
        monkeypatch.setattr(matching, "WHOLE", whole)
        got = matching.exact_pairs(a, f, None if every is a else every)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 20
