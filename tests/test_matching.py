import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillmatch.functions import text
from quillmatch.operators import assignment, matching, output, review
from quillmatch.plans.profile import Matching
from quillmatch.sources.records import ANNOTATIONS, FIELDS

STYLE = ("Arial", 10.0, [0.0] * 3, [0.0] * 3, None, 1.0, None)


def annotations(spark, *rows):
    """(form, anchor, page, y) and more by name."""
    out = []
    for k, r in enumerate(rows):
        form, anchor, page, y = r[:4]
        m = r[4] if len(r) > 4 else {}
        out.append((f"a{k}", page, "c", "DM", m.get("category", "sdtm_mapping"), "r", m.get("rect", [100.0, float(y), 150.0, y + 20.0]), anchor, m.get("anchor_rect"), form, m.get("visit", ""), STYLE, 0, k))
    return spark.createDataFrame(out, ANNOTATIONS + ", seq bigint")


def fields(spark, *rows):
    out = []
    for k, r in enumerate(rows):
        form, label, page, y = r[:4]
        m = r[4] if len(r) > 4 else {}
        out.append((f"f{k}", page, label, form, m.get("visit", ""), m.get("rect", [50.0, float(y), 90.0, y + 10.0]), "text_field", m.get("w", 0.0), m.get("h", 0.0), k))
    return spark.createDataFrame(out, FIELDS + ", seq bigint")


def sizes(spark, *rows):
    return spark.createDataFrame([(p, float(w), float(h)) for p, w, h in rows], "page int, width double, height double")


def run(spark, a, f, source=(), target=(), mode="greedy", config=None):
    out = matching.match_annotations(a, f, sizes(spark, *source), sizes(spark, *target), config or Matching(), mode)
    return {r["annotation_id"]: r for r in out.collect()}


def links(spark, a, f, **more):
    return {k: (r["match_type"], r["field_id"]) for k, r in run(spark, a, f, **more).items()}


def test_exact_ignores_case_and_edges(spark):
    m = run(spark, annotations(spark, ("DEMO", " Date of birth", 1, 10)), fields(spark, ("demo ", "DATE OF BIRTH", 2, 50)))["a0"]
    assert (m["match_type"], m["confidence"], m["status"], m["target_page"], m["target_rect"]) == ("exact", 1.0, "approved", 2, [50.0, 50.0, 90.0, 60.0])


def test_fuzzy_value_and_case(spark):
    m = run(spark, annotations(spark, ("D", "Date Birth", 1, 10)), fields(spark, ("D", "Date of Birth", 1, 10)))["a0"]
    assert m["match_type"] == "fuzzy" and abs(m["confidence"] - 2 * 10 / 23) < 1e-12 and m["status"] == "re-pairing"


def test_no_match_and_position(spark):
    a = annotations(spark, ("D", "", 1, 10), ("Elsewhere", "x", 1, 10), ("Z", "y", 1, 10, {"category": "domain_label", "rect": [10.0, 10.0, 50.0, 20.0]}), ("D", "", 1, 0, {"rect": [100.0, 200.0, 300.0, 220.0]}))
    m = run(spark, a, fields(spark, ("D", "AAAA", 1, 10)), source=[(1, 595, 842)], target=[(1, 612, 792)])
    assert [m[k]["match_type"] for k in ("a0", "a1", "a2")] == ["position_only", "unmatched", "position_only"]
    assert m["a1"]["confidence"] == 0 and m["a1"]["target_page"] == 0 and m["a2"]["target_rect"] == [10.0, 10.0, 50.0, 20.0]
    assert m["a3"]["target_rect"] == [100 * (612 / 595), 200 * (792 / 842), 300 * (612 / 595), 220 * (792 / 842)]


def test_visits_compete(spark):
    a = annotations(spark, ("D", "Heart Rat", 1, 10, {"visit": "Week 99"}), ("D", "Heart Rat", 1, 40, {"visit": "Week 4"}))
    f = fields(spark, ("D", "Heart Rate", 1, 10, {"visit": "Week 4"}))
    got = links(spark, a, f, mode="optimal")
    assert got["a1"] == ("fuzzy", "f0") and got["a0"] != ("fuzzy", "f0") or got["a0"][1] == "f0" and got["a1"][1] == "f0"
    edges = {(r["aseq"], round(r["score"], 2)) for r in matching.same_form_edges(a, f, a, 80.0, 5.0).collect()}
    assert edges == {(0, round(200 * 9 / 19, 2)), (1, round(200 * 9 / 19 + 5, 2))}


def test_rows_in_order_and_extras_to_the_last(spark):
    a = annotations(spark, ("D", "x", 1, 300), ("D", "x", 1, 100), ("D", "x", 1, 200))
    assert links(spark, a, fields(spark, ("D", "x", 1, 210), ("D", "x", 1, 110))) == {"a0": ("exact", "f0"), "a1": ("exact", "f1"), "a2": ("exact", "f0")}


def test_siblings_share_a_row(spark):
    a = annotations(spark, ("D", "x", 1, 67.74), ("D", "x", 1, 70.14))
    assert links(spark, a, fields(spark, ("D", "x", 1, 65), ("D", "x", 1, 80))) == {"a0": ("exact", "f0"), "a1": ("exact", "f0")}


def test_one_source_page_looks_at_all_target_pages(spark):
    a = annotations(spark, ("D", "x", 1, 100), ("D", "x", 1, 200), ("D", "x", 1, 300))
    assert links(spark, a, fields(spark, ("D", "x", 1, 10), ("D", "x", 2, 10), ("D", "x", 3, 10))) == {"a0": ("exact", "f0"), "a1": ("exact", "f1"), "a2": ("exact", "f2")}


def test_page_ranks_of_the_whole_form(spark):
    a = annotations(spark, ("D", "anchor", 23, 10), ("D", "x", 24, 10), ("D", "x", 25, 10))
    f = fields(spark, *[("D", "x", p, 10) for p in (23, 24, 25, 26)])
    got = links(spark, a, f)
    assert got["a1"] == ("exact", "f1") and got["a2"] == ("exact", "f2")


def test_a_rank_without_target(spark):
    a = annotations(spark, ("D", "x", 3, 10), ("D", "x", 4, 10))
    got = links(spark, a, fields(spark, ("D", "x", 5, 10)))
    assert got["a0"] == ("exact", "f0") and got["a1"][0] != "exact"


def test_fields_near_the_last_kept_one(spark):
    f = fields(spark, ("D", "x", 1, 100), ("D", "x", 1, 104), ("D", "x", 1, 108))
    a = annotations(spark, ("D", "x", 1, 0), ("D", "x", 1, 50))
    assert links(spark, a, f) == {"a0": ("exact", "f0"), "a1": ("exact", "f2")}


def test_placement_guard(spark):
    f = fields(spark, ("D", "x", 1, 200, {"rect": [450.0, 200.0, 530.0, 220.0], "w": 600.0, "h": 800.0}), ("E", "X ", 1, 0, {"rect": [300.0, 200.0, 380.0, 220.0]}), ("E", "x", 1, 0, {"rect": [50.0, 200.0, 130.0, 220.0]}))
    far = {"rect": [150.0, 200.0, 210.0, 220.0], "anchor_rect": [50.0, 200.0, 90.0, 210.0]}
    m = run(spark, annotations(spark, ("D", "x", 1, 0, far)), f)["a0"]
    assert m["target_rect"] == [50.0, 200.0, 130.0, 220.0] and m["placement_adjusted"]
    m = run(spark, annotations(spark, ("D", "x", 1, 0, far)), f.where("id = 'f0'"))["a0"]
    assert m["target_rect"] == [550.0, 200.0, 600.0, 220.0] and m["placement_adjusted"]


def test_lcs():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
            row = new
        assert text.lcs_length(a, b) == row[-1]


def test_optimal_is_best_of_all():
    rng = random.Random(3)
    for _ in range(150):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        cells = [(a, f, float(rng.randint(80, 99))) for a in range(n) for f in range(m) if rng.random() < 0.7]
        if not cells:
            continue
        weight = {(a, f): s for a, f, s in cells}
        best = max(sum(weight.get((a, f), 0) for a, f in zip(range(n), p, strict=False)) for p in itertools.permutations(range(max(n, m)), n))
        got = assignment.optimal_pairs(pd.DataFrame(cells, columns=["aseq", "fseq", "score"]))
        assert got["aseq"].is_unique and got["fseq"].is_unique and np.isclose(got["score"].sum(), best)


def test_large_groups_are_parted_alike(spark):
    rng = random.Random(6)
    cells = [(g, 100 * g + a, 100 * g + f, float(rng.randint(80, 99))) for g in range(3) for a in range(20) for f in range(20) if rng.random() < 0.08]
    edges = spark.createDataFrame(cells, "g long, aseq long, fseq long, score double")
    for mode in ("greedy", "optimal"):
        one, parted = ({(r["aseq"], r["fseq"], r["score"]) for r in assignment.assigned(edges, mode, most=n).collect()} for n in (10_000, 8))
        assert one == parted if mode == "greedy" else np.isclose(sum(x[2] for x in one), sum(x[2] for x in parted))


def test_optimal_of_many(spark):
    rng = random.Random(7)
    cells = pd.DataFrame([(a, (a * 7 + k) % 3000, 80 + rng.random() * 19) for a in range(3000) for k in range(4)], columns=["aseq", "fseq", "score"])
    got = assignment.optimal_pairs(cells)
    greedy_total = assignment.greedy_pairs(cells)["score"].sum()
    assert got["aseq"].is_unique and got["fseq"].is_unique and got["score"].sum() >= greedy_total


def greedy(cells):
    used, out = set(), {}
    for a in sorted({c[0] for c in cells}):
        free = sorted((-s, f) for x, f, s in cells if x == a and f not in used)
        if free:
            out[a] = free[0][1]
            used.add(free[0][1])
    return out


def test_greedy_in_order():
    rng = random.Random(4)
    for _ in range(150):
        cells = [(a, f, float(rng.randint(80, 83))) for a in range(5) for f in range(4) if rng.random() < 0.6]
        got = assignment.greedy_pairs(pd.DataFrame(cells, columns=["aseq", "fseq", "score"]))
        assert dict(zip(got["aseq"], got["fseq"], strict=True)) == greedy(cells)


def test_cross_form_edges_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["heart", "rate", "date", "of", "birth", "sex", "weight", "heart rate"]
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice(["", "s", "x"])
    a = [("D", say(), 1, k, {"visit": rng.choice(["", "Week 1", "week 1 late"])}) for k in range(40)]
    f = [("E", say(), 1, k, {"visit": rng.choice(["", "Week 1"])}) for k in range(40)]
    got = {(r["aseq"], r["fseq"]): r["score"] for r in matching.cross_form_edges(annotations(spark, *a), fields(spark, *f), 85.0, 5.0).collect()}
    want = {}
    for i, x in enumerate(a):
        for j, y in enumerate(f):
            p, q = " ".join(sorted(x[1].split())), " ".join(sorted(y[1].split()))
            v, w = x[4]["visit"].lower(), y[4]["visit"].lower()
            s = 200 * text.lcs_length(p, q) / (len(p) + len(q)) + (0 if not v or not w else 5 if v == w else 2.5 if v in w or w in v else 0)
            if s >= 85:
                want[i, j] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_cascade_takes_each_annotation_once(spark):
    a = annotations(spark, ("D", "x", 1, 10), ("D", "Heart Rate", 1, 20), ("E", "Heart Rates", 1, 30), ("D", " ", 1, 40), ("N", "nothing like it", 9, 50))
    f = fields(spark, ("D", "x", 1, 10), ("D", "Heart Rat", 1, 30))
    got = links(spark, a, f)
    assert got == {"a0": ("exact", "f0"), "a1": ("fuzzy", "f1"), "a2": ("fuzzy", "f1"), "a3": ("position_only", None), "a4": ("unmatched", None)}


def test_report_and_review(spark):
    a = annotations(spark, ("D", "x", 1, 10), ("D", "y", 1, 20), ("N", "z", 1, 20))
    f = fields(spark, ("D", "x", 1, 10), ("D", "why not", 1, 20))
    m = matching.match_annotations(a, f, sizes(spark, (1, 1, 1)), sizes(spark, (1, 1, 1)))
    r = output.qc_report(output.writable(m, a, 1)).first()
    assert (r["total_matches"], r["written"], r["skipped"], r["unmatched_annotation_ids"]) == (3, 1, 2, ["a2"])
    done = review.confirmed(m, a, f, "a1", "f1", 5.0).where("annotation_id = 'a1'").first()
    assert (done["field_id"], done["match_type"], done["status"]) == ("f1", "manual", "approved") and 0 < done["confidence"] < 1
    assert review.exact_rate(m, a).first()["rate"] == 33
    assert review.restored_choice(None, ["a"], ["a", "b"]) == ["a"] and review.restored_choice(["b"], ["a"], ["a"]) == []


def test_manual_match_of_nothing(spark):
    import pytest

    a = annotations(spark, ("D", "x", 1, 10))
    m = matching.positioned(a, fields(spark, ("D", "x", 1, 1)), sizes(spark, (1, 1, 1)), sizes(spark, (1, 1, 1)), 0.5)
    with pytest.raises(ValueError):
        review.manual_match(m, "nobody", "f", [0.0] * 4)


def test_blank_threshold_plan_has_no_nested_loop(spark):
    a, f = annotations(spark, ("D", "x", 1, 10)), fields(spark, ("D", "x", 1, 10))
    plan = matching.same_form_edges(a, f, a, 80.0, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert F is not None
