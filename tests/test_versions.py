"""Page prints, the change log, and lists of suggestions."""

import random

import pytest
from pyspark.sql import functions as F

from quillmatch.functions import text
from quillmatch.operators import review, versions
from quillmatch.sources.changes import OPEN, ChangeLog

ROWS = "doc_id string, page int, seq int, text string"


def test_changed_pages_and_what_is_made_anew(spark):
    rng = random.Random(1)
    before = [(f"d{d}", p, s, rng.choice(["a", "b", None])) for d in range(6) for p in (1, 2, 3) for s in range(rng.randint(1, 5))]
    after = [(d, p, s, "c" if (d, p, s) == ("d1", 2, 0) else t) for d, p, s, t in before if (d, p) != ("d2", 3) and d != "d5"]
    after += [("d3", 1, 9, None), ("d4", 7, 0, "x"), ("new", 1, 0, "y")]
    old, new = (spark.createDataFrame(rng.sample(x, len(x)), ROWS) for x in (before, after))
    found = versions.changed_pages(versions.page_prints(old), versions.page_prints(new))
    want = {}
    pages = lambda rows: {k: sorted(((s, t) for d, p, s, t in rows if (d, p) == k), key=repr) for k in {r[:2] for r in rows}}
    a, b = pages(before), pages(after)
    for k in a.keys() | b.keys():
        if a.get(k) != b.get(k):
            want[k] = "added" if k not in a else "removed" if k not in b else "changed"
    assert {(r["doc_id"], r["page"]): r["change"] for r in found.collect()} == want
    # Records that hang on their page alone: those of changed pages are enough.
    made = lambda rows: rows.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("text")).alias("said"))
    fresh = versions.refreshed(made(old), found, made(versions.on_changed(new, found)))
    assert sorted(map(tuple, fresh.collect()), key=repr) == sorted(map(tuple, made(new).collect()), key=repr)
    assert versions.changed_pages(versions.page_prints(old), versions.page_prints(old)).isEmpty()
    assert versions.changed_pages(versions.page_prints(old.limit(0)), versions.page_prints(new)).count() == len(b)


def test_rows_that_swap_pages_or_repeat_are_changes(spark):
    one = spark.createDataFrame([("d", 1, 0, "a"), ("d", 2, 0, "b"), ("e", 1, 0, "a")], ROWS)
    two = spark.createDataFrame([("d", 2, 0, "a"), ("d", 1, 0, "b"), ("e", 1, 0, "a"), ("e", 1, 0, "a")], ROWS)
    assert versions.changed_pages(versions.page_prints(one), versions.page_prints(two)).count() == 3


CHANGE = "id string, op string, row long, label string, page int"


def test_change_log_replays(spark, tmp_path):
    rng = random.Random(2)
    base = {f"i{k}": ("base", k) for k in range(20)}
    log = ChangeLog.created(spark.createDataFrame([(k, *v) for k, v in base.items()], "id string, label string, page int"), f"file://{tmp_path}/log")
    states = [dict(base)]
    for version in range(1, OPEN + 4):
        state = dict(states[-1])
        changes = []
        for row in range(rng.randint(0, 6)):
            id_, op = f"i{rng.randint(0, 25)}", rng.choice(["put", "put", "delete"])
            changes.append((id_, op, row, None if op == "delete" else f"v{version}.{row}", row))
            if op == "delete":
                state.pop(id_, None)
            else:
                state[id_] = (f"v{version}.{row}", row)
        rng.shuffle(changes)
        assert log.append(spark.createDataFrame(changes, CHANGE)) == version == log.version
        states.append(state)
    for version in (0, 1, 7, OPEN - 1, OPEN, OPEN + 1, OPEN + 3):
        assert {r["id"]: (r["label"], r["page"]) for r in log.as_of(version).collect()} == states[version], version
    assert {r["id"] for r in ChangeLog(spark, log.folder).as_of().collect()} == states[-1].keys()
    assert sum(kind == "base" for _, kind, _ in log._manifests()) == 2  # folded once
    with pytest.raises(ValueError):
        log.as_of(-1)


def test_change_log_of_two_writers(spark, tmp_path):
    log = ChangeLog.created(spark.createDataFrame([("a", "x", 1)], "id string, label string, page int"), f"file://{tmp_path}/log")
    change = spark.createDataFrame([("a", "put", 0, "y", 2)], CHANGE)
    log._commit(1, "log", change)
    with pytest.raises(Exception, match="(?i)exist"):
        log._commit(1, "log", spark.createDataFrame([("a", "delete", 0, None, None)], CHANGE))
    assert [tuple(r) for r in log.as_of().collect()] == [("a", "y", 2)]
    assert [tuple(r) for r in log.history("a").collect()] == [(1, "put", 0)] and log.history("b").isEmpty()
    with pytest.raises(FileNotFoundError):
        ChangeLog(spark, f"file://{tmp_path}/none").version  # noqa: B018


def test_suggestions_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["heart", "rate", "date", "birth", "sex", "weight"]
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", "s"])
    visit = lambda: rng.choice(["", "Week 1", "week 1 late"])
    a = [(rng.choice(["F", "g ", ""]), k, rng.choice([say(), "", "heart rate"]), visit()) for k in range(40)]
    f = [(rng.choice(["f", "G", " "]), k, rng.choice([say(), "", "heart rate"]), visit()) for k in range(60)]
    frame = lambda rows, c: spark.createDataFrame([(*r, 1, [0.0] * 4) for r in rows], f"form_name string, seq long, {c} string, visit string, page int, rect array<double>")
    got = [(r["aseq"], r["place"], r["fseq"], round(r["score"], 9)) for r in review.suggestions(frame(a, "anchor_text"), frame(f, "label"), 60.0, 5.0).collect()]
    want = []
    for form, k, x, v in a:
        scores = []
        for other, j, y, w in f:
            p, q = " ".join(sorted(x.split())), " ".join(sorted(y.split()))
            raw = 100.0 if p == q else 200 * text.lcs_length(p, q) / (len(p) + len(q))
            s = raw + (0 if not v or not w else 5 if v.lower() == w.lower() else 2.5 if v.lower() in w.lower() or w.lower() in v.lower() else 0)
            if form.strip().lower() == other.strip().lower() and s >= 60:
                scores.append((-s, j))
        want += [(k, place, j, round(-s, 9)) for place, (s, j) in enumerate(sorted(scores)[:3], 1)]
    assert sorted(got) == sorted(want)
