"""Near duplicates, line dedup, repeated passages, leaks: against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillmatch.llm import decontaminate, jaccard, lines, substrings

from .brute import ODD, Union, alnum, changed, edit_distance, prose, seeded, shingles, words


def families(rng):
    rows, k = [], 0
    for size in (1, 2, 5, 30, 60):
        base = prose(rng, rng.randint(40, 120))
        for _ in range(size):
            rows.append((k, changed(rng, base, rng.randint(0, 6))))
            k += 1
    passage = prose(rng, 60)
    for _ in range(40):  # one passage in many otherwise different texts
        rows.append((k, prose(rng, 120) + " " + passage + "\n" + prose(rng, 80)))
        k += 1
    rows += [(k + 1, rows[3][1]), (k + 2, rows[3][1].upper()), (k + 3, prose(rng, 30_000))]
    return rows + ODD


@pytest.mark.parametrize(("block", "cells"), [(1 << 19, 16), (1 << 19, 1), (1000, 16)])
def test_jaccard_components(spark, corpus, monkeypatch, block, cells):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", jaccard.BLOCK_SHINGLES if block > 1000 else 700)
    monkeypatch.setattr(jaccard, "CELLS", cells)
    monkeypatch.setattr(jaccard, "FREQUENT", 5 if cells == 1 else jaccard.FREQUENT)
    rows = [r for r in families(seeded(1)) if r[0] is not None]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op8_jaccard(spark, corpus(rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    u = Union(sets)
    ids = list(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                u.join(i, j)
    assert got == {i: (len(sets[i]), u.find(i)) for i in ids}


def test_jaccard_null_ids_and_empty_table(spark, corpus):
    out = jaccard.op8_jaccard(spark, corpus([(None, "a b c d e f"), (4, "a b c d e f"), (3, "A b c d e f")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(None, 3), (4, 3), (3, 3)}
    assert jaccard.op8_jaccard(spark, corpus([])).collect() == []


def test_regions_split_and_join_exactly():
    rng = seeded(7)
    import numpy as np

    bases = [rng.sample(range(10**6), 60) for _ in range(12)]
    sets = []
    for _ in range(1500):
        s = set(rng.choice(bases))
        for _ in range(rng.randint(0, 9)):
            s.discard(next(iter(s)))
            s.add(rng.randrange(10**6))
        sets.append(np.array(sorted(s), np.uint64))
    want = Union(range(len(sets)))
    as_sets = [set(s.tolist()) for s in sets]
    for i in range(0, len(sets), 5):
        for j in range(len(sets)):
            n = len(as_sets[i] & as_sets[j])
            if i != j and 100 * n >= 75 * len(as_sets[i] | as_sets[j]):
                want.join(i, j)
    got = Union(range(len(sets)))
    for r, i in jaccard.forest(sets, exact=True):
        got.join(r, i)
    for i in range(0, len(sets), 5):
        for j in range(0, len(sets), 5):
            if want.find(i) == want.find(j):
                assert got.find(i) == got.find(j)


def test_bits_bound_symmetric_differences():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = []
    for n in (3, 900, 1000, 1100, 2100, 5000):
        base = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sets += [np.unique(np.concatenate((base[: int(n * share)], rng.integers(0, 1 << 63, int(n * (1 - share) * 0.9), dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))) for share in (1, 0.95, 0.85, 0.5, 0)]
    sizes = np.array([len(s) for s in sets])
    x = jaccard._Bits([jaccard._bits(s) for s in sets], sizes)
    passed = linked = 0
    for i in range(len(sets)):
        near = set(x.near(i, np.arange(len(sets))).tolist())
        for j in range(len(sets)):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 75 * (sizes[i] + sizes[j] - c):
                assert j in near
                linked += 1
            gap = jaccard._gap(jaccard._bits(sets[i]), jaccard._bits(sets[j]))
            assert gap <= sizes[i] + sizes[j] - 2 * c and (j in near) == (7 * max(gap, abs(sizes[i] - sizes[j])) <= sizes[i] + sizes[j])
        passed += len(near)
    assert linked > len(sets) and passed < 2 * linked


def test_near_duplicate_stage_keeps_one_of_each(spark, corpus):
    rng = seeded(2)
    base = prose(rng, 100)
    rows = [(5, base), (2, changed(rng, base, 2)), (9, prose(rng, 50)), (9, "other text of one id"), (7, None), (8, "")]
    twins = [(4, "Twin one"), (4, "twin one"), (4, "Twin one"), (None, "no id"), (None, "No id"), (None, "third of them"), (12, "third of them"), (12, "\t")]
    for more, want in (([], []), (twins, [4, None, 12, 12])):
        path = corpus([*rows, *more, (7, None), (7, None), (None, None)])
        docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"_id": F.lit(1), "_node": F.array(F.lit("x")), "node": F.struct(F.lit(2).alias("a"))})
        out = jaccard.stage_near_duplicates(spark, docs, path)
        assert out.columns == docs.columns
        assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted([2, 7, 7, 7, 8, 9, 9, None, *want], key=repr)


def line_rows(rng):
    long_ = [prose(rng, rng.randint(9, 30)) for _ in range(30)]
    rows = []
    for k in range(40):
        own = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(long_)
            for _ in range(rng.randint(0, 3)):
                p = rng.randrange(len(line))
                line = line[:p] + rng.choice(["", "x", "é", "zz"]) + line[p + rng.randint(0, 1) :]
            own.append(rng.choice(["", "  ", "\t"]) + line)
        rows.append((k, "\n".join([*own, "short", ""])))
    return rows + [(100, rows[0][1]), (101, "\n\n"), *[r for r in ODD if r[0] is not None]]


@pytest.mark.parametrize("block", [2048, 4])
def test_line_dedup(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    rows = line_rows(seeded(3))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in lines.op7_line_dedup(spark, corpus(rows)).collect()}
    first = {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for at, line in enumerate(t.split("\n")):
            line = line.strip(" \t\r")
            if len(line) >= lines.MIN_CHARS:
                first.setdefault(line, (i, at))
    names = list(first)
    u = Union(range(len(names)))
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            if abs(len(names[a]) - len(names[b])) <= 2 and edit_distance(names[a], names[b]) <= 2:
                u.join(a, b)
    stay = {}
    for a, name in enumerate(names):
        stay[u.find(a)] = min(stay.get(u.find(a), (10**9, 0)), first[name])
    at_of = {n: k for k, n in enumerate(names)}
    for i, t in rows:
        if t is None:
            assert got[i] == (0, 0, None)
            continue
        out = [x for at, x in enumerate(t.split("\n")) if len(x.strip(" \t\r")) < lines.MIN_CHARS or stay[u.find(at_of[x.strip(" \t\r")])] == (i, at)]
        n = len(t.split("\n"))
        assert got[i] == (n, n - len(out), hashlib.sha256("\n".join(out).encode()).hexdigest()), i


def test_banded_distance_and_probes():
    rng = seeded(4)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for e in (1, 2, 3):
            assert lines.within(a, b, e) == (edit_distance(a, b) <= e)
    for n in (8, 40, 101):
        parts = lines.segments(n, 3)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))


def test_line_stage(spark, corpus):
    line = "a line that is long enough to be compared with others"
    path = corpus([(1, line + "\nrest"), (2, line), (3, line + "!\nown"), (4, ""), (5, None), (6, "tiny")])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = lines.stage_lines(spark, docs, path)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(1, line + "\nrest", len(line) + 5), (3, "own", 3), (4, "", 0), (5, None, None), (6, "tiny", 4)}
    assert lines.stage_lines(spark, spark.read.parquet(f"{corpus([])}/documents.parquet"), path).collect() == []


def test_short_lines_go_as_repeats(spark, corpus):
    heading, menu, note = "Home | About", "see also the pages below", "read the whole page before use"
    rows = [
        (1, "\n".join([heading, menu, "", note, "x"])), (2, "\n".join([heading, menu + "s", "", note + "rs", "y"])), (3, "\n".join(["Home | Abouts", " " + heading, "x", "", "own"])),
        (4, "\n".join([note[:-1] + "d", "x"])),
    ]
    path = corpus(rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs.select("doc_id", "text")).collect()}
    # 12 code points: exact repeats only; 24 and 30: one edit; two edits in 30 stay; lines without text stay.
    assert kept == {1: rows[0][1], 2: "\n" + note + "rs\ny", 3: "Home | Abouts\n\nown", 4: ""}
    assert {r["doc_id"]: r["n_removed"] for r in lines.op7_line_dedup(spark, path).collect()} == {1: 0, 2: 2, 3: 2, 4: 2}
    left = lines.stage_lines(spark, docs, path).collect()
    assert {r["doc_id"]: r["text"] for r in left} == {i: t for i, t in kept.items() if i != 4}


def test_lines_of_null_and_equal_ids(spark, corpus):
    one, two, three = (f"line number {x} that is long enough for two edits" for x in ("one", "two", "three"))
    rows = [(1, one), (5, two), (5, one), (None, three), (None, three + "\n" + two), (None, three), (9, None), (9, three + "s")]
    path = corpus(rows)
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"_hash": F.lit("x"), "_id": F.col("doc_id"), "hash": F.array(F.lit(1))})
    got = lines.dedup_lines(docs)
    assert got.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_removed"]
    left = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    nulls = [t for i, t in left if i is None]
    assert [x for x in left if x[0] is not None] == [(1, one), (5, ""), (5, ""), (9, ""), (9, None)]
    # Equal rows are one document and stay equal; which of the other null rows comes first is its hash's matter.
    assert sum(three in t for t in nulls) in (1, 2) and sum(two in t for t in nulls) == 1
    assert sorted(t for t in nulls if two not in t)[0] == sorted(t for t in nulls if two not in t)[-1]


def test_lines_of_long_texts(spark, corpus):
    rng = seeded(21)
    often = "a line that every text repeats many times over"
    rows = [(k, "\n".join([often] * 3000 + [prose(rng, 12) for _ in range(2000)])) for k in range(3)] + [(3, "x" * 3_000_000), (4, "x" * 3_000_000)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in lines.op7_line_dedup(spark, corpus(rows)).collect()}
    assert got == {0: (5000, 2999), 1: (5000, 3000), 2: (5000, 3000), 3: (1, 0), 4: (1, 1)}


def test_edits_shrink_with_the_length(spark, corpus):
    rng = seeded(11)
    texts = []
    for n in [*range(12, 20), *range(28, 36)]:
        base = "".join(rng.choice("abcdefgh ") for _ in range(n)).strip() or "a"
        for edits in (0, 1, 1, 2, 2, 3):
            line = base
            for _ in range(edits):
                p = rng.randrange(len(line))
                line = line[:p] + rng.choice(["", "x", "yz"]) + line[p + rng.randint(0, 1) :]
            texts.append(line.strip(" ") or "a")
    rng.shuffle(texts)
    names = list(dict.fromkeys(texts))
    u = Union(range(len(names)))
    for a in range(len(names)):
        for b in range(a):
            if edit_distance(names[a], names[b]) <= min(2, min(len(names[a]), len(names[b])) // 16):
                u.join(a, b)
    gone = {k for k, t in enumerate(texts) if names.index(t) != u.find(names.index(t)) or texts.index(t) < k}
    got = {r["doc_id"]: r["n_removed"] for r in lines.op7_line_dedup(spark, corpus(list(enumerate(texts)))).collect()}
    assert {k for k, n in got.items() if n} == gone and len(gone) > 20


def repeats_by_hand(rows, earlier=()):
    """(n_words, n_removed, kept_sha256) of each row, judged on all rows and the earlier ones."""
    count, split = {}, [words(t) for _, t in rows]
    for w in [*split, *[words(t) for _, t in earlier]]:
        for k in range(len(w) - 34):
            count[tuple(w[k : k + 35])] = count.get(tuple(w[k : k + 35]), 0) + 1
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def repeat_rows(rng):
    shared = [prose(rng, n) for n in (34, 35, 36, 90)]
    rows = [(k, " ".join([prose(rng, rng.randint(0, 50)), rng.choice(shared), prose(rng, rng.randint(0, 50)), rng.choice(shared)])) for k in range(30)]
    twice = prose(rng, 40)
    rows += [(50, twice + " x " + twice), (51, prose(rng, 300)), (52, rows[3][1]), (53, rows[3][1]), (54, "a " * 200), (55, prose(rng, 30_000)), (56, shared[2].upper()), *ODD]
    return rows + [(60, rows[5][1]), (60, prose(rng, 80)), (None, rows[6][1]), (None, rows[6][1]), (None, prose(rng, 70))]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_repeats(spark, corpus, batches):
    rows = repeat_rows(seeded(5))
    docs = spark.read.parquet(f"{corpus(rows)}/documents.parquet")
    assert sorted(map(tuple, substrings.remove_repeats(docs, batches=batches).collect()), key=repr) == repeats_by_hand(rows)


def test_repeats_of_later_calls(spark, tmp_path):
    rng = seeded(16)
    rows = repeat_rows(rng)
    passage = prose(rng, 60)
    calls = [rows[:20], [*rows[20:], (70, prose(rng, 30) + " " + passage)], [(80, passage + " " + prose(rng, 50)), (81, rows[2][1]), (82, prose(rng, 60)), (83, None)]]
    folder, earlier = f"file://{tmp_path}/index", []
    for own in calls:
        index = substrings.FingerprintIndex(spark, folder, buckets=3)  # opened again each time
        assert len(index.texts) == len({id(x) for x in calls if x is not own and calls.index(x) < calls.index(own)})
        docs = spark.createDataFrame(own, "doc_id long, text string")
        got = sorted(map(tuple, substrings.remove_repeats(docs, index).collect()), key=repr)
        assert got == repeats_by_hand(own, earlier)
        earlier += own
    last = dict((r[0], r) for r in got)
    assert last[80][2] == 60 and last[81][2] == last[81][1] and last[82][2] == 0
    index.compact()
    index.commit()
    assert len(substrings.FingerprintIndex(spark, folder).runs) == 1


def test_index_runs(spark):
    index = substrings.FingerprintIndex(spark, buckets=4)
    one = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (2, 8, 1), (5, 8, 2)], "fp long, lid long, n int")
    two = spark.createDataFrame([(1, 9, 1), (3, 9, 1)], "fp long, lid long, n int")
    assert {r["fp"] for r in index.append(one).collect()} == {2, 5}
    found = index.append(two)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert {r["fp"] for r in found.collect()} == {1}
    assert {(r["lid"], tuple(r["hot"])) for r in index.holders(found).collect()} == {(7, (1,)), (9, (1,))}
    assert len(index.runs) == 2
    merged = index.run(index.runs[0]).union(index.run(index.runs[1])).sortWithinPartitions("fp")
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    index.compact()
    assert len(index.runs) == 1 and sorted(map(tuple, index.run(index.runs[0]).collect())) == [(1, 7, 1), (1, 9, 1), (2, 7, 1), (2, 8, 1), (3, 9, 1), (5, 8, 2)]


def test_decontamination(spark, corpus):
    rng = seeded(6)
    items = [(k, prose(rng, rng.randint(8, 60))) for k in range(60)] + [(80, "two words"), (81, None), (82, ""), (83, prose(rng, 400))]
    rows = []
    for k in range(200):
        text = prose(rng, rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            leak = rng.choice(items)[1] or ""
            leak = changed(rng, leak, rng.randint(0, 1)) if leak else ""
            text += "\n" + leak.title() + "!! " + prose(rng, rng.randint(0, 40))
        rows.append((k, text))
    rows += [(300, prose(rng, 20_000) + " " + items[5][1] + " " + prose(rng, 20_000)), (301, items[7][1]), (302, items[7][1].replace(" ", ", ")), *ODD]
    got = {}
    for r in decontaminate.op1_decontaminate(spark, corpus(rows, benchmark=items)).collect():
        got[r["doc_id"], r["item_id"]] = r["similarity"]
    grams = {i: {tuple(alnum(t)[k : k + 5]) for k in range(max(1, len(alnum(t)) - 4))} for i, t in items if alnum(t)}
    df = {}
    for g in grams.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    must, may = set(), set()
    for d, t in rows:
        w = alnum(t)
        have = {tuple(w[k : k + n]) for n in {5, *[len(x) for g in grams.values() for x in g]} for k in range(len(w) - n + 1)}
        for i, g in grams.items():
            share = sum(1 / df[x] for x in g & have) / sum(1 / df[x] for x in g)
            if share >= 0.75 - 1e-9:
                may.add((d, i))
                if share > 0.9:
                    must.add((d, i))
    assert set(got) <= may and must <= set(got)
    assert len(set(got)) >= 0.97 * len(may)
    docs = spark.read.parquet(f"{corpus(rows, benchmark=items)}/documents.parquet")
    left = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), items=17).collect()}
    assert left == {d for d, _ in got}


def test_decontamination_of_parts_at_the_ends(spark, corpus):
    rng = seeded(12)
    items = [(k, prose(rng, 55 + k)) for k in range(6)] + [(10 + k, prose(rng, 9)) for k in range(3)]
    must, may, rows = set(), set(), []

    def add(item, text, sure):
        (must if sure else may).add((len(rows), item))
        rows.append((len(rows), text))

    for i, text in items:
        w = text.split(" ")
        add(i, " ".join(w[1:]), True)
        add(i, " ".join(w[:-1]), True)
        part = 1 + len(w) // 7
        for own in (w[part:], w[:-part]):
            add(i, " ".join(own), False)
        add(i, prose(rng, 150) + " " + " ".join(w[:-part]), False)
        add(i, " ".join(w[part:]) + " " + prose(rng, 150), False)
        add(i, prose(rng, 10) + " " + " ".join(w[:-part]), False)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.op1_decontaminate(spark, corpus(rows, benchmark=items)).collect()}
    grams = {i: {tuple(alnum(t)[k : k + 5]) for k in range(len(alnum(t)) - 4)} for i, t in items}
    have = {d: {tuple(alnum(t)[k : k + 5]) for k in range(len(alnum(t)) - 4)} for d, t in rows}
    share = {x: len(grams[x[1]] & have[x[0]]) / len(grams[x[1]]) for x in must | may}
    may = {x for x in may if share[x] >= 0.75}
    assert must <= set(got) <= must | may and len(must) == 18
    assert len(may) > 25 and len(may & set(got)) >= 0.9 * len(may)
    assert all(abs(got[x] - share[x]) < 1e-9 for x in got)


def test_decontamination_is_the_same_at_every_block_size(spark):
    rng = seeded(13)
    items = []
    for t in range(4):
        template = prose(rng, 50)
        items += [(10 * t + k, template + " " + prose(rng, 16)) for k in range(5)]
        items += [(100 + 10 * t + k, prose(rng, 15) + " " + prose(rng, rng.randint(20, 70))) for k in range(3)]
    items += [(200, items[0][1]), (None, items[1][1]), (201, "two words"), (202, "two words"), (203, None)]
    rows = [(i, prose(rng, 30) + " " + t + " " + prose(rng, 30)) for i, t in items if t]
    rows += [(500 + t, " ".join(items[8 * t][1].split(" ")[:50])) for t in range(4)]  # templates alone
    rows += [(600 + t, " ".join(items[8 * t + 1][1].split(" ")[8:])) for t in range(4)] + [(700, prose(rng, 20_000) + " " + items[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    def found(order, size):
        benchmark = spark.createDataFrame(order, "item_id long, text string").coalesce(1)
        return sorted(decontaminate.contaminated(docs, benchmark, items=size).collect(), key=repr)

    whole = found(items, 100)
    assert whole and not any(500 <= r["doc_id"] < 510 for r in whole if r["doc_id"] is not None)
    for order, size in ((items, 1), (items[::-1], 7), (rng.sample(items, len(items)), 11)):
        assert found(order, size) == whole


def test_shards_and_one_scan(spark, corpus, monkeypatch):
    import pyarrow as pa

    rng = seeded(22)
    items = [(k, prose(rng, 30 + k % 3)) for k in range(30)]
    rows = [(k, prose(rng, 100) + " " + items[k % 30][1]) for k in range(60)]
    path = corpus(rows, benchmark=items)
    docs, benchmark = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "benchmark"))
    found = decontaminate.contaminated(docs, benchmark)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    whole = sorted(map(tuple, found.collect()))
    assert len(whole) == 60
    monkeypatch.setattr(decontaminate, "SHARD", 7)
    search = decontaminate._Search(decontaminate.Benchmark([(i, t, []) for i, t in items], [30]))
    search.add([(i, 0) for i, _ in rows], pa.array([t for _, t in rows]))
    got = search.results().to_pylist()
    assert [(r["doc_id"], r["item_id"], r["first_word"]) for r in got] == [(d, i, a) for d, _, i, _, _, a in whole]


def test_decontamination_stage_keeps_clean_rows_of_an_id(spark, corpus):
    rng = seeded(23)
    item, clean = prose(rng, 40), prose(rng, 60)
    path = corpus([(None, "x " + item), (None, clean), (None, None), (5, item), (5, clean), (5, clean), (6, "")], benchmark=[(1, item), (None, "")])
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({"_id": F.lit(1), "hash": F.array(F.lit(2))})
    out = decontaminate.stage_decontaminate(spark, docs, path)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(None, clean), (None, None), (5, clean), (5, clean), (6, "")], key=repr)


def test_decontamination_of_nothing(spark, corpus):
    path = corpus([(1, "a b c d e f g")], benchmark=[])
    assert decontaminate.op1_decontaminate(spark, path).collect() == []
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert decontaminate.stage_decontaminate(spark, docs, path).columns == docs.columns
    assert decontaminate.op1_decontaminate(spark, corpus([], benchmark=[(1, "a b c d e f")])).collect() == []


def test_blocks_find_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    prints = []
    for x in items.tolist():
        for n in range(24):
            for b in rng.choice(64, n, replace=False).tolist():
                x ^= 1 << b
            prints.append(x)
    prints = np.array(prints, np.uint64)
    c = decontaminate._Class(10, items, np.arange(40))
    w, i, d = c.within(prints)
    far = np.bitwise_count(prints[:, None] ^ items[None, :])
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontaminate.RADIUS)), strict=True))
    assert (d == far[w, i]).all() and F is not None
