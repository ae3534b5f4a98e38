"""Quality rules, licenses, tokens, packing, archives, pages and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillmatch.llm import html, licenses, packing, quality, queries, tokens, warc

from .brute import ODD, alnum, edit_distance, prose, seeded, words


def test_quality_measures(spark, corpus):
    rng = seeded(1)
    rows = [(k, "\n".join(prose(rng, rng.randint(0, 40), ["a", "b", "cc", "#x", "|"]) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    rows += [(70, prose(rng, 200)), (71, "x " * 300), (72, "\n".join(["same line here"] * 40)), (73, "\n \n\t\n"), (74, prose(rng, 20_000)), *ODD]
    rows += [(80 + k, mark.join(prose(rng, 20) + end for _ in range(6))) for k, (mark, end) in enumerate([("\n- ", ""), ("\n", " ..."), ("\n", "… "), ("\n", " 123456789" * 15), ("\n\t• ", ".")])]
    rows += [(90, "- " + prose(rng, 90) + " ...")]
    got = {}
    for r in quality.op3_quality(spark, corpus(rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]))
    want = {}
    for i, t in rows:
        w, t = words(t), t or ""
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        gone = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        n, c, s, d = len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines))
        base = n < 50 or 100 * len(gone) > 50 * n
        bullets, broken = sum(bool(re.match(r"[ \t-\r]*[-*•‣▪●◦]", x)) for x in lines), sum(bool(re.search(r"(\.\.\.|…)[ \t-\r]*\Z", x)) for x in lines)
        by_line = len(lines) > 2 and (100 * bullets > 90 * len(lines) or 100 * broken > 30 * len(lines))
        kept = not (base or 4 * s > n or c < 2 * n or c > 15 * n or 2 * d > len(lines) or 2 * sum(map(str.isalpha, t)) < c or by_line)
        want.setdefault(i, set()).add((n, c, s, d, len(gone), base, kept))
    assert got == want
    docs = spark.read.parquet(f"{corpus(rows)}/documents.parquet")
    out = quality.stage_quality(spark, docs, "")
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, v in want.items() if any(x[-1] for x in v)}


def test_quality_order_and_empty(spark, corpus):
    rules = quality.default_rules(F.col("text"))
    empty = spark.read.parquet(f"{corpus([])}/documents.parquet")
    assert [r.name for r, _, _ in quality.ordered(rules, quality.sampled(empty))] == [r.name for r in rules]
    assert quality.op3_quality(spark, corpus([])).collect() == []
    rng = seeded(2)
    docs = spark.read.parquet(f"{corpus([(k, 'short') for k in range(40)] + [(50, prose(rng, 90))])}/documents.parquet")
    found = quality.ordered(rules, quality.sampled(docs))
    gain = [share / cost for _, cost, share in found]
    assert gain == sorted(gain, reverse=True) and {r.name: share for r, _, share in found}["few_words"] > 0.9
    plan = quality.stage_quality(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_later_rules_are_not_evaluated(spark):
    docs = spark.createDataFrame([(1, "reject"), (2, "keep"), (3, None)], "doc_id long, text string")
    fails = quality.Rule("fails", F.raise_error(F.lit("evaluated")).isNotNull())
    first = quality.Rule("first", F.coalesce(F.col("text"), F.lit("reject")) == "reject")
    rows = docs.where("doc_id <> 2").select(quality.cascade([first, fails]).alias("by"))
    assert [r["by"] for r in rows.collect()] == ["first", "first"]
    with pytest.raises(Exception, match="evaluated"):
        docs.select(quality.cascade([first, fails])).collect()
    with pytest.raises(Exception, match="evaluated"):
        docs.select(quality.cascade([fails, first])).collect()


def test_quality_sample(spark, corpus):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(4000)], "doc_id long, text string").repartition(8, "doc_id")
    one, again, other = (sorted(r["text"] for r in quality.sampled(docs.coalesce(1), rows=300, seed=s).collect()) for s in (42, 42, 43))
    assert one == again != other and 200 < len(one) <= 300


def test_licenses(spark, corpus):
    rows = [
        (1, "Intro. Licensed under CC BY-NC 4.0."), (2, "ALL RIGHTS\nRESERVED. cc by, cc by"), (3, "Licensed undr the Apache Licence, Version 2.0!"), (4, "the GNU General Public License"),
        (5, "Permission is herby granted, free of charge, to any person obtainin a copy"), (6, "é all rights reservd"), (7, "accc byte all right"), (8, prose(seeded(3), 20_000) + " all rights reserved"), *ODD,
    ]
    found = licenses.license_spans(spark.read.parquet(f"{corpus(rows)}/documents.parquet")).collect()
    got = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for i, t in rows:
        if i is None:
            continue
        w = alnum(t)
        at = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not r["base_labels"]
    assert got[3]["labels"] == "apache-2.0" and 0.9 < got[3]["score"] < 1 and got[5]["labels"] == "mit" and got[6]["labels"] == "reserved" and got[7]["labels"] == ""
    (s,) = got[3]["spans"]
    assert rows[2][1][s["start"] : s["end"]] == "Licensed undr the Apache Licence, Version 2.0" and s["errors"] == 2
    (s,) = got[6]["spans"]
    assert rows[5][1][s["start"] : s["end"]] == "all rights reservd" and (s["first_word"], s["last_word"]) == (1, 3)
    assert licenses.op2_licenses(spark, corpus([])).collect() == []


def test_pieces_guarantee_a_seed():
    rng = seeded(4)
    for notice in licenses.NOTICES:
        k = licenses.edits(notice)
        assert "".join(p for _, p in licenses.pieces(notice)) == notice and len(licenses.pieces(notice)) == k + 1
        for _ in range(50):
            text = list(notice)
            for _ in range(k):
                text[rng.randrange(len(text))] = rng.choice(["", "#", "##"])
            assert any(p in "".join(text) for _, p in licenses.pieces(notice))


def test_licenses_with_all_their_edits():
    rng, scanner = seeded(14), licenses.Scanner()
    for notice in (n for n in licenses.NOTICES if licenses.edits(n) > 4):
        for k in range(licenses.edits(notice) + 1):
            for ch in "qéЖ":
                text = list(notice)
                for p in rng.sample([i for i, x in enumerate(notice) if x != " " and 0 < i < len(notice) - 1], k):
                    text[p] = ch
                text = "".join(text)
                got = scanner.scan(f"ünder zz {text} zz. Then zz {notice} zz")
                assert got["labels"] == licenses.NOTICES[notice] and got["score"] == 1
                assert [s["errors"] for s in got["spans"]] == [k, 0] and got["spans"][0]["first_word"] == 2
                (s,) = scanner.scan(f"ünder zz {text} zz")["spans"]
                assert (s["start"], s["end"], s["errors"]) == (9, 9 + len(notice), k)
        text = notice[:10] + "#####" + notice[15:]
        assert [x["errors"] for x in scanner.scan(f"{text.replace('#', 'é')} " * 3000)["spans"]] == [5] * 3000
    (s,) = scanner.scan("réleaséd under the mit license")["spans"]
    assert s["errors"] == 2 and s["label"] == "mit"


def test_distances_of_notices():
    rng = seeded(15)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(1, n))) for n in (8, 12))
        assert licenses.distances(licenses._masks(a), len(a), b) == [edit_distance(a, b[:e]) for e in range(1, len(b) + 1)]


def places_by_hand(notice, w):
    """(errors, first word, last word) of the places of a notice among all runs of words."""
    most, found = licenses.edits(notice), []
    for a in range(len(w)):
        own, run = [], ""
        for b in range(a, len(w)):
            run += (" " if run else "") + w[b]
            if len(run) > len(notice) + most:
                break
            if run[0] == notice[0] and len(run) >= len(notice) - most and (d := edit_distance(notice, run)) <= most:
                own.append((d, a, b))
        found += [min(own)] if own else []
    out = []
    for p in sorted(found):
        if all(p[1] > q[2] or p[2] < q[1] for q in out):
            out.append(p)
    return out


def test_licenses_by_edit_distance():
    rng, scanner = seeded(17), licenses.Scanner()
    names = list(licenses.NOTICES)
    texts = [
        "released under the mit licence. released under the mit license", "unlicensed under cc by nc", "Licensed under CC-BY-NC", "all rights reserveds", "all rights all rights reserved", "relicensed under the gnu general public license",
        "réleased under the mit lícense", "", "mozilla public license version 2 0 mozilla public license version 2 0mozilla public license version 2 0",
    ]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 3)):
            text = list(rng.choice(names))
            for _ in range(rng.randint(0, licenses.edits("".join(text)) + 2)):
                text[rng.randrange(len(text))] = rng.choice(["", "x", " ", "é", "qq", "e"])
            parts += [prose(rng, rng.randint(0, 3)), "".join(text), rng.choice(["", "un", "the"])]
        texts.append(rng.choice([" ", "", ". "]).join(parts))
    for text in texts:
        w, want = alnum(text), []
        for notice, label in licenses.NOTICES.items():
            want += [(label, a, b, d) for d, a, b in places_by_hand(notice, w)]
        got = scanner.scan(text)
        assert sorted((s["label"], s["first_word"], s["last_word"], s["errors"]) for s in got["spans"]) == sorted(want), text
        base = {label for p, label in licenses.BASE.items() if f" {p} " in " " + " ".join(w) + " "}
        assert got["labels"] == ",".join(sorted(base | {x[0] for x in want}))
        scores = [1 - d / len(n) for n in names for d, _, _ in places_by_hand(n, w)] + [1.0] * bool(base)
        assert got["score"] == max(scores, default=0.0)
        for s in got["spans"]:
            assert alnum(text[s["start"] : s["end"]]) == w[s["first_word"] : s["last_word"] + 1]
    assert scanner.scan("unlicensed under cc by nc")["labels"] == "cc-by" and len(scanner.scan(texts[0])["spans"]) == 2


def every_place_by_hand(notice, w):
    """(errors, first word, last word) of the places of a notice among all runs of words, whatever they begin with; best first, none that overlaps one before it."""
    most, found, out = licenses.edits(notice), [], []
    for a in range(len(w)):
        for b in range(a, len(w)):
            run = " ".join(w[a : b + 1])
            if len(run) > len(notice) + most:
                break
            if len(run) >= len(notice) - most and (d := edit_distance(notice, run)) <= most:
                found.append((d, a, b))
    for p in sorted(found):
        if all(p[1] > q[2] or p[2] < q[1] for q in out):
            out.append(p)
    return out


def test_licenses_whatever_letter_is_edited(spark, corpus):
    rng, scanner = seeded(18), licenses.Scanner(every=True)
    texts = ["Xicensed under the Apache License Version 2.0", "ll rights reserved", "unlicensed under cc by nc", "x all rights reserved s", "nu lesser general public license", "g nu lesser general public license", "redistrib "]
    for notice in licenses.NOTICES:
        texts += ["é" + notice[1:], notice[1:], "q" + notice, notice[:-1] + "q", f"{notice[1:]} {notice} {notice[:-1]}"]
        for _ in range(4):
            text = list(notice)
            for p in [0, *(rng.randrange(len(text)) for _ in range(rng.randint(0, licenses.edits(notice))))]:
                text[p] = rng.choice(["", "x", " ", "é", "qq", "e"])
            texts.append(rng.choice(["", "the ", "a "]) + "".join(text) + rng.choice(["", " a", " the end"]))
    for text in texts:
        w = alnum(text)
        want = [(label, a, b, d) for notice, label in licenses.NOTICES.items() for d, a, b in every_place_by_hand(notice, w)]
        got = scanner.scan(text)
        assert sorted((s["label"], s["first_word"], s["last_word"], s["errors"]) for s in got["spans"]) == sorted(want), text
    rows = {r["doc_id"]: r for r in licenses.op2_licenses(spark, corpus(list(enumerate(texts)))).collect()}
    assert rows[0]["labels"] == "apache-2.0" and rows[1]["labels"] == "reserved" and rows[2]["labels"] == "cc-by,cc-by-nc" and len(rows) == len(texts)
    for k, text in enumerate(texts):
        labels = {label for notice, label in licenses.NOTICES.items() if every_place_by_hand(notice, alnum(text))}
        assert labels <= set(rows[k]["labels"].split(","))


def test_licenses_in_time():
    import time

    scanner, began = licenses.Scanner(), time.process_time()
    got = scanner.scan("all rights reserved; released under the mit licence. " * 20_000)
    assert got["n_base"] == 20_000 and len(got["spans"]) == 40_000 and got["last_word"] == 8 * 19_999
    assert time.process_time() - began < 60


TEXTS = [(0, "Hello world, hello  world \n x"), (1, " lead"), (2, "trail "), (3, "a<|endoftext|> b"), (4, "tab\t x  y"), (5, "  "), (6, "don't 12 34"), (7, "漢字 ñ 😀"), (9, " "), (8, "x" * 5000 + " y" * 3000), (10, prose(seeded(5), 60_000))]


def truth():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library():
    rng, encode = seeded(6), tokens.encoder(tokens.vocabulary_path())
    same = truth()
    parts = [" ", "  ", "a", ".", ",", "\n", "a.", "\nb", "B", "é", "\n", "\x00", "Ab. cd,\nEf", "\t", "\xa0", "᠎", "\x1c", "1", "!", "'s", "<|endoftext|>", "中", "　", "\x85", "ab", "​"]
    for _ in range(1500):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(next(encode([x])), "<u4").tolist() == same(x), repr(x)


def test_token_files(spark, corpus, tmp_path):
    rows = TEXTS + [r for r in ODD if r[0] is not None]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.op4_token_orc(spark, corpus(rows)).collect()}
    start, same = 0, truth()
    for i, t in sorted(rows):
        ids = same(t)
        assert got[i] == (start, len(ids), crc(ids))
        start += len(ids)
    assert tokens.op4_token_orc(spark, corpus([])).collect() == []
    path = f"file://{tmp_path}/orc"
    tokens.write_tokens(spark.read.parquet(f"{corpus(rows)}/documents.parquet"), path)
    read = tokens.read_tokens(spark, path)
    assert [r["ids"] for r in read.where("doc_id = 4").collect()] == [same(dict(rows)[4])]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in read.where("doc_id = 4")._jdf.queryExecution().executedPlan().toString().replace("\n", "")


def test_token_file_indexes(spark, tmp_path):
    rng = seeded(18)
    docs = spark.createDataFrame([(10 * k, prose(rng, 6)) for k in range(6000)], "doc_id long, text string")
    path = f"file://{tmp_path}/orc"
    tokens.write_tokens(docs, path, rows_per_index=1000, stripe_bytes=1 << 16, parts=2)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = sorted(f"{tmp_path}/orc/{x.name}" for x in (tmp_path / "orc").iterdir() if x.name.endswith(".orc"))
    assert len(files) == 2
    for file in files:
        orc = jvm.org.apache.orc.OrcFile
        reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(file), orc.readerOptions(conf))
        rows = reader.rows()
        every = spark.sparkContext._gateway.new_array(jvm.boolean, 7)
        for k in range(7):
            every[k] = True
        index = rows.readRowIndex(0, every, every)
        assert index.getRowGroupIndex()[1].getEntryCount() >= 1 and index.getBloomFilterIndex()[1].getBloomFilterCount() >= 1
        kinds = rows.readStripeFooter(reader.getStripes()[0])
        assert kinds.getColumns(6).getKind().toString() == "DIRECT_V2"  # the ids inside the array
        assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "LZ4"
    found = tokens.read_tokens(spark, path).where("doc_id = 41230")
    assert found.count() == 1 and len(found.collect()) == 1
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 1 <= leaf.metrics().apply("numOutputRows").value() <= 1000


def test_token_files_with_null_and_equal_ids(spark, tmp_path):
    rng, same = seeded(19), truth()
    least = -(1 << 63)
    rows = [(None, prose(rng, rng.randint(0, 9))) for _ in range(200)] + [(7, prose(rng, 4)) for _ in range(200)] + [(least, "a"), (least, "b"), (8, None), (None, None), (7, "x"), (7, "x"), (3, "y")]
    rng.shuffle(rows)
    path = f"file://{tmp_path}/orc"
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, parts=6)
    read = tokens.read_tokens(spark, path)
    got = read.join(tokens.starts(read), "part").selectExpr("doc_id", "before + part_start AS start", "n_tokens", "ids", "part").collect()
    assert sorted((repr(r["doc_id"]), tuple(r["ids"])) for r in got) == sorted((repr(i), tuple(same(t))) for i, t in rows)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order) and len({r["part"] for r in got if r["doc_id"] is None}) > 1 and len({r["part"] for r in got if r["doc_id"] == 7}) > 1


def test_a_long_text_and_other_vocabularies():
    rng, same = seeded(20), truth()
    parts = [" " + prose(rng, 10_000) + rng.choice([".", ",", "!\n", "\n"]) for _ in range(60)]
    encode = tokens.Encoder(tokens.vocabulary_path())
    ids, n = encode.flat(["".join(parts), None, "", "one"])
    assert ids.tolist() == [*[x for p in parts for x in same(p)[:-1]], 0, 0, 0, *same("one")] and n.tolist()[1:3] == [1, 1]
    import json
    import tempfile

    with open(tokens.vocabulary_path(), encoding="utf-8") as f:
        other = json.load(f)
    other["pre_tokenizer"]["add_prefix_space"] = True
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
        json.dump(other, f)
        f.flush()
        encode = tokens.Encoder(f.name)
        whole = Tokenizer.from_file(f.name)
        assert not encode.cuts
        for x in ("two words, and more.\nof it", "a  b", "x"):
            assert np.frombuffer(next(encode([x])), "<u4").tolist() == [*whole.encode(x, add_special_tokens=False).ids, 0]


def test_packing_of_null_and_equal_ids(spark, corpus):
    same = truth()
    rows = [(None, "no id"), (None, None), (None, "no id"), (4, "twice"), (4, "twice"), (4, "other " * 3000)]
    got = packing.op6_packing(spark, corpus(rows)).collect()
    assert sorted((repr(r["doc_id"]), r["doc_tokens"]) for r in got if r["start"] == 0) == sorted((repr(i), len(same(t))) for i, t in rows)
    assert sum(r["length"] for r in got) == sum(len(same(t)) for _, t in rows)


def test_packing(spark, corpus):
    rng = seeded(7)
    rows = TEXTS + [(100 + k, prose(rng, rng.randint(0, 700))) for k in range(80)] + [r for r in ODD if r[0] is not None]
    same, pieces, sequences = truth(), {}, {}
    ids = {i: same(t) for i, t in rows}
    for r in packing.op6_packing(spark, corpus(rows)).collect():
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for group, sizes in ((pieces, {i: len(x) for i, x in ids.items()}), (sequences, None)):
        for key, parts in group.items():
            end = 0
            for at, n in sorted(parts):
                assert at == end and n > 0
                end += n
            assert end == sizes[key] if sizes else end <= 1024 and (end & (end - 1)) == 0
    assert packing.op6_packing(spark, corpus([])).collect() == []


def test_pack_balances_costs():
    rng = seeded(8)
    lengths = [rng.randint(1, 400) for _ in range(600)]
    rows = packing.pack(lengths)
    cost, size = Counter(), Counter()
    for _, _, n, sequence, _ in rows:
        cost[sequence] += packing.cost(n)
        size[sequence] += n
    full = [cost[s] for s in size if size[s] == 1024]
    assert sum(n for _, _, n, _, _ in rows) == sum(lengths) and max(full) < 1.6 * min(full)


PAGES = [
    (3, "http://a/ü?x=1 2", "<p>" + "same payload " * 20 + "</p>"), (1, "http://b", "<p>" + "same payload " * 20 + "</p>"), (2, None, "<p>" + "same payload " * 20 + "</p>"), (4, "u", "tiny"), (5, "u", "tiny"),
    (6, "u", None), (7, "u", ""), (8, "u\r\nX: y", "é" * 3000), (9, "u", "x" * 2_000_000), *[(20 + k, f"http://h/{k}", f"<html><body><p>page {k}</p>{'<div>menu</div>' * 20}</body></html>") for k in range(60)],
]


@pytest.mark.parametrize("few", [True, False])
def test_archives(spark, corpus, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", warc.BROADCAST_ROWS if few else 0)
    got = {r["page_id"]: r for r in warc.op5_warc(spark, corpus([], pages=PAGES)).collect()}
    least = {}
    for i, _, h in PAGES:
        least[h] = min(least.get(h, i), i)
    for i, _, h in PAGES:
        raw = (h or "").encode()
        again = len(raw) >= 100 and least[h] != i
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least[h] if again else None)
    assert warc.op5_warc(spark, corpus([])).collect() == []
    path = corpus([], pages=[*PAGES, (None, "n", "no id " * 40), (None, "n", "no id " * 40)])
    from quillmatch.llm.shared import shared_folder

    archives = warc.write_archives(spark.read.parquet(f"{path}/pages.parquet"), shared_folder(spark))
    rows = warc.read_archives(archives).collect()
    assert Counter(r["page_id"] for r in rows)[None] == 2 and len(rows) == len(PAGES) + 2
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in rows if r["payload"] is not None and r["page_id"]} == {i: h or "" for i, _, h in PAGES if not (len((h or "").encode()) >= 100 and least[h] != i)}
    file = archives.orderBy(F.desc("records")).first()["path"].removeprefix("file:")
    with open(re.sub("^/+", "/", file), "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.MAGIC


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home page of all the pages</a></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">two</ul></nav><div class="cookie-notice">We use cookies on this page, do you agree with that?</div>
<ARTICLE><h1>Title &amp; more</h1><p>First   paragraph with\n <b>bold</b> words &copy; and enough text to be found.</p><div class="ad">Buy now, it is cheap and good for all of you</div><p>Second<br>line is here, long enough as well.<p>Short.</p>
<form><label>Mail</label><input></form><section id="comments"><p>A reader's comment that is quite long and says nothing at all.</p></section></article><aside>Sidebar text</aside><footer>All &middot; rights"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more\nFirst paragraph with bold words © and enough text to be found.\nSecond line is here, long enough as well.\nShort."
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav><a>x</a></nav>") == ""
    assert html.main_text("plain text only") == "plain text only"
    body = "".join(f"<p>{'sentence of the text ' * 12}</p>" for _ in range(6))
    assert html.main_text(f"<div id=menu><a href=x>link</a></div><div class=content><h2>Head</h2>{body}</div><div class=footer>end</div>").split("\n")[0] == "Head"
    assert html.main_text("<article><p>cut off &am") == "cut off &am"
    assert html.main_text("<head><title>t</title><body><p>no end of the head") == "no end of the head"
    assert html.main_text("<article><div class='post-header'><h1>Own</h1></div><p>text</p><button>Go<p>more</p></article>") == "Own\ntext\nmore"


def test_html_query(spark, corpus):
    out = html.op10_html(spark, corpus([], pages=[(1, "u", PAGE), (2, None, None), (None, "v", "x" * 100_000)])).collect()
    assert {(r["page_id"], r["url"], r["n_chars"]) for r in out} == {(1, "u", len(html.main_text(PAGE))), (2, None, 0), (None, "v", 100_000)}
    assert html.op10_html(spark, corpus([])).collect() == []


def test_pipeline(spark, corpus):
    rng = seeded(9)
    item = prose(rng, 40)
    base = prose(rng, 200)
    rows = [
        (1, base), (2, base.replace("wak", "new", 1)), (3, prose(rng, 120) + " " + item), (4, prose(rng, 150)), (5, "too short"), (6, "x " * 200), (7, prose(rng, 90) + " ### $$$ %%% " * 30), (8, None), (9, prose(rng, 20_000)),
    ]
    path = corpus(rows, benchmark=[(0, item)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.stored(out)
        left.append({r["doc_id"] for r in docs.collect()})
    assert left == [{1, 2, 3, 4, 9}, {1, 2, 3, 4, 9}, {1, 3, 4, 9}, {1, 4, 9}]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == {1, 4, 9}
    assert corpus_pipeline.run(spark, corpus([])).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import glob
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    df = queries.queries()[name](spark, sf)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
