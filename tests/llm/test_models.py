"""Whitening, fill-in-middle and toxicity, against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import infill, toxicity, whitening

from .brute import ODD, prose, seeded

SCHEMA = "vec_id long, embedding array<float>, label int, x string, at string, n string"


def embeddings(spark, tmp_path, vectors):
    rows = [(k, v, 0, "x", "y", "z") for k, v in vectors]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def plain_whitening(rows, k):
    x = np.floor(64 * np.array(rows, np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    far = [[n * int(v) - int(t) for v, t in zip(row, s, strict=True)] for row in x]
    return c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n), [sum(v * v for v in row) for row in far]


def test_whitening_against_dense(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = (rng.standard_normal((300, 40)) * np.linspace(3, 0.3, 40)).astype(np.float32).tolist()
    bad = [(900, None), (901, [1.0, None] + [0.0] * 38), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] + [0.0] * 39), (904, [])]
    out = whitening.op11_whitening(spark, embeddings(spark, tmp_path, [*enumerate(rows), (7, rows[0]), (None, rows[1]), *bad])).toPandas()
    rows = [*rows, rows[0], rows[1]]
    white, share, far = plain_whitening(rows, 32)
    assert len(out) == 302 * 32 and set(out["n"]) == {302} and out["identity_error"].nunique() == 1 and out["identity_error"].max() < 1e-9
    for j in range(32):
        own = out[out["component"] == j + 1]
        assert np.allclose(own["explained"], share[j], rtol=1e-9)
        got = own[own["vec_id"].between(8, 299)].sort_values("vec_id")
        sign = np.sign(got["whitened"].to_numpy() @ white[8:300, j])
        assert np.allclose(got["whitened"], sign * white[8:300, j], atol=1e-8) and got["deviation"].tolist() == far[8:300]
        same = sorted(own[own["vec_id"] == 7]["whitened"] * sign)
        assert np.allclose(same, sorted([white[7, j], white[300, j]]), atol=1e-8) and np.allclose(own[own["vec_id"].isna()]["whitened"] * sign, white[301, j], atol=1e-8)


def test_whitening_in_passes(spark, tmp_path):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    rows = (rng.standard_normal((500, 60)) * 0.85 ** np.arange(60) * 50 @ turn).tolist()
    vectors = whitening.whole_vectors(spark.read.parquet(f"{embeddings(spark, tmp_path, enumerate(rows))}/embeddings.parquet"))
    fit = whitening.fitted(vectors, k=3, block=12)
    white, share, _ = plain_whitening(rows, 3)
    got = np.array([r["whitened"] for r in whitening.whitened(vectors, fit).orderBy("vec_id").collect()])
    assert 3 < fit.passes < 60 and np.allclose(fit.values / fit.trace, share, rtol=1e-10)
    assert np.allclose(np.abs((got * white).mean(axis=0)), 1, atol=1e-9) and whitening.identity_error(vectors, fit) < 1e-9
    with pytest.raises(RuntimeError):
        whitening.fitted(vectors, k=3, block=4, passes=2)


def test_whitening_of_few(spark, tmp_path):
    run = lambda v: whitening.op11_whitening(spark, embeddings(spark, tmp_path, v))
    assert run([]).collect() == [] and run([(1, None)]).collect() == [] and run([(1, [0.5, 1.0])]).collect() == []
    assert run([(k, [0.5, 1.0]) for k in range(9)]).collect() == []
    flat = run([(k, [float(k), 2.0 * k, 1.0]) for k in range(9)]).toPandas()  # one dimension has variance
    assert set(flat["component"]) == {1} and np.allclose(flat["explained"], 1) and flat["identity_error"].max() < 1e-9
    with pytest.raises(ValueError):
        run([(1, [1.0, 2.0]), (2, [1.0])])
    with pytest.raises(OverflowError):
        run([(k, [k * 1e16, 1.0]) for k in range(9)])


def plain_cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def test_infill_against_slices(spark, corpus):
    rng = seeded(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [(k, prose(rng, rng.randint(0, 60), ["a", "é", "😀", "é", "<P", "S>", "\r\n", "日本"])) for k in range(120)]
    rows += [(200, "x<P>y"), (201, "<<M>"), (202, "<"), (203, "é" * 300_000), (5, "again"), (5, "again"), (None, "no id"), *ODD]
    got = sorted((tuple(r) for r in infill.op12_infill(spark, corpus(rows)).collect()), key=repr)
    want = [(i, *plain_cut(i, t)[:4], sha(plain_cut(i, t)[4]), sha(t or "")) for i, t in rows]
    assert got == sorted(want, key=repr) and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.op12_infill(spark, corpus([])).collect() == []


def test_units_are_matched_lazily():
    rng = random.Random(4)
    for unit in (infill.CODE_POINTS, infill.WORDS, r"\w+|\W"):
        units = infill.Units(unit)
        for n in (0, 1, 7, 4096, 4097, 9000):
            text = "".join(rng.choice("ab é\n") for _ in range(n))
            ends = [m.end() for m in __import__("re").finditer(unit, text)]
            assert units.count(text) == len(ends)
            ranks = sorted(rng.randint(0, len(ends)) for _ in range(4))
            assert units.ends(text, *ranks) == [ends[r - 1] if r else 0 for r in ranks]
    seen = []
    units = infill.Units(infill.WORDS)
    units.find = lambda text: (seen.append(m) or m for m in __import__("re").finditer(infill.WORDS, text))
    units.ends("w " * 1000, 3, 5)
    assert len(seen) == 5


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("You 1D10T!", "you idiot"), ("ѕtuріd", "stupid"), ("m0r0n5 4ever", "morons aever"), ("l​oser­ish", "loserish"), ("ｓｃｕｍ", "scum"), ("The$$$ on*** 100% in 2024", "the on in"),
        ("$cum b@d", "scum bad"), ("réeux ÉTÉ é", "réeux été é"), ("snake_case don't", "snake case don t"), ("", ""), (None, ""), ("123 $$$ !!", ""),
    ],
)
def test_folding(text, words):
    assert toxicity.folded(text).split() == words.split() and toxicity.folded(text) == (f" {words} " if words else " ")


def toxic_corpus(rng):
    """Rows (doc_id, text) and labels: insults that are in no list, a family of words, and phrases in which one of them is harmless."""
    rows, labels = [], []
    for k in range(1200):
        said = prose(rng, rng.randint(20, 200)).split()
        toxic = k % 6 == 0
        for _ in range(rng.randint(1, 3) * toxic):
            said.insert(rng.randrange(len(said)), rng.choice(["grublin", "snorf", "vexu" + rng.choice(["ta", "lo", "mir", "ko"]) + rng.choice("abcde")]))
        if not toxic and k % 10 == 1:
            said.insert(rng.randrange(len(said)), "snorf machine")
        rows.append((k, " ".join(said)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_words_families_and_exceptions(spark, corpus, tmp_path):
    rows, labels = toxic_corpus(seeded(5))
    more = [(5000, "calm words here ɡrubl1n then more calm words"), (5001, "calm words snorf machine more calm words"), (5002, "calm vexuneva words and more"), (5003, None), (5004, ""), (5005, "grublin " * 50_000), (5005, "all fine"), (None, "you idiot")]
    path = corpus(rows + more)
    spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out = toxicity.op13_toxicity(spark, path).collect()
    assert len(out) == len(rows) + len(more) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    truth = {k: t for k, _, t in labels}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and np.mean([p == t for p, t in held]) > 0.98
    of = {r["doc_id"]: r["predicted"] for r in out if r["doc_id"] != 5005}
    assert [of[k] for k in (5000, 5001, 5002, 5003, 5004, None)] == [1, 0, 1, 0, 0, 1]
    assert sorted(r["predicted"] for r in out if r["doc_id"] == 5005) == [0, 1]
    model = toxicity.learned(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    entries = {e[0] for e in model.entries}
    assert {" grublin ", " snorf ", " vexu"} <= entries and " gru" not in entries and " snorf machine " in model.phrases


def test_toxicity_doesnt_read_held_out_labels(spark, corpus):
    rows, labels = toxic_corpus(seeded(6))
    path = corpus(rows[:400])
    import zlib

    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, q, t in labels[:400]]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    one, two = (toxicity.learned(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels[:400], flipped))
    assert one == two or (one.entries == two.entries and np.allclose(one.terms, two.terms))


def test_toxicity_without_labels(spark, corpus):
    path = corpus([(1, "what an idiot"), (2, "a fine day"), *ODD])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in toxicity.op13_toxicity(spark, path).collect()}
    assert got[1] > 0.3 > got[2]
    empty = corpus([])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{empty}/labels.parquet")
    assert toxicity.op13_toxicity(spark, empty).collect() == []


def test_logistic_against_search():
    rng = np.random.default_rng(7)
    x = np.hstack([np.ones((400, 1)), rng.standard_normal((400, 2))])
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [-1, 2, 0.5])))).astype(float)
    terms = toxicity.logistic(x, y)
    loss = lambda t: np.logaddexp(0, x @ t).sum() - y @ (x @ t) + 0.025 * (t[1:] ** 2).sum()
    assert all(loss(terms) <= loss(terms + d) for d in 1e-3 * rng.standard_normal((50, 3)))
    assert math.isfinite(float(toxicity.logistic(x, (x[:, 1] > 0).astype(float)).sum()))
    assert F is not None
