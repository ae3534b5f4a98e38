from pyspark.sql import functions as F

import pytest

from quillmatch.functions import rules, text
from quillmatch.functions.literals import alternatives, required
from quillmatch.operators import layout
from quillmatch.plans import profile as p


def classify(spark, profile, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, content string, subject string")
    out = df.select("k", rules.classified(profile, F.col("content"), F.col("subject")).alias("c")).orderBy("k").collect()
    return [(r["c"]["category"], r["c"]["matched_rule"]) for r in out]


def made(*conditions, **more):
    return p.profile_of({"meta": {"name": "t"}, "domain_codes": ["DM", "VS"], "classification_rules": [{"conditions": c, "category": f"c{k}"} for k, c in enumerate(conditions)]} | more)


def test_standard_rules(spark):
    rows = [("DM (Demographics)", "DM"), ("  ", "x"), ("BRTHDTC", "DM"), ("x", "Sticky Note"), ("a [Not Submitted]", ""), ("a\r\nb", "VS"), ("Note: RELREC applies", "AE"), ("see page 4", ""), (None, None)]
    got = [c for c, _ in classify(spark, p.standard_profile(), rows)]
    assert got == ["domain_label", "_exclude", "sdtm_mapping", "_exclude", "not_submitted", "note", "note", "sdtm_mapping", "_exclude"]


def test_conditions_are_anded_and_first_match_wins(spark):
    profile = made({"contains": "a", "min_length": 3}, {"contains": "A"}, {})
    assert classify(spark, profile, [("aaa", ""), ("a", ""), ("b", "")]) == [
        ("c0", "Rule 1: min_length=3, contains='a'"),
        ("c1", "Rule 2: contains='A'"),
        ("c2", "Rule 3: conditions"),
    ]


def test_no_rule_holds(spark):
    assert classify(spark, made({"subject_is": "q"}), [("a", "b")]) == [("sdtm_mapping", "Rule 2: ultimate fallback (no rule matched)")]


def test_domain_in_needs_a_group_and_case(spark):
    profile = made({"regex": r"^(\w+) x", "domain_in": "domain_codes"}, {"domain_in": "domain_codes"}, {"regex": "^y", "domain_in": "domain_codes"})
    assert [c for c, _ in classify(spark, profile, [("DM x", ""), ("dm x", ""), ("y", "")])] == ["c0", "sdtm_mapping", "sdtm_mapping"]


def test_regex_is_python_like(spark):
    profile = made({"regex": r"^\w+$"}, {"regex": "^a.b$"})
    assert [c for c, _ in classify(spark, profile, [("É1", ""), ("a\rb", "")])] == ["c0", "c1"]


def test_visits(spark):
    df = spark.createDataFrame([("Week 24 Assessment",), ("screen",), ("Baseline Week 3",), ("none",)], "t string")
    out = [r["v"] for r in df.select(rules.visit(p.standard_profile().visit_rules, F.col("t")).alias("v")).collect()]
    assert out == ["Week 24", "Screening", "Baseline", ""]


@pytest.mark.parametrize("raw", [{"conditions": {"regex": "("}, "category": "x"}, {"conditions": {"unknown": 1}, "category": "x"}])
def test_bad_rules(raw):
    with pytest.raises(ValueError):
        p.profile_of({"meta": {"name": "t"}, "domain_codes": [], "classification_rules": [raw]})


def test_merge_and_inheritance(tmp_path):
    (tmp_path / "base.yaml").write_text("meta: {name: base}\ndomain_codes: [DM]\nclassification_rules: [{conditions: {fallback: true}, category: note}]\nmatching_config: {visit_boost: 2}\n")
    (tmp_path / "child.yaml").write_text("meta: {name: child, parent: base}\ndomain_codes: {_append: [VS]}\n")
    (tmp_path / "loop.yaml").write_text("meta: {name: loop, parent: loop}\n")
    (tmp_path / "lost.yaml").write_text("meta: {name: lost, parent: nowhere}\n")
    child = p.load_profile(tmp_path / "child.yaml")
    assert child.domain_codes == ["DM", "VS"] and child.matching_config.visit_boost == 2 and child.meta["name"] == "child"
    with pytest.raises(ValueError):
        p.load_profile(tmp_path / "loop.yaml")
    with pytest.raises(FileNotFoundError):
        p.load_profile(tmp_path / "lost.yaml")
    assert p.list_profiles(tmp_path) == ["base", "child", "loop", "lost"]
    assert p.merged({"a": [1, 2]}, {"a": {"_replace": [3], "_append": [4]}}) == {"a": [1, 2, 4]}


def test_list_delta_and_save(tmp_path):
    assert p.list_delta([1], [1]) is None and p.list_delta([1], [1, 2]) == {"_append": [2]} and p.list_delta([1], [2]) == {"_replace": [2]}
    (tmp_path / "base.yaml").write_text("meta: {name: base}\ndomain_codes: [DM]\nclassification_rules: [{conditions: {fallback: true}, category: note}]\n")
    (tmp_path / "child.yaml").write_text("meta: {name: child, parent: base}\nown_key: 5\n")
    draft = p.inherited(p.read_raw(tmp_path / "child.yaml"), tmp_path)
    draft["domain_codes"] = ["DM", "AE"]
    assert p.save_profile(tmp_path, "child", draft).domain_codes == ["DM", "AE"]
    assert p.read_raw(tmp_path / "child.yaml")["domain_codes"] == {"_append": ["AE"]}
    with pytest.raises(ValueError):
        p.safe_name("../x")


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        (r"^Codelist\b", None), (r"\bCodelist\b|x-y", ("codelist", "x-y")), (r"\b(Jan|Feb|Mar|Apr|May|Jun)\s+\d{1,2},", (",",)), (r"\bPage\s+\d+\s+of\s+\d+\b", ("page",)), (r"_{3,}", ("___",)), (r"See\s+(page|pg\.?)\s*\d+|Refer\s+to", ("refer", "see")), (r"^\w+$", None),
        (r"(abc)?d*", None), (r"[xy]+z", ("z",)), (r"(?:ab|c)+", ("ab", "c")), (r"(?:ab|c?)x?", None), (r"[□☐]|é", None), (r"(?<name>x)", None), (r"\Qab\E", None), ("ﬁx|K", ("k", "x")),
    ],
)
def test_required_literals(pattern, literals):
    assert required(pattern) == literals


@pytest.mark.parametrize(
    ("pattern", "parts"),
    [("a|b", ["a", "b"]), ("(a|b)|c", ["(a|b)", "c"]), (r"a\|b|[|]c|[]|]|[^]|]d", [r"a\|b", "[|]c", "[]|]", "[^]|]d"]), ("(?i)a|b", ["(?i)a|b"]), (r"(a)\1|b", [r"(a)\1|b"]), (r"(?:a|b)x|\Qy", [r"(?:a|b)x|\Qy"]), ("|a", ["", "a"])],
)
def test_alternatives(pattern, parts):
    assert alternatives(pattern) == parts


def test_literals_change_no_result(spark):
    import random

    rng = random.Random(8)
    patterns = [x for x in (layout.CODELIST, layout.DATE, layout.CHECKBOX, layout.TEXT_FIELD, *p.standard_profile().form_name_rules.exclude_patterns, *(r.regex for r in p.standard_profile().visit_rules), r"ſk|site", r"(is|ka)+x", r"\d\s*of|^x|[☐/]")]
    bits = ["Codelist", "٣", " 7of", "x", "codeliſt", "İs", "ısx", "SİTE", "ſite", "Kax", "kax", "Page", " 1 ", "of", "2", "/", "_", "___", "yes", "no", "YES", "MM", "dd", "yyyy", "Week", "week 4", "WEEK", "screen", "Baſeline", "Study", "ſtudy", "Deſign :", "☐", "é", "\n", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(texts)], "k int, s string")
    columns = [text.found(F.col("s"), x).alias(f"a{j}") for j, x in enumerate(patterns)] + [F.col("s").rlike(text.FLAGS + x).alias(f"b{j}") for j, x in enumerate(patterns)]
    assert sum(required(x) is not None for x in patterns) > 4
    for r in df.select("s", *columns).collect():
        for j, x in enumerate(patterns):
            assert r[f"a{j}"] == r[f"b{j}"], (x, r["s"])


def test_strip(spark):
    texts = ["", " ", "a", " a b\n", "　x ", "\x85\x0b\x0cy\x1c", "​z"]
    old = F.regexp_replace(F.col("s"), r"(?U)^\s++|(?<!\s)\s++$", "")
    assert all(r["a"] == r["b"] for r in spark.createDataFrame([(s,) for s in texts], "s string").select(text.strip(F.col("s")).alias("a"), old.alias("b")).collect())
