import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.operators import quality

SUBJECT = {"id": "s", "name": "S", "short": "S", "icon": "i", "topics": []}
TOPIC = {"id": "t1", "name": "T", "weight": "high", "papers": ["gs1"], "subtopics": ["a"]}
QUESTION = {"seq": 1, "id": "q1", "topic": "t1", "q": "A question that is long enough to be compared", "options": ["x", "y"], "answer": 0, "passage": None, "paper": None, "source": Row(name="I")}
Q = "seq int, id string, topic string, q string, options array<string>, answer int, passage string, paper struct<year int, code string, set string, n int>, source struct<name string>"


def topic_tables(spark, subjects, topics):
    s = spark.createDataFrame([(x.get("id"), json.dumps(x)) for x in subjects], "id string, raw string")
    t = spark.createDataFrame([(x.get("id"), x.get("weight"), x.get("papers"), x.get("subtopics"), json.dumps(x)) for x in topics], "id string, weight string, papers array<string>, subtopics array<string>, raw string")
    return s, t


def rules(df):
    return sorted({r.rule for r in df.collect()})


@pytest.mark.parametrize(
    ("change", "broken"),
    [({}, []), ({"weight": "huge"}, ["V3"]), ({"papers": ["gs9"]}, ["V3"]), ({"papers": []}, ["V4"]), ({"subtopics": []}, ["V4"])],
)
def test_topic_rules(spark, change, broken):
    s, t = topic_tables(spark, [SUBJECT], [{**TOPIC, **change}])
    assert rules(quality.violations(quality.topic_rules(s, t))) == broken


def test_absent_key_and_null_differ(spark):
    lost = {k: v for k, v in TOPIC.items() if k != "name"}
    s, t = topic_tables(spark, [{**SUBJECT, "icon": None}], [lost, TOPIC, TOPIC])
    found = quality.violations(quality.topic_rules(s, t)).collect()
    assert [(r.rule, r.entity) for r in found if r.rule == "V1"] == [("V1", "topic")]
    assert [r.message for r in found if r.rule == "V2"] == ["occurs 3 times"]


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, []), ({"topic": "zz"}, ["V7"]), ({"options": ["x"]}, ["V8"]), ({"options": ["x", " "]}, ["V8"]), ({"options": ["x", " x"]}, ["V8"]), ({"answer": 2}, ["V9"]), ({"answer": None}, ["V9"]),
        ({"q": "  "}, ["V10"]), ({"source": Row(name=" ")}, ["V11"]), ({"paper": Row(year=2020, code="gs1", set="A", n=1)}, ["V11"]), ({"passage": "nope"}, ["V6"]),
    ],
)
def test_question_rules(spark, change, broken):
    _, t = topic_tables(spark, [SUBJECT], [TOPIC])
    q = spark.createDataFrame([tuple({**QUESTION, **change}.values())], Q)
    p = spark.createDataFrame([], "id string, text string")
    assert rules(quality.violations(quality.question_rules(q, t, p))) == broken


def test_stems_passages_and_ids(spark):
    _, t = topic_tables(spark, [SUBJECT], [TOPIC])
    rows = [{**QUESTION, "seq": k, "id": i, "q": text, "passage": p} for k, (i, text, p) in enumerate([("a", QUESTION["q"], None), ("b", QUESTION["q"].upper(), None), ("c", QUESTION["q"], "p1"), ("c", "short", None), ("d", "short", None)])]
    q = spark.createDataFrame([tuple(r.values()) for r in rows], Q)
    p = spark.createDataFrame([("p1", "text"), ("p2", "unused")], "id string, text string")
    found = {(r.rule, r.key) for r in quality.violations(quality.question_rules(q, t, p)).collect()}
    assert found == {("V13", "b"), ("V5", "c"), ("V12", "p2")}


def test_paper_tags(spark):
    tag = lambda i, n, a, s="A", y=2020: tuple({**QUESTION, "id": i, "answer": a, "source": None, "paper": Row(year=y, code="gs1", set=s, n=n)}.values())
    q = spark.createDataFrame([tag("ok", 1, 0), tag("multi", 3, 3), tag("wrong", 1, 1, "B"), tag("drop", 2, 0), tag("past", 9, 0), tag("set", 1, 0, "Z"), tag("year", 1, 0, "A", 1999), tag("again", 1, 0)], Q)
    keys = spark.createDataFrame([(2020, "gs1", "A", ["A", "X", "CD"]), (2020, "gs1", "B", ["A", "A", "A"])], "year int, code string, set string, letters array<string>")
    found = {(r.rule, r.key) for r in quality.violations(quality.paper_tag_rules(q, keys)).collect()}
    assert found == {("V14", "set"), ("V14", "year"), ("V16", "past"), ("V17", "wrong"), ("V17", "drop"), ("V15", "2020|gs1|A|1")}


def test_key_rules(spark):
    raw = json.dumps({"questions": 3, "correct": 2, "wrong": -0.66, "total": 6})
    marking = spark.createDataFrame([("gs1", 3, raw), ("gs2", 2, "{}")], "code string, questions int, raw string")
    keys = spark.createDataFrame([(2020, "gs1", "A", ["A", "X", "CD"], 1), (2020, "gs1", "B", ["A", "E"], 1), (2020, "gs9", "A", ["A"], None)], "year int, code string, set string, letters array<string>, dropped_count int")
    found = {(r.rule, r.key) for r in quality.violations(quality.key_rules(marking, keys)).collect()}
    assert found == {("V18", "gs2"), ("V18", "gs9"), ("V19", "2020|gs1|B"), ("V20", "2020|gs1|B"), ("V21", "2020|gs1|B")}


def test_copies_publishers_optionals_daily(spark):
    c = "id string, name string, rank int, year int, subject string, publisher string, url string, medium string, files array<struct<paper string, url string>>, raw string"
    full = json.dumps(dict.fromkeys(("name", "rank", "year", "publisher", "url"), 1))
    row = lambda i, **k: tuple({**{"id": i, "name": "N", "rank": 1, "year": None, "subject": "law", "publisher": "P", "url": f"https://x/{i}", "medium": None, "files": None, "raw": full}, **k}.values())
    copies = spark.createDataFrame([row("a"), row("b"), row("c", rank=None, name="नाम"), row("d", rank=0, url="http://x"), row("e", rank=7, files=[("I", "https://x/e")]), row("f", rank=8, medium="Hindi", raw="{}")], c)
    publishers = spark.createDataFrame([("P", "https://p"), ("", "https://q")], "name string, url string")
    found = {(r.rule, r.key) for r in quality.violations(quality.copy_rules(copies, publishers)).collect()}
    assert found == {("V27", "null|1"), ("V25", "c"), ("V26", "d"), ("V26", "e"), ("V25", "f"), ("V29", "")}
    daily = spark.createDataFrame([("a", "https://x/{yyyy}/{month}", [0], 5), ("b", "https://x/{yy}", [7], 0)], "id string, url string, skips array<int>, questions int")
    assert {(r.rule, r.key) for r in quality.violations(quality.daily_rules(daily)).collect()} == {("V30", "b"), ("V31", "b")}
    assert rules(quality.violations(quality.daily_rules(daily.limit(0)))) == ["V24"]
    o = spark.createDataFrame([("law", json.dumps({"id": 1, "name": 1, "short": 1, "icon": 1}))], "id string, raw string")
    y = spark.createDataFrame([("law", 2020, ["p1", "p2"]), ("law", 2021, ["p1"]), ("law", 2021, ["p1", "p2"])], "id string, year int, codes array<string>")
    s = spark.createDataFrame([("law", ["Paper I", "Paper II"], ["a", " "])], "id string, papers array<string>, topics array<string>")
    assert rules(quality.violations(quality.optional_rules(o, y, s))) == ["V22", "V23"]


def test_option_problems_and_flags(spark):
    rows = [(["1 only", "2 only", "1 and 2 only", "3 and 1 only"],), (["1 only", "2 only", "12 only", "1 ands"],), (["a", "b", "c", "a"],), (["3-1-2", "1-2-3", "2-8-1", "x"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "options array<string>").select(quality.option_problems()).collect()]
    assert got == [["statements out of order: 3 and 1 only"], ["a statement number past 9: 12 only", "not a statement reference: 1 ands"], ["options not distinct and non-empty"], ["not a permutation: 2-8-1"]]
    df = spark.createDataFrame([("short", ["a", "b", ""], False, "X")], "q string, options array<string>, read boolean, cell string")
    assert df.select(quality.review_flags()).first()[0] == ["3 options", "stem looks cut", "an empty option", "number inferred", "dropped"]
    d = spark.createDataFrame([("see the figure | of the author", ["a", "b", "c", "d"], None, False, "CD"), ("fine", ["a", "b", "c", "d"], None, True, "A")], "q string, options array<string>, passage string, in_group boolean, cell string")
    assert [r[0] for r in d.select(quality.draft_flags()).collect()] == [["key CD", "figure or table", "odd characters", "mentions a passage but has none"], ["in a passage group with no passage found"]]
    s = spark.createDataFrame([("1. a 2. b", ["1 and 83 only", "2 only"])], "q string, options array<string>")
    assert s.select(quality.stray_statement()).first()[0] == [83]


def test_gates_and_reasons(spark):
    rows = spark.range(3)
    assert quality.all_or_nothing(rows, rows.limit(0)).count() == 3 and quality.all_or_nothing(rows, rows).count() == 0
    got = {r.reason: r.n for r in quality.by_reason(rows, F.when(F.col("id") == 1, "one")).collect()}
    assert got == {"one": 1, "accepted": 2}
    t = spark.createDataFrame([("__A__ __B__",)], "text string")
    assert [r.key for r in quality.template_tokens(t, spark.createDataFrame([("__A__",)], "token string")).collect()] == ["__B__"]
