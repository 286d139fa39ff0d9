import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quern.operators import progress as p
from quern.sources import readers, sinks
from quern.streaming import sittings as st

D = dt.date


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 3), (2, 7), (3, 21), (4, 60), (5, 120), (6, 120)])
def test_due_in(spark, n, want):
    df = spark.createDataFrame([([0, 1], [dt.datetime(2024, 1, 1, h) for h in range(n)])], "t array<int>, r array<timestamp>")
    due = p.due_in(F.col("t"), F.lit(2), F.col("r"), F.lit("2024-01-01").cast("date"))
    assert df.select(due).first()[0] == want
    assert df.select(p.due_in(F.col("t"), F.lit(3), F.col("r"), F.lit("2024-01-01").cast("date"))).first()[0] is None


def test_merges(spark):
    df = spark.createDataFrame([([2, 1], [1, 3], list(range(8)), list(range(5, 17)), {"a": "x"}, {"a": "y", "b": "z"})], "a array<int>, b array<int>, c array<int>, d array<int>, l map<string,string>, r map<string,string>")
    row = df.select(p.merged_ticks(F.col("a"), F.col("b")), p.merged_stamps(F.col("c"), F.col("d")), p.merged_stamps(F.col("a"), F.col("b")), p.merged_picks(F.col("l"), F.col("r"))).first()
    assert tuple(row) == ([1, 2, 3], list(range(5, 17)), [1, 2, 3], {"a": "x", "b": "z"})


def test_scores(spark):
    sheet = [("one", "gs1", "A", "A"), ("one", "gs1", "B", "A"), ("two", "gs2", "CD", "D"), ("two", "gs2", "A", "B"), *[("full", "gs1", "A", "A")] * 99, ("full", "gs1", "X", "A"), ("blank", "gs1", "A", None)]
    got = {r.u: r for r in p.scored(spark.createDataFrame(sheet, "u string, code string, cell string, choice string"), group=["u"]).collect()}
    assert str(got["one"].marks) == "1.34" and str(got["two"].marks) == "1.67" and str(got["full"].marks) == "198.00"
    assert (got["full"].right, got["full"].dropped, got["full"].qualifies) == (99, 1, True) and (got["blank"].blank, got["blank"].qualifies) == (1, False)


def test_streaks_and_days(spark):
    day = lambda k: D(2024, 1, 10) - dt.timedelta(days=k)
    df = spark.createDataFrame([("u", day(4), 10), ("u", day(2), 65), ("u", day(1), 70), ("u", day(0), 5)], "u string, day date, minutes int")
    today = F.lit("2024-01-10").cast("date")
    assert p.goal_streaks(df, "u", today, 60).first().streak == 2
    assert p.goal_streaks(df.withColumn("minutes", F.when(F.col("day") == today, 61).otherwise(F.col("minutes"))), "u", today, 60).first().streak == 3
    runs = spark.createDataFrame([("u", day(0), 25, "done"), ("u", day(0), 9, "void"), ("u", day(5), 5, "done")], "u string, day date, mins int, kind string")
    dense = p.dense_days(runs, "u", F.date_sub(today, 1), today).orderBy("day").collect()
    assert [(r.minutes, r.voided) for r in dense] == [(0, 0), (25, 1)]
    order = spark.createDataFrame([("u", k, x) for k, x in enumerate(["done", "done", "void", "done"])], "u string, s int, kind string")
    assert [r.streak for r in p.run_streaks(order, "u", "s").orderBy("s").collect()] == [1, 2, 0, 1]


def attempts(spark, rights, item="i"):
    return [("u", item, k, r, dt.datetime(2024, 1, 1) + dt.timedelta(days=k)) for k, r in enumerate(rights)]


def test_ladder(spark):
    schema = "u string, item string, seq int, right boolean, on timestamp"
    of = lambda *r: p.ladder(spark.createDataFrame(attempts(spark, r), schema), ["u", "item"]).collect()
    assert of(True, True) == []
    for rights, days, step in (((False,), 1, 0), ((False, True), 3, 1), ((False, True, True), 7, 2), ((False, True, True, True), 21, 3), ((False, *[True] * 4), 60, 4)):
        row = of(*rights)[0]
        assert row.step == step and row.due == D(2024, 1, 1) + dt.timedelta(days=len(rights) - 1 + days) and not row.done
    assert of(False, *[True] * 5)[0].done and of(False, *[True] * 5, False)[0].step == 0 and not of(False, *[True] * 5, False)[0].done


def test_states_sheets_and_facets(spark):
    q = spark.createDataFrame([(1, "A"), (2, "X"), (3, "B"), (4, "C")], "n int, cell string")
    got = {r.n: r.state for r in p.states(q, spark.createDataFrame([(1,), (2,)], "n int"), spark.createDataFrame([(1,), (3,)], "n int"), ["n"]).collect()}
    assert got == {1: "answered", 2: "dropped", 3: "seen", 4: "untouched"}
    a = spark.createDataFrame([("p", "A", 1, 0, "A"), ("p", "A", 1, 1, "B"), ("p", "B", 1, 0, "C"), ("p", "A", 2, 2, None)], "paper string, set string, n int, seq int, choice string")
    assert {r.set: r.sheet for r in p.sheet(a, "paper", "set").collect()} == {"A": {1: "B"}, "B": {1: "C"}}
    t = spark.createDataFrame([("Land Reform",), ("other",)], "name string")
    assert p.searched(t, "name", "land").first().marked == "<mark>Land</mark> Reform" and p.searched(t, "name", " ").count() == 2
    r = spark.createDataFrame([("A", "A"), ("X", "A"), ("B", "A")], "cell string, choice string")
    assert p.retaken(r, "mistakes").count() == 1 and p.retaken(r, "all").count() == 0
    s = spark.createDataFrame([("p", "B"), ("p", "A"), ("q", None)], "paper string, set string")
    assert {x.paper: x.series for x in p.offered_series(s, ["paper"]).collect()} == {"p": ["A", "B"], "q": ["A", "B", "C", "D"]}
    assert p.facet(s, paper="p", set=None).count() == 2


def test_dial(value):
    assert value(p.dial(F.col("x")), x=0.2) == 1 and value(p.dial(F.col("x")), x=99.0) == 60 and value(p.dial(F.col("x")), x=24.5) == 25
    point = value(p.dial_point(F.col("x")), x=15)
    assert (round(point.x, 6), round(point.y, 6)) == (184, 100)


EVENTS = [("u", "2024-01-01 10:00", "start"), ("u", "2024-01-01 10:30", "answer"), ("u", "2024-01-01 12:01", "answer"), ("v", "2024-01-01 10:00", "start"), ("v", "2024-01-01 10:05", "answer"), ("v", "2024-01-01 11:00", "submit"), ("v", "2024-01-01 11:30", "answer")]


def events(spark, rows):
    return spark.createDataFrame([(u, dt.datetime.fromisoformat(t), k) for u, t, k in rows], "user_id string, ts timestamp, kind string")


def test_sittings_in_batch(spark):
    got = p.sittings(events(spark, EVENTS), "user_id", "ts", F.col("kind") == "start", F.col("kind") == "submit").collect()
    assert {r.user_id: (str(r.submitted), r.answers, r.ignored) for r in got} == {"u": ("2024-01-01 12:00:00", 1, 1), "v": ("2024-01-01 11:00:00", 1, 1)}


def run_stream(spark, tmp_path, batches, schema, build, mode, name):
    src = tmp_path / "in"
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").json(str(src / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src / "*"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


def test_sittings_as_a_stream_equal_the_batch(spark, tmp_path):
    later = [("z", "2024-01-01 15:00", "answer")]
    got = run_stream(spark, tmp_path, [events(spark, EVENTS[:2] + EVENTS[3:]), events(spark, later), events(spark, [("z", "2024-01-01 15:01", "answer")])], "user_id string, ts timestamp, kind string", st.sittings, "append", "sat")
    assert {r.user_id: (str(r.submitted), r.answers) for r in got} == {"u": ("2024-01-01 12:00:00", 1), "v": ("2024-01-01 11:00:00", 1)}


def test_ladder_as_a_stream(spark, tmp_path):
    rows = [("u", "i", dt.datetime(2024, 1, 1 + k), r) for k, r in enumerate([False, True, True])] + [("u", "j", dt.datetime(2024, 1, 1), True)]
    df = spark.createDataFrame(rows, "user_id string, item string, ts timestamp, right boolean")
    got = run_stream(spark, tmp_path, [df.limit(2), df.filter("item = 'i'").filter("ts > '2024-01-02 12:00:00'"), df.filter("item = 'j'")], "user_id string, item string, ts timestamp, right boolean", st.mistake_ladder, "update", "ladder")
    assert [(r.item, r.step, str(r.due)) for r in got][-1] == ("i", 2, "2024-01-10") and all(r.item == "i" for r in got)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "files": [{"u": 1, "v": None}, {"u": 2}]}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    good, bad = readers.json_batches(spark, f"{tmp_path}/*.json", "id string, files array<struct<u: int>>")
    assert [r.file for r in good.collect()] == ["a.json"] and [r.file for r in bad.select("file").collect()] == ["b.json"]
    raw = readers.raw_elements(spark, f"{tmp_path}/a.json", "files").orderBy("seq").select(F.json_object_keys("raw")).collect()
    assert [r[0] for r in raw] == [["u", "v"], ["u"]]
    names = spark.createDataFrame([("x.pdf", 1), ("x.pdf", 2), ("y", 3), ("y", 4)], "name string, seq int")
    assert [r.free_name for r in sinks.free_names(names).orderBy("seq").collect()] == ["x.pdf", "x (2).pdf", "y", "y (2)"]
    sinks.export_document(names.limit(1), str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == [{"name": "x.pdf", "seq": 1}]
    sinks.snapshot(names, str(tmp_path / "s"))
    sinks.snapshot(names.limit(1), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    assert {r.name for r in readers.listing(spark, f"{tmp_path}/*.json", without=("b.json",)).collect()} == {"a.json", "out.json"}


PAGE = """<table><caption>Civil Services (Main) Examination, 2023</caption><ul><li>General Studies Paper - II <a href="/gs2.pdf">x</a></li>
<li>General Studies Paper-2 <a href="/again.pdf">x</a></li><li>Essay<a href="https://e/essay.pdf">x</a></li><li>Agricultural Paper - I<a href="/ag1.pdf">x</a></li><li>none</li></ul></table><table><li>Essay<a href="/no.pdf"></a></li></table>"""


def test_scraping(spark, value):
    docs = spark.createDataFrame([(PAGE,)], "html string")
    got = {(r.kind, r.year, r.code): r.url for r in readers.exam_papers(docs, "html", base="https://b").collect()}
    assert got == {("mains", 2023, "gs2"): "https://b/gs2.pdf", ("mains", 2023, "essay"): "https://e/essay.pdf"}
    assert [tuple(r) for r in readers.optional_papers(docs, "html", {"agriculture": "Agricultur(?:e|al)"}).collect()] == [("agriculture", 2023, "p1", "/ag1.pdf")]
    assert readers.links(docs.withColumn("k", F.lit(1)), "k", "html", base="https://b").count() == 5
    split = readers.split_pages(spark.createDataFrame([("d", "intro\n=== page 3 ===\none\n=== page ===\ntwo ( 4 - A )")], "d string, t string"), "d", "t")
    assert [(r.page, r.text.split()[0]) for r in split.orderBy("pos").collect()] == [(None, "intro"), (3, "one"), (4, "two")]
    assert value(readers.embedded_payload(F.col("t"), "QUIZ", "struct<a: int>"), t='x\nconst QUIZ = {"a": 7};\ny').a == 7
    assert value(readers.unescaped_markdown(F.col("t")), t="1\\. a \\[5\\]") == "1. a [5]"
