import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import furniture, ingest, match, sequences


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_key_letters(spark):
    q = spark.createDataFrame([(2020, "gs1", "A", n) for n in (1, 2, 3, 9)], "year int, code string, set string, n int")
    k = spark.createDataFrame([(2020, "gs1", "A", ["B", "X", "CD"])], "year int, code string, set string, letters array<string>")
    assert rows(match.key_letters(q, k).select("n", "cell", "answer")) == [(1, "B", 1), (2, "X", None), (3, "CD", None), (9, None, None)]


def test_lookups(spark):
    r = spark.createDataFrame([("a", None), ("b", "x")], "k string, url string")
    assert rows(match.fill_missing(r, spark.createDataFrame([("a", "f"), ("b", "g")], "k string, url string"), ["k"], "url")) == [("a", "f"), ("b", "x")]
    assert rows(match.overridden(r, spark.createDataFrame([("b", "read")], "k string, url string"), "k", "url")) == [("a", None), ("b", "read")]
    draft = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n int, q string")
    review = spark.createDataFrame([(1, True, None, None), (2, None, "t", "better"), (7, None, "t", "lost")], "n int, skip boolean, topic string, q string")
    assert rows(match.reviewed(draft, review, columns=("topic", "q")).select("n", "status", "q")) == [(1, "skipped", "a"), (2, "kept", "better"), (3, "unread", "c"), (7, "added", "lost")]


def test_aligned_readings(spark):
    a = spark.createDataFrame([(1, "Which of the following is correct"), (2, "quite other words here"), (3, "only here")], "n int, q string")
    b = spark.createDataFrame([(1, "Which of the foll0wing is corect"), (2, "zzz"), (4, "only there")], "n int, q string")
    got = {r.n: (r.verdict, r.ratio) for r in match.aligned_readings(a, b).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "agree", 2: "differ", 3: "only_left", 4: "only_right"}
    assert got[1][1] == SequenceMatcher(None, "which of the following is correct", "which of the foll0wing is corect").ratio()


def test_aggregates(spark):
    r = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4), ("h", "c", 5)], "g string, v string, s int")
    assert rows(match.modes(r, ["g"], "v", "s")) == [("g", "b", 2), ("h", "c", 1)]
    m = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 9)], "g string, v int")
    assert rows(match.upper_medians(m, "g", "v")) == [("a", 3), ("b", 3)]
    n = spark.createDataFrame([("p", 1), ("p", 3)], "g string, n int")
    assert rows(match.missing_numbers(n, "g", "n", F.lit(4))) == [("p", 2), ("p", 4)]
    c = spark.createDataFrame([(1, "हिंदी abc", 1), (1, "english", 2), (2, "x", 3)], "n int, body string, s int")
    assert rows(match.best_copies(c, "n", "body", "s")) == [(1, "english"), (2, "x")]


def test_rank_topics_by_hand(spark):
    import math

    topics = spark.createDataFrame([("polity-1", "Parliament sessions", "Polity", ["budget session"]), ("polity-2", "President powers", "Polity", []), ("geo-1", "Monsoon winds", "Geography", ["parliament"])], "id string, name string, subject string, subtopics array<string>")
    bags = match.term_bags(topics)
    tf = {(r.topic, r.term): r.tf for r in bags.collect()}
    assert tf["polity-1", "parliament"] == 3 and tf["geo-1", "parliament"] == 1 and tf["polity-1", "polity"] == 1
    q = spark.createDataFrame([(1, "monsoon monsoon monsoon monsoon", None), (2, "monsoon", "polity"), (3, "of the and", None)], "id int, text string, subject string")
    got = match.rank_topics(q, bags, 3, subject="subject").collect()
    assert [(r.id, r.topic) for r in got] == [(1, "geo-1")]
    assert abs(got[0].score - 3 * math.log(4) * math.log(3 / 2)) < 1e-12 and got[0].lead == 9.9 and got[0].weak


def test_ranks_ignore_the_order_of_words(spark):
    from itertools import permutations

    df = {"ash": 4, "birch": 7, "cedar": 1, "dogwood": 1, "elm": 1}  # ln 40 + ln 25 + ln 100 is 2.5 ln 100: a lead of 1.25 but for the last bit
    topics = {"t-1": ("ash", "birch", "cedar"), "t-2": ("dogwood", "elm")}
    bags = [(t, w, 3) for t, words in topics.items() for w in words] + [(f"x-{w}-{k}", w, 3) for w, n in df.items() for k in range(n - 1)]
    bags = spark.createDataFrame(bags, "topic string, term string, tf int")
    q = spark.createDataFrame([(k, " ".join(p), "t") for k, p in enumerate(permutations(df))], "id int, text string, subject string")
    for small in (1000, 0):
        got = match.rank_topics(q, bags, 200, subject="subject", small=small).filter("rank = 1").collect()
        assert len(got) == 120 and len({(r.topic, r.score, r.lead, r.weak) for r in got}) == 1
    assert got[0].topic == "t-1" and abs(got[0].lead - 1.25) < 1e-12


def test_passages_pages_and_furniture(spark):
    r = spark.createDataFrame([("d", 1, "p1", 2), ("d", 2, None, None), ("d", 3, None, None)], "g string, n int, pid string, items int")
    assert rows(match.carried_passage(r, group="g").select("n", "passage")) == [(1, "p1"), (2, "p1"), (3, None)]
    q = spark.createDataFrame([(7, "Consider the following")], "n int, q string")
    lines = spark.createDataFrame([("7. Other text", 0, 1), ("7. Consider the following", 1, 2), ("7. Consider the following", 2, 3)], "line string, idx int, page int")
    assert rows(match.start_pages(q, lines)) == [(7, 2)]
    docs = spark.createDataFrame([(1, "head\na\nhead"), (2, "head\nb"), (3, None), (4, "c")], "id int, text string")
    f = furniture.repeated_lines(docs, "id", "text", min_share=0.4)
    assert rows(f) == [("head", 2)] and rows(furniture.without_lines(docs, "id", "text", f).select("id", "line")) == [(1, "a"), (2, "b"), (4, "c")]


def shuffled(a, size, order):
    parts = [a[i : i + size] for i in range(0, len(a), size)]
    return "".join(parts[k] for k in order)


def test_even_blocks(spark):
    rnd = random.Random(3)
    for size, n in ((25, 100), (10, 100), (5, 100), (20, 80)):
        a = "".join(rnd.choice("ABCD") for _ in range(n))
        orders = [rnd.sample(range(n // size), n // size) for _ in range(3)]
        papers = spark.createDataFrame([("p", a, *[shuffled(a, size, o) for o in orders])], "paper string, A string, B string, C string, D string")
        got = papers.select(sequences.largest_block(F.col("A"), [F.col(s) for s in "BCD"]), sequences.permutation(F.col("A"), F.col("B"), size), sequences.mapped_number(F.lit(size + 1), sequences.permutation(F.col("A"), F.col("B"), size), size)).first()
        assert got[0] == size and [x - 1 for x in got[1]] == orders[0] and got[2] == orders[0][1] * size + 1
        mutated = papers.withColumn("B", F.overlay("B", F.lit("X"), F.lit(4)))
        assert sequences.verified_keys(mutated).first().ok is False
        assert tuple(sequences.surviving_mutations(papers, size).first())[1:] == (4 * n, 0)


def test_uneven_blocks(spark):
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("ABCD") for _ in range(k)) for k in (7, 13, 8, 11)]
    key = lambda o: "".join(parts[k] for k in o)
    papers = spark.createDataFrame([("p", key((0, 1, 2, 3)), key((2, 0, 3, 1)), key((3, 2, 1, 0)), key((1, 3, 0, 2)))], "paper string, A string, B string, C string, D string")
    row = sequences.verified_keys(papers).first()
    assert row.ok and row.block is None and sum(row.lengths) == 39
    assert sequences.cover("AB", "AC") is None and sequences.cover("CDAB", "ABCD", budget=1) is None
    runs = sequences.cover("CDAB", "ABCD")
    assert runs == [(2, 2), (0, 2)]
    assert sequences.decomposes("abab", ["ab", "ab"]) and not sequences.decomposes("abab", ["ab", "ba"])


def test_grid_and_cells(spark):
    lines = spark.createDataFrame([("k", i, x) for i, x in enumerate(["Test Booklet SET A B", "1 A B", "2 C D", "2 A A", "x"])] + [("g", 0, "1 A B")], "doc string, seq int, line string")
    assert rows(sequences.parsed_grid(lines, 2)) == [("k", "A", ["A", "C"]), ("k", "B", ["B", "D"])]
    df = spark.createDataFrame([(["A", "X", "E"], {"E": "CD"})], "c array<string>, e map<string,string>")
    assert tuple(df.select(sequences.dropped_places(F.col("c")), sequences.placeholders_expanded(F.col("c"), F.col("e"))).first()) == ([2], ["A", "X", "CD"])
    shape = spark.createDataFrame([(["ABCDABCDAB"] * 10, None), (["ABCDABCDAZ"], None)], "r array<string>, e map<string,string>")
    assert [r[0] for r in shape.select(sequences.shape_problems(F.col("r"), F.lit("gs1"), F.col("e"))).collect()] == [[], ["not rows of ten", "odd letters: Z"]]


B = "seq int, id string, topic string, q string, options array<string>, answer int, passage string, paper struct<year int, code string, set string, n int>, source struct<name string>"


def test_ingest(spark):
    src = ("I",)
    q = lambda s, i, text="stem", **k: (s, i, k.get("topic", "t"), text, k.get("options", ["a", "b"]), k.get("answer", 0), k.get("passage"), None, k.get("source", src))
    bank = spark.createDataFrame([q(0, "old", "Known  stem")], B)
    batch = spark.createDataFrame([q(1, "n1", "First"), q(2, "n1", "Other"), q(3, "n2", "first "), q(4, "old", "x"), q(5, "n3", "known stem"), q(6, "n4", "y", topic="zz", answer=5), q(7, "n5", "z", source=None), q(8, "n6", "p", passage="no"), q(9, "n7", "Ok")], B)
    topics, passages = spark.createDataFrame([("t",)], "id string"), spark.createDataFrame([], "id string, text string")
    got = {r.seq: r.why for r in ingest.judged(batch, bank, topics, passages).collect()}
    assert got == {1: [], 2: ["id already in the batch"], 3: ["already asked in the batch"], 4: ["id already in the bank"], 5: ["already asked as old"], 6: ["unknown topic", "answer outside the options"], 7: ["no provenance"], 8: ["unknown passage"], 9: []}
    once = ingest.merged(bank, ingest.taken(ingest.judged(batch, bank, topics, passages)))
    assert once.count() == 3 and ingest.taken(ingest.judged(batch, once, topics, passages)).count() == 0


def test_changes_and_ids(spark, value):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "batch string, digest string")
    log = spark.createDataFrame([("a", "1"), ("b", "9")], "batch string, digest string")
    assert rows(ingest.changes(now, log).select("batch", "state")) == [("a", "unchanged"), ("b", "changed"), ("c", "new")]
    done = ingest.run_in_order(ingest.changes(now, log), lambda b: b != "c")
    assert done == ["b"]
    df = spark.createDataFrame([(None, (2024, "gs1", "A", 7), "", 1), ("own", None, "p", 2), (None, None, "institute-3", 3), (None, None, "", 4)], "id string, paper struct<year int, code string, set string, n int>, prefix string, n int")
    assert [r[0] for r in df.select(ingest.question_id(F.col("id"), F.col("paper"), F.col("prefix"), F.col("n"))).collect()] == ["csp24-gs1-a-7", "own", "institute-3-3", "q-4"]
    assert value(ingest.digest(F.col("x")), x="abc") == "ba7816bf8f01cfea"


def test_duplicates(spark):
    r = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c"), (4, None), (5, None)], "id int, q string")
    assert rows(match.duplicates_of(r, tx.fold(F.col("q")), "id", "id").select("id", "first_of")) == [(2, 1), (5, 4)]
