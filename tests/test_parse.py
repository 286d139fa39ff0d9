import numpy as np

from quern.operators import images, parse, repair

PAPER = """GENERAL STUDIES
1. Which of these are true?
1. One thing
2. Another thing
(a) 1 only (b) 2 only
(c) Both 1 and 2 (d) Neither 1 nor 2
advert line
( 3 - A )
2. Second question
(a) w
(b) x c) y (d) z
advert line
84. Third, with a number misread
(a) a (b) b (c) c (d) d"""


def test_questions_in_sequence():
    got = parse.questions(PAPER, 100, pages=2, trust_sequence=False)
    assert [(n, read) for n, read, *_ in got] == [(1, True), (2, True)]
    got = parse.questions(PAPER, 100, pages=2, trust_sequence=True)
    assert [(n, read) for n, read, *_ in got] == [(1, True), (2, True), (3, False)]
    assert got[0][2] == "Which of these are true? 1. One thing 2. Another thing" and got[0][3] == ["1 only", "2 only", "Both 1 and 2", "Neither 1 nor 2"]
    assert got[1][3] == ["w", "x", "y", "z"]


def test_repeated_lines_are_dropped():
    text = "\n".join(f"{n}. Question {n}\n(a) p (b) q (c) r (d) s\nbanner" for n in (1, 2, 3))
    assert [q[3] for q in parse.questions(text, 3, pages=3)] == [["p", "q", "r", "s"]] * 3


def test_question_without_options_is_bounded():
    text = "1. Start\n" + "\n".join(f"line {k}" for k in range(45)) + "\n2. Next\n(a) p (b) q (c) r (d) s"
    assert [q[0] for q in parse.questions(text, 10, drop_repeats=False)] == [1, 2]


def test_split_last_and_numbered():
    assert parse.split_last("see (a) above. Which? (a) w (b) x (c) y (d) z") == ("see (a) above. Which? ", ["w", "x", "y", "z"])
    assert parse.split_last("(a) w (b) x") is None
    text = "1. A (a) w (b) x (c) y (d) z 3. statement? (a) w (b) x (c) y (d) z 2. B (a) w (b) x (c) y (d) z"
    assert sorted(parse.numbered(text)) == [1, 2, 3]


def test_solutions():
    a = parse.solutions("Q.1) Ans) b Exp) Because. Option (b) is correct. Subject:) Polity Topic:) Acts Subtopic", "labelled")
    assert a[1][0] == "b" and a[1][1] == ["b"] and a[1][3] == "Polity / Acts"
    assert parse.solutions("Q 5. A text Q 5. B other", "plain")[5][0] == "a"
    t = parse.solutions("1.(a) 2.(c) Q 1. Answer: (b) Explanation: so", "tabled", "S")
    assert t[1][:2] == ("b", ["a", None]) and t[2] == ("c", [], "", "S")


def test_over_dataframes(spark):
    docs = spark.createDataFrame([("x", PAPER), ("y", None), ("z", "")], "doc string, text string")
    assert sorted((r.doc, r.n) for r in parse.parsed(docs, 100, pages=2).collect()) == [("x", 1), ("x", 2)]
    two = spark.createDataFrame([("x", "Q.1) body one Q.2) body two Q.1) again")], "doc string, text string")
    assert [(r.seq, r.n, r.body.strip()) for r in parse.parsed_labelled(two).orderBy("seq").collect()] == [(0, 1, "body one"), (1, 2, "body two"), (2, 1, "again")]
    assert parse.parsed_solutions(spark.createDataFrame([("x", "Q 5. A text")], "doc string, text string"), "plain").first().answer == "a"
    assert parse.parsed_numbered(spark.createDataFrame([("x", "1. A (a) w (b) x (c) y (d) z")], "doc string, text string").select("doc", "text")).first().options == ["w", "x", "y", "z"]


def test_passages():
    blocks = {1: "Directions for the following 2 (two) items: Read Passage - 1 First text", 4: "Directions for the following 2 (two) items: shared facts"}
    passages, given = parse.attached_passages(blocks, {1, 2, 3, 5, 6}, 6, "p")
    assert passages == {"p-p1": "First text", "p-p4": "shared facts"}
    assert given == {1: "p-p1", 2: "p-p1", 5: "p-p4"}


def test_repair(spark):
    assert repair.romans(["I only", "Il only", "I and Il only", "I, II and Ill"]) == ["I only", "II only", "I and II only", "I, II and III"]
    assert repair.romans(["prose", "I only", "more prose", "x"]) == ["prose", "I only", "more prose", "x"]
    assert repair.tidied("1. a 2. b 3. c", ["1 and 2 only", "2 and 8 only", "1 only", "1, 2 and 38 only"])[1] == "2 and 3 only"
    assert repair.tidied("order", ["3-1-2", "8-1-2", "1-2-3", "2-1-3"])[1] == "3-1-2"
    df = spark.createDataFrame([(1, "s", ["I only", "Il only", "x", "y"]), (2, None, None)], "id int, q string, options array<string>")
    assert sorted((r.id, r.options) for r in repair.tidied_questions(df).collect()) == [(1, ["I only", "II only", "x", "y"]), (2, None)]


def test_image_kernels(spark):
    gray = np.full((200, 100), 255, np.uint8)
    gray[20:180:4, 5:45] = 0
    gray[20:180:4, 55:95] = 0
    assert images.rule_at(gray) == -1 and 48 <= images.gutter_at(gray) <= 51
    gray[10:190, 49] = 0
    assert images.rule_at(gray) == 49
    runs = images.longest_runs(np.array([[1, 0], [1, 1], [0, 1], [1, 1]], bool))
    assert runs.tolist() == [2, 3]
    assert images.stitched([np.zeros((2, 10)), np.zeros((3, 9))]).shape == (5, 10) and images.stitched([]) is None
    df = spark.createDataFrame([(1, bytearray(gray.tobytes()), 100)], "page int, pixels binary, width int")
    assert images.page_splits(df).first().rule == 49
    assert images.best_angle(lambda a: gray if a == 0.5 else np.full_like(gray, 255)) == 0.5
