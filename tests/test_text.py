import pytest
from pyspark.sql import functions as F

from quern.functions import classify, dates
from quern.functions import text as tx

C = F.col


@pytest.mark.parametrize(
    ("build", "given", "want"),
    [
        (tx.fold, " The  Cat\n", "the cat"),
        (tx.fold_alnum, "It's  No. 5!", "it s no 5"),
        (tx.alnum_key, "Bill, 3", "b1113"),
        (tx.confusable_key, "Sol 8b", "50188"),
        (tx.visible_text, "<b>A &amp;lt; B</b>&nbsp;<i>c</i>", "A &lt; B c"),
        (tx.escape_html, "a<b & \"c\"'", "a&lt;b &amp; &quot;c&quot;&#39;"),
        (tx.minify_json, '{ "a b": [1, 2],\n "c": "\\" x" }', '{"a b":[1,2],"c":"\\" x"}'),
        (tx.slug, " Some: Body -- Test 3 ", "some-body-test-3"),
        (tx.rejoin_fragments, "a\nb\n \nc", "ab c"),
        (tx.rejoin_fragments, "fr\nom\n2\n2.\nlonger line", "from 2 2. longer line"),
        (tx.rejoin_fragments, "two whole\nlines", "two whole lines"),
        (tx.snap_option, "land2 only", "1 and 2 only"),
        (tx.snap_option, "Both I and 2 |", "Both 1 and 2"),
        (tx.snap_option, "The land reforms of the nineteen fifties", "The land reforms of the nineteen fifties"),
        (tx.digits_for_letters, "land 3 only", "1 and 3 only"),
        (tx.digits_for_letters, "l,2and3", "1,2 and 3"),
        (tx.digits_for_letters, "forest land system", "forest land system"),
        (tx.spaced_reference, "1,2and3only", "1, 2 and 3 only"),
        (tx.spaced_reference, "65 million years", "65 million years"),
        (tx.reference_head, "1 and 2 only because", "1 and 2 only"),
        (tx.reference_head, "38, 4", None),
        (tx.tidy_tail, "| ~ an option . ~", "an option"),
        (tx.renumber_statements, "Consider: 1. a 2. b 8. c 4. d", "Consider: 1. a 2. b 3. c 4. d"),
        (tx.restore_brackets, "in Article 39(b) and b) Only two", "in Article 39(b) and (b) Only two"),
        (tx.split_options, "stem (a) one (b)two  x (c) three (d) four", ["one", "two x", "three", "four"]),
        (tx.split_options, "no marks", []),
        (tx.relabel_markers, "1. x (@) p (ec) q\n2. y (b} r", "1. x (a)  p (b)  q\n2. y (a)  r"),
        (tx.lay_out_statements, "Consider: 1. A thing 2. B Which of the above?", "Consider:\n1. A thing\n2. B\nWhich of the above?"),
        (tx.clean_scan_line, "KSPC-B-GSPT/61A 3", None),
        (tx.clean_scan_line, "real text [P.T.O.", "real text"),
        (tx.clean_scan_line, "PTO.", None),
        (tx.clean_prose, "Food and _ Agriculture | Organisation", "Food and Agriculture Organisation"),
        (tx.tidy_stem, "Which VGYH-U-FGT (3 - A) of these ~ .", "Which of these"),
        (tx.explanation, "Option (b) is the correct answer. Because so. Hence, option (b) is the correct answer. Source: x", "Because so."),
        (classify.paper_code, "General Studies Paper - III", "gs3"),
        (classify.paper_code, "English Literature Paper - I", None),
        (classify.paper_code, "Essay", "essay"),
        (classify.stated_answer, "option (a) is correct; so Option d is the correct", "d"),
        (classify.stated_answer, "nothing", None),
        (classify.series_letter, "XDTG-F-GST/62A", "A"),
        (classify.series_letter, "none", None),
        (classify.needs_picture, "the map shown", True),
        (tx.bad_ordering, "3-1-2", False),
        (tx.bad_ordering, "3-8-2", True),
    ],
)
def test_expression(value, build, given, want):
    assert value(build(C("x")), x=given) == want


@pytest.mark.parametrize("build", [tx.fold, tx.snap_option, tx.split_options, tx.tidy_stem, tx.relabel_markers, tx.explanation, classify.paper_code, tx.terms])
def test_null_and_empty_texts_do_not_crash(spark, build):
    rows = spark.createDataFrame([(None,), ("",)], "x string").select(build(C("x"))).collect()
    assert rows[0][0] is None and len(rows) == 2


def test_terms_drop_stop_words(value):
    assert value(tx.terms(C("x")), x="The Reserve Bank of India's rate") == ["reserve", "bank", "india's", "rate"]


def test_cut_at_sentence(value):
    assert value(tx.cut_at_sentence(C("x"), 20), x="One two three. Four five six seven") == "One two three. …"
    assert value(tx.cut_at_sentence(C("x"), 20), x="short") == "short"


def test_snap_combination(value):
    assert value(tx.snap_combination(C("x"), F.lit(4)), x="2and 8 only") == "2 and 3 only"
    assert value(tx.snap_combination(C("x"), F.lit(8)), x="2and 8 only") == "2and 8 only"
    assert value(tx.snap_combination(C("x"), F.lit(4)), x="17") == "17"


def test_cut_at_next_question(value):
    assert value(tx.cut_at_next_question(C("x"), F.lit(7)), x="an option 8. Which of") == "an option"
    assert value(tx.cut_at_next_question(C("x"), F.lit(7)), x="8. Which of") == "8. Which of"


def test_template_is_filled_in_one_pass(value):
    values = F.create_map(F.lit("__A__"), F.lit("x __B__ y"), F.lit("__B__"), F.lit("no"))
    assert value(dates.substitute(C("t"), values), t="<__A__|__B__|__C__>") == "<x __B__ y|no|>"
    assert value(dates.missing_tokens(C("t"), values), t="__A__ __C__") == ["__C__"]


def test_conditional_blocks(value):
    page = "a\n<!--PWA-->\nb\n<!--/PWA-->\nc\n"
    assert value(dates.keep_blocks(C("t")), t=page) == "a\nb\nc\n"
    assert value(dates.strip_blocks(C("t")), t=page) == "a\nc\n"


def test_key_file_names(value):
    code = lambda name: value(classify.key_file_code(C("h"), F.lit(2017)), h=f"/x/{name}")
    assert code("AnsKey-CSP-17-GS-II.pdf") == "gs2" and code("AnsKey-CSP-2017-Paper-I.pdf") == "gs1" and code("AnsKey-CSP-2016-Paper-I.pdf") is None


def test_days(spark):
    row = spark.sql("select date'2026-06-01' d").select(dates.last_sunday_of_may(F.lit(2026)), dates.next_exam(C("d")), dates.sunday_first(F.lit("2026-05-31").cast("date"))).first()
    assert [str(x) for x in row] == ["2026-05-31", "2027-05-30", "0"]


def test_booklet_lines(value):
    assert value(tx.without_booklet_lines(C("x"), (r"www\.example\.in",)), x="a [ 12 ] b www.example.in c Space for  Rough Work") == "a b c"
