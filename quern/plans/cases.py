"""Text operators over staged texts: each row's text is a shape that scans, papers or pages have, around a part's name.

The shapes are stated with what they should become, so the SQL says the result outright instead of repeating
the operator's steps. ``{w}`` is the part's name; shapes are dealt out by key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import classify, dates
from quern.functions import text as tx
from quern.operators import ingest, quality, sequences
from quern.sources import readers, sinks


@dataclass
class Case:
    """An operator over the fields of a shape, and (shape, result) pairs; a shape with several fields is a tuple."""

    of: Callable[..., Column]
    pairs: tuple[tuple[str | tuple[str, ...], str | None], ...]


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


def _parts(c: Column, sep: str = "~") -> Column:
    return F.split(c, sep, -1)


def _cells(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _source(name: Column, test: Column, year: Column) -> Column:
    given = lambda c: F.nullif(c, F.lit(""))
    return F.struct(given(name).alias("name"), given(test).alias("test"), given(year).cast("int").alias("year"))


def _paper(c: Column) -> Column:
    p = F.split(c, "-", -1)
    return F.when(c != "", F.struct(p[0].cast("int").alias("year"), p[1].alias("code"), p[2].alias("set"), p[3].cast("int").alias("n")))


CASES: dict[str, Case] = {
    # --- folding and layout
    "rejoined_fragments": Case(tx.rejoin_fragments, (("a\nb\n \nc", "ab c"), ("fr\nom\n2\n2.\n{w}", "from 2 2. {w}"), ("{w}\nof  it", "{w} of it"), ("{w}", "{w}"), ("", ""))),
    "minified_json": Case(tx.minify_json, (('{ "{w}  b": [1, 2],\n "c": "\\" x" }', '{"{w}  b":[1,2],"c":"\\" x"}'), ("[ ]", "[]"), ('{"a" : null }', '{"a":null}'))),
    "indented_json": Case(tx.indent_json, (('{"{w}":[1,{"a":"b, c"}],"d":{}}', '{\n  "{w}": [\n    1,\n    {\n      "a": "b, c"\n    }\n  ],\n  "d": {}\n}'), ('"{w}"', '"{w}"'), ("[ 1 ,2]", "[\n  1,\n  2\n]"), ('{"e":[ ],"f":"{ }"}', '{\n  "e": [],\n  "f": "{ }"\n}'))),
    "cut_sentences": Case(lambda c: tx.cut_at_sentence(c, 30), (("It is a {w} then. More of it follows here.", "It is a {w} then. …"), ("{w}", "{w}"), ("x" * 40 + "{w}", "x" * 30 + " …"))),
    "unescaped_pages": Case(tx.visible_text, (("<p>{w} &eacute;&#8211;&mdash;</p>", "{w} é–—"), ("a &amp;lt; {w}&nbsp;&#x41;", "a &lt; {w} A"), ("&unknown; {w} &", "&unknown; {w} &"), ("<b>{w}</b><i>x</i>", "{w} x"))),
    # --- repair of scans
    "snapped_options": Case(tx.snap_option, (("land2 only", "1 and 2 only"), ("Both I and 2 |", "Both 1 and 2"), ("N0ne of the above", "None of the above"), ("The {w} reforms of the nineteen fifties", "The {w} reforms of the nineteen fifties"), ("1,2 and 3 on1y", "1, 2 and 3 only"))),
    "snapped_combinations": Case(lambda c, n: tx.snap_combination(c, n.cast("int")), ((("2and 8 only", "4"), "2 and 3 only"), (("2and 8 only", "8"), "2and 8 only"), (("1,3 and5", "6"), "1, 3 and 5"), (("{w} and so on, which is far too long", "4"), "{w} and so on, which is far too long"), (("Neither l nor 2", "2"), "Neither 1 nor 2"))),
    "digits_for_letters": Case(tx.digits_for_letters, (("land 3 only", "1 and 3 only"), ("l,2and3", "1,2 and 3"), ("{w} land system", "{w} land system"), ("Only one", "Only one"), ("I and 2", "1 and 2"))),
    "relabelled_markers": Case(tx.relabel_markers, (("1. {w} (@) p (ec) q\n2. y (b} r", "1. {w} (a)  p (b)  q\n2. y (a)  r"), ("{w} alone", "{w} alone"), ("(a) 1 (a) 2 (c) 3 (d) 4 (d) 5", "(a)  1 (b)  2 (c)  3 (d)  4 (a)  5"))),
    "renumbered_statements": Case(tx.renumber_statements, (("Of {w}: 1. a 2. b 8. c 4. d", "Of {w}: 1. a 2. b 3. c 4. d"), ("1. a 2. b 3. c 8. {w}", "1. a 2. b 3. c 8. {w}"), ("{w}", "{w}"))),
    "tidy_stems": Case(tx.tidy_stem, (("Which VGYH-U-FGT (3 - A) of these {w} ~ .", "Which of these {w}"), ("The {w} | is [P.T.O. here", "The {w} is here"), ("About {w}: 1. x 2. y 8. z", "About {w}: 1. x 2. y 3. z"), ("A {w} ( 12 - B ) asks", "A {w} asks"))),
    "spaced_references": Case(tx.spaced_reference, (("1,2and3only", "1, 2 and 3 only"), ("65 million {w}", "65 million {w}"), ("and 2 only", "1 and 2 only"), ("l and 4", "1 and 4"), ("2, 3 and 4 0nly", "2, 3 and 4 only"), ("3-1-2", "3-1-2"))),
    "reference_heads": Case(tx.reference_head, (("1 and 2 only because of {w}", "1 and 2 only"), ("38, 4", None), ("{w}", None), ("Both 1 and 2", "Both 1 and 2"), ("1, 2 and", None))),
    "tidy_tails": Case(tx.tidy_tail, (("| ~ {w} . ~", "{w}"), ("{w}.", "{w}."), ("‘{w}’", "‘{w}’"), ("{w}’", "{w}"), ("{w} ;", "{w}"), ("'{w}'", "'{w}'"), ("{w}'", "{w}"))),
    "bad_orderings": Case(lambda c: tx.bad_ordering(c).cast("string"), (("3-1-2", "false"), ("3-8-2", "true"), ("{w}", "false"), ("2 - 1", "false"), ("1-1", "true"))),
    "cut_at_next": Case(lambda c, n: tx.cut_at_next_question(c, n.cast("int")), ((("{w} 12. Which of", "11"), "{w}"), (("{w} 12. Which of", "12"), "{w} 12. Which of"), (("12. Which {w}", "11"), "12. Which {w}"), (("{w}. 8, 'Then", "7"), "{w}."))),
    "clean_scan_lines": Case(tx.clean_scan_line, (("KSPC-B-GSPT/61A 3", None), ("real {w} [P.T.O.", "real {w}"), ("PTO.", None), ("{w} KSPC-B-GSPT", "{w}"), ("| - B)", None), ("{w} \\", "{w}"))),
    "clean_proses": Case(tx.clean_prose, (("Food and _ {w} | Organisation", "Food and {w} Organisation"), ("a {w}_ b", "a {w} b"), ("{w} KSPC-B-GSPT/61A goes on", "{w} goes on"), ("{w} [P.T.O.", "{w}"))),
    "restored_brackets": Case(tx.restore_brackets, (("in Article 39(b) and b) Only {w}", "in Article 39(b) and (b) Only {w}"), ("{w}", "{w}"), ("x b) y", "x (b) y"))),
    "without_booklet_lines": Case(tx.without_booklet_lines, (("{w} [ 12 ] Answer Key & Detailed Answer Explanations end", "{w} end"), ("Space for Rough Work {w}", "{w}"), ("© All rights reserved. {w}", "{w}"))),
    "explanations": Case(lambda c: tx.explanation(c), (("Option (b) is the correct answer. Because {w}. Hence, option (b) is the correct answer. Source: x", "Because {w}."), ("So {w}. Subject:) Polity", "So {w}."), ("Answer Key 1. (a) 2. (b) 3. (c) 4. (d) 5. (a) then {w}", "then {w}"))),
    "laid_out_statements": Case(tx.lay_out_statements, (("Consider: 1. A {w} 2. B Which of the above?", "Consider:\n1. A {w}\n2. B\nWhich of the above?"), ("{w} only", "{w} only"), ("Lists: I. x II. {w} Select the code", "Lists:\nI. x\nII. {w}\nSelect the code"))),
    "without_option_tails": Case(tx.without_option_tail, (("{w} | |", "{w}"), ("{w} KSPC-B-GSPT", "{w}"), ("{w} - B )", "{w}"), ("{w} | VGYH-U-FGT - A)", "{w}"))),
    "options_at_markers": Case(lambda c: _joined(tx.split_options(c)), (("stem (a) one (b){w}  x (c) three (d) four", "one|{w} x|three|four"), ("{w}", ""))),
    "unescaped_markdown": Case(readers.unescaped_markdown, (("1\\. {w} \\(a\\) \\[x\\] a\\-b", "1. {w} (a) [x] a-b"), ("{w}", "{w}"))),
    # --- labels
    "paper_codes": Case(classify.paper_code, (("General Studies Paper - III", "gs3"), ("general studies paper 2", "gs2"), ("English Literature Paper - I", None), ("Essay", "essay"), ("{w}", None))),
    "exams_of_captions": Case(lambda c: F.concat_ws("|", classify.exam_of(c)["kind"], classify.exam_of(c)["year"].cast("string")), (("Civil Services (Main) Examination, 2019", "mains|2019"), ("the Civil Services ( Preliminary ) Exam. 2021 {w}", "prelims|2021"), ("{w} 2020", ""))),
    "question_pages": Case(lambda c: classify.is_question_page(c).cast("string"), (("Consider the following statements\n1. Which {w}\n2. the correct one\n(a) x (b) y", "true"), ("1. {w}\n2. x\n(a) (b)", "false"), ("the the the the {w}", "false"))),
    "series_letters": Case(classify.series_letter, (("{w} Series - C", "C"), ("XDTG-F-GST/62a", "A"), ("{w}", None))),
    "key_files": Case(lambda href, year: classify.key_file_code(href, year.cast("int")), ((("x/csp2020-anskey-paper-ii.pdf", "2020"), "gs2"), (("x/prelim-20-answer-gs-i.pdf", "2020"), "gs1"), (("x/{w}.pdf", "2020"), None), (("x/csp2019-anskey-paper-i.pdf", "2021"), None))),
    "subject_hints": Case(classify.subject_hint, ((("Polity / {w}", ""), "polity"), (("", "Institute - Modern History (V2) {w}"), "history"), (("{w}", "{w}"), None), (("Economy", "Institute - Polity (V1)"), "economics"))),
    "series_titles": Case(lambda n, code: F.to_json(classify.series_title("Institute", "Mock", n.cast("int"), code, 2024)), ((("7", "{w}"), '{"name":"Institute","test":"Mock 2024, Test 07 ({w})","year":2024}'), (("12", "x"), '{"name":"Institute","test":"Mock 2024, Test 12 (x)","year":2024}'))),
    "stated_answers": Case(classify.stated_answer, (("option (a) is correct; so Option d is the correct {w}", "d"), ("{w}", None), ("OPTION ( C ) is the correct", "c"))),
    "picture_questions": Case(lambda c: classify.needs_picture(c).cast("string"), (("the map of {w}", "true"), ("a mapped {w}", "false"), ("{w} in the Figure", "true"))),
    # --- pages, names, identities
    "kept_blocks": Case(dates.keep_blocks, (("<!--PWA-->\n{w}\n<!--/PWA-->\nend", "{w}\nend"), ("{w}", "{w}"))),
    "stripped_blocks": Case(dates.strip_blocks, (("a\n<!--PWA-->\n{w}\n<!--/PWA-->\nend", "a\nend"), ("{w}", "{w}"))),
    "embeddable_pages": Case(dates.embeddable, (("<html><style>p{}</style><body>\n{w}\n</body></html>", "<style>p{}</style>\n{w}\n"), ("<body>{w}</body>", None), ("{w}", None))),
    "payloads": Case(lambda c: readers.embedded_payload(c, "DATA", "struct<a: string, b: int>")["a"], (('x\n  const DATA = {"a":"{w}","b":2};\ny', "{w}"), ("const DATA = nothing;", None), ("{w}", None))),
    "download_names": Case(sinks.download_name, (("https://x.org/a/b%20c.pdf?v=1", "b%20c.pdf"), ("https://x.org/report.v2.html#top", "report.v2.html"), ("https://x.org/z.txt", "z.txt"))),
    "batch_ids": Case(lambda a, b, y, stem: ingest.batch_id(_source(a, b, y), stem), ((("Institute", "{w}", "2024", "f"), "Institute · {w} · 2024"), (("", "", "", "file-{w}"), "file-{w}"), (("Institute", "", "2020", "f"), "Institute · 2020"))),
    "question_ids": Case(lambda i, p, pre, n: ingest.question_id(i, _paper(p), pre, n.cast("int")), ((("own-{w}", "", "x", "3"), "own-{w}"), (("", "2019-gs1-B-7", "x", "3"), "csp19-gs1-b-7"), (("", "", "institute-{w}", "3"), "institute-{w}-3"), (("", "", "", "3"), "q-3"))),
    "prefixes": Case(lambda a, b, y: ingest.prefix(_source(a, b, y)), ((("The Institute", "Test 3: {w}!", "2024"), "the-institute-test-3-{s}-2024"), (("A", "", ""), "a"))),
    # --- keys
    "dropped_places": Case(lambda c: _joined(sequences.dropped_places(_cells(c))), (("ABXDX", "3|5"), ("ABCD", ""))),
    "expanded_cells": Case(lambda c: _joined(sequences.placeholders_expanded(_cells(c), F.create_map(F.lit("E"), F.lit("CD"), F.lit("F"), F.lit("AB")))), (("AEBF", "A|CD|B|AB"), ("ABCD", "A|B|C|D"))),
    "key_shapes": Case(lambda rows, code: _joined(sequences.shape_problems(_parts(rows), code, F.create_map(F.lit("E"), F.lit("CD")))), ((("~".join(["ABCDABCDAB"] * 10), "gs1"), ""), (("~".join(["ABCDABCDAB"] * 9), "gs1"), "not rows of ten"), (("~".join(["ABCDEBCDAX"] * 8), "gs2"), ""), (("~".join(["ABCDZBCDAQ"] * 10), "gs1"), "odd letters: QZ"))),
    "mapped_numbers": Case(lambda n, perm: sequences.mapped_number(n.cast("int"), F.transform(_parts(perm), lambda x: x.cast("int")), 5).cast("string"), ((("1", "3~1~2"), "11"), (("7", "3~1~2"), "2"), (("15", "3~1~2"), "10"), (("16", "3~1~2"), None))),
    "contradictions": Case(lambda a, also: quality.contradicts(a, F.transform(_parts(also), lambda x: F.nullif(x, F.lit("")))).cast("string"), ((("b", "b~~b"), "false"), (("b", "b~c"), "true"), (("a", ""), "false"))),
}

#: Operators over columns of given names: (column -> field), result, shapes.
NAMED: dict[str, tuple[Callable[[], Column], dict[str, Callable[[Column], Column]], tuple]] = {
    "option_faults": (lambda: quality.option_problems(), {"options": _parts}, (
        ("1 only~2 only~1 and 2 only~3 and 1 only", "statements out of order: 3 and 1 only"), ("I only~II only~II and I only~I, II and III", "statements out of order: II and I only"),
        ("1 only~2 only~12 only~1 ands", "a statement number past 9: 12 only|not a statement reference: 1 ands"), ("{w}~b~c~{w}", "options not distinct and non-empty"), ("3-1-2~1-2-3~2-8-1~x", "not a permutation: 2-8-1"),
        ("{w}~b~c KSPC-B-GSPT~d", "page furniture: c KSPC-B-GSPT"), ("{w}~b~c~d", ""),
    )),
    "review_notes": (lambda: quality.review_flags(), {"q": lambda c: F.split(c, "#")[0], "options": lambda c: _parts(F.split(c, "#")[1]), "read": lambda c: F.split(c, "#")[2] == "y", "cell": lambda c: F.split(c, "#")[3]}, (
        ("Which of these is a {w}?#a~b~c~d#y#A", ""), ("short#a~b~#n#X", "3 options|stem looks cut|an empty option|number inferred|dropped"), ("Which of these is a {w}?#a~b~c~a#y#B", "two equal options"),
    )),
    "draft_notes": (lambda: quality.draft_flags(), {"q": lambda c: F.split(c, "#")[0], "options": lambda c: _parts(F.split(c, "#")[1]), "passage": lambda c: F.nullif(F.split(c, "#")[2], F.lit("")), "in_group": lambda c: F.split(c, "#")[3] == "y", "cell": lambda c: F.split(c, "#")[4]}, (
        ("see the figure | of the author#a~b~c~d##n#CD", "key CD|figure or table|odd characters|mentions a passage but has none"), ("a {w}#a~b~c~d##y#A", "in a passage group with no passage found"), ("a {w}#a~b~c##n#X", "3 options|dropped"), ("a {w} of 5% 3#a~b~c~d#p#y#A", "odd characters"),
    )),
    "stray_statements": (lambda: F.transform(quality.stray_statement(), lambda x: x.cast("string")), {"q": lambda c: F.split(c, "#")[0], "options": lambda c: _parts(F.split(c, "#")[1])}, (
        ("1. {w} 2. b#1 and 83 only~2 only", "83"), ("1. a 2. {w}#1~2~5", ""), ("1. a 2. b 3. c 4. d 5. e 6. {w}#6~7", "7"),
    )),
}


def _texts(pairs: tuple) -> list[list[str]]:
    return [[x] if isinstance(x, str) else list(x) for x, _ in pairs]


def parts(spark, sf_dir: str):
    """Keys and names of the parts, dealt to all cores: a file of few row groups is read by as few tasks, and what is done to a row costs far more than to move it."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").repartition(tasks)


def _staged(spark, sf_dir: str, pairs: tuple):
    """The parts with their shapes' fields, x0 and so on."""
    shapes, name = _texts(pairs), F.col("p_name")
    fill = lambda s: F.replace(F.lit(s), F.lit("{w}"), name)
    place = (F.col("p_partkey") % len(shapes) + 1).cast("int")
    fields = [F.element_at(F.array(*[fill(s[k]) for s in shapes]), place).alias(f"x{k}") for k in range(len(shapes[0]))]
    return parts(spark, sf_dir).select("p_partkey", "p_name", *fields)


def _case(name: str, case: Case):
    def query(spark, sf_dir):
        staged = _staged(spark, sf_dir, case.pairs)
        fields = [F.col(f"x{k}") for k in range(len(_texts(case.pairs)[0]))]
        return staged.select("p_partkey", case.of(*fields).alias("found"))

    query.__name__ = name
    return query


def _named(name: str, build, columns: dict, pairs: tuple):
    def query(spark, sf_dir):
        staged = _staged(spark, sf_dir, pairs).select("p_partkey", *[f(F.col("x0")).alias(c) for c, f in columns.items()])
        return staged.select("p_partkey", F.array_join(build(), "|").alias("found"))

    query.__name__ = name
    return query


def _sql(pairs: tuple) -> str:
    said = lambda x: "NULL" if x is None else "replace(replace('" + x.replace("'", "''") + "', '{w}', p_name), '{s}', replace(p_name, ' ', '-'))"
    whens = " ".join(f"WHEN {k} THEN {said(want)}" for k, (_, want) in enumerate(pairs))
    return f"SELECT p_partkey, CASE p_partkey % {len(pairs)} {whens} END AS found FROM part"


QUERIES = {name: _case(name, case) for name, case in CASES.items()} | {name: _named(name, *made) for name, made in NAMED.items()}
ORACLE_SQL = {name: _sql(case.pairs) for name, case in CASES.items()} | {name: _sql(pairs) for name, (_, _, pairs) in NAMED.items()}
