"""Data-quality rules. Each is a query that returns the rows that break it.

A violation is (rule, entity, key, message). Rules are built from a few generic
constraints, and ``violations`` is the union of any number of them: everything is reported,
nothing stops at the first error. An empty result means pass.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import match

# Domains.
WEIGHTS = ("high", "medium", "low")
PAPERS = ("prelims", "gs1", "gs2", "gs3", "gs4", "essay")
CELL = "^(?:[ABCDX]|[ABCD]{2,4})$"
URL_TOKENS = ("yyyy", "mm", "dd", "d", "month")


def _as(df: DataFrame, rule: str, entity: str, key: Column, message: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(entity).alias("entity"), key.cast("string").alias("key"), message.alias("message"))


def _key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


# --- generic constraints ---------------------------------------------------------------


def check(df: DataFrame, bad: Column, rule: str, entity: str, key: Column | str, message: Column | str) -> DataFrame:
    """Rows for which ``bad`` is true (null counts as fine)."""
    key, message = (F.col(key) if isinstance(key, str) else key), (F.lit(message) if isinstance(message, str) else message)
    return _as(df.filter(F.coalesce(bad, F.lit(False))), rule, entity, key, message)


def unique(df: DataFrame, keys: Iterable[str], rule: str, entity: str, *, when: Column | None = None) -> DataFrame:
    """Keys that occur more than once. Nulls are values: two null keys collide."""
    keys = list(keys)
    counted = (df if when is None else df.filter(when)).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    return _as(counted, rule, entity, _key(*keys), F.format_string("occurs %d times", "_n"))


def references(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str, entity: str, row_key: str | None = None) -> DataFrame:
    """Non-null keys of ``child`` that ``parent`` doesn't hold."""
    lost = child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return _as(lost, rule, entity, F.col(row_key or key), F.concat(F.lit(f"unknown {key} "), F.col(key).cast("string")))


def required(df: DataFrame, raw: str, fields: Iterable[str], rule: str, entity: str, key: str) -> DataFrame:
    """Fields that are absent from the raw JSON of a row; an explicit null is present."""
    want = F.array(*[F.lit(f) for f in fields])
    lost = df.withColumn("_lost", F.array_except(want, F.coalesce(F.json_object_keys(raw), F.expr("cast(array() as array<string>)"))))
    return _as(lost.filter(F.size("_lost") > 0), rule, entity, F.col(key), F.concat(F.lit("lacks "), F.array_join("_lost", ", ")))


def within(df: DataFrame, column: Column, allowed: Iterable, rule: str, entity: str, key: str) -> DataFrame:
    """Values, or members of an array, outside a domain."""
    return check(df, ~column.isin(*allowed), rule, entity, key, F.concat(F.lit("outside the domain: "), column.cast("string")))


def members_within(df: DataFrame, column: str, allowed: Iterable[str], rule: str, entity: str, key: str) -> DataFrame:
    odd = F.array_except(F.col(column), F.array(*[F.lit(a) for a in allowed]))
    return check(df, F.size(odd) > 0, rule, entity, key, F.concat(F.lit("outside the domain: "), F.array_join(odd, ", ")))


def not_empty(df: DataFrame, rule: str, entity: str) -> DataFrame:
    """One violation if the table has no row."""
    return _as(df.agg(F.count("*").alias("n")).filter("n = 0"), rule, entity, F.lit(entity), F.lit("no rows"))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Messages of all conditions that hold, in order."""
    said = [F.when(F.coalesce(c, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for c, m in pairs]
    return F.array_compact(F.array(*said))


# --- subjects and topics -----------------------------------------------------------------


def topic_rules(subjects: DataFrame, topics: DataFrame) -> list[DataFrame]:
    """V1-V4 over subjects (id, raw) and topics (id, weight, papers, subtopics, raw)."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return [
        required(subjects, "raw", ("id", "name", "short", "icon", "topics"), "V1", "subject", "id"),
        required(topics, "raw", ("id", "name", "weight", "papers", "subtopics"), "V1", "topic", "id"),
        unique(subjects, ["id"], "V2", "subject"),
        unique(topics, ["id"], "V2", "topic"),
        within(topics, F.col("weight"), WEIGHTS, "V3", "topic", "id"),
        members_within(topics, "papers", PAPERS, "V3", "topic", "id"),
        check(topics, empty("papers"), "V4", "topic", "id", "no papers"),
        check(topics, empty("subtopics"), "V4", "topic", "id", "no subtopics"),
    ]


# --- questions -----------------------------------------------------------------------------


def question_rules(questions: DataFrame, topics: DataFrame, passages: DataFrame) -> list[DataFrame]:
    """V5-V13 over questions (seq, id, topic, q, options, answer, passage, paper, source) and passages (id, text)."""
    trimmed = F.transform("options", lambda o: F.trim(o))
    n = F.coalesce(F.size("options"), F.lit(0))
    named = questions.join(passages.select(F.col("id").alias("passage"), F.col("text").alias("_text")), "passage", "left")
    stem = F.concat(tx.fold(F.col("q")), F.when(F.col("passage").isNotNull(), F.concat(F.lit(" | "), F.coalesce(tx.fold(F.col("_text")), F.lit("")))).otherwise(F.lit("")))
    stems = named.filter(F.length(tx.fold(F.col("q"))) >= 25).withColumn("_stem", stem)
    again = match.previous(stems.withColumn("_stem", F.md5(F.col("_stem").cast("binary"))), "_stem", "seq", "id", to="_before")
    used = questions.filter(F.col("passage").isNotNull()).select(F.col("passage").alias("id"))
    return [
        unique(questions, ["id"], "V5", "question"),
        check(named, F.col("passage").isNotNull() & blank(F.col("_text")), "V6", "question", "id", "passage is missing or blank"),
        references(questions, "topic", topics, "id", "V7", "question", "id"),
        check(questions, n < 2, "V8", "question", "id", "under two options"),
        check(questions, F.exists("options", lambda o: blank(o)), "V8", "question", "id", "a blank option"),
        check(questions, F.size(F.array_distinct(trimmed)) < n, "V8", "question", "id", "two equal options"),
        check(questions, F.col("answer").isNull() | (F.col("answer") < 0) | (F.col("answer") >= n), "V9", "question", "id", "answer outside the options"),
        check(questions, blank(F.col("q")), "V10", "question", "id", "no text"),
        check(questions, F.col("paper").isNotNull() & F.col("source").isNotNull(), "V11", "question", "id", "both paper and source"),
        check(questions, F.col("source").isNotNull() & blank(F.col("source.name")), "V11", "question", "id", "source without a name"),
        _as(passages.join(used, "id", "left_anti"), "V12", "passage", F.col("id"), F.lit("no question uses it")),
        _as(again.filter(F.col("_before").isNotNull()), "V13", "question", F.col("id"), F.concat(F.lit("asked already as "), F.col("_before"))),
    ]


def paper_tag_rules(questions: DataFrame, keys: DataFrame) -> list[DataFrame]:
    """Questions tagged with a cell of a paper, against keys (year, code, set, letters)."""
    tag = questions.filter(F.col("paper").isNotNull()).select("id", "answer", F.col("paper.year").alias("year"), F.col("paper.code").alias("code"), F.col("paper.set").alias("set"), F.col("paper.n").alias("n"))
    years, papers = keys.select("year").distinct().withColumn("_y", F.lit(1)), keys.select("year", "code").distinct().withColumn("_p", F.lit(1))
    j = tag.join(years, "year", "left").join(papers, ["year", "code"], "left").join(keys.select("year", "code", "set", "letters"), ["year", "code", "set"], "left")
    first = (
        F.when(F.col("_y").isNull(), "no such year").when(F.col("_p").isNull(), "no such paper").when(F.col("letters").isNull(), "no such set")
        .when(F.col("n").isNull() | (F.col("n") < 1), "no such number").when(F.col("n") > F.size("letters"), "V16")
    )
    cell = F.get("letters", F.col("n") - 1)
    letter = F.substring(F.lit("ABCD"), F.col("answer") + 1, F.lit(1))
    j = j.withColumns({"_first": first, "_cell": cell, "_letter": letter})
    good = F.col("_first").isNull()
    return [
        check(j, F.col("_first").isNotNull() & (F.col("_first") != "V16"), "V14", "question", "id", F.col("_first")),
        unique(tag, ["year", "code", "set", "n"], "V15", "question"),
        check(j, F.col("_first") == "V16", "V16", "question", "id", F.format_string("number %d is past the end of the key", "n")),
        check(j, good & (F.col("_cell") == "X"), "V17", "question", "id", "the question was dropped"),
        check(j, good & (F.col("_cell") != "X") & (F.instr("_cell", F.col("_letter")) == 0), "V17", "question", "id", F.concat(F.lit("the key says "), F.col("_cell"))),
    ]


def key_rules(marking: DataFrame, keys: DataFrame) -> list[DataFrame]:
    """Marking (code, questions, raw) and keys (year, code, set, letters, dropped_count)."""
    sized = keys.join(marking.select("code", "questions"), "code", "left")
    row = _key("year", "code", "set")
    dropped = F.size(F.filter("letters", lambda c: c == "X"))
    return [
        required(marking, "raw", ("questions", "correct", "wrong", "total"), "V18", "marking", "code"),
        references(keys, "code", marking, "code", "V18", "key"),
        check(sized, F.size("letters") != F.col("questions"), "V19", "key", row, "length differs from the paper's"),
        check(keys, F.exists("letters", lambda c: ~c.rlike(CELL)), "V20", "key", row, "a cell outside the alphabet"),
        check(keys, F.col("dropped_count").isNotNull() & (dropped != F.col("dropped_count")), "V21", "key", row, "count of dropped questions differs"),
    ]


# --- optionals, copies, daily sources ----------------------------------------------------


def optional_rules(optionals: DataFrame, years: DataFrame, syllabus: DataFrame) -> list[DataFrame]:
    """Optionals (id, raw), years (id, year, codes array), syllabus (id, papers array, topics array)."""
    return [
        required(optionals, "raw", ("id", "name", "short", "icon"), "V22", "optional", "id"),
        unique(optionals, ["id"], "V22", "optional"),
        unique(years, ["id", "year"], "V22", "optional year"),
        check(years, F.col("codes") != F.array(F.lit("p1"), F.lit("p2")), "V22", "optional year", _key("id", "year"), "papers aren't p1 and p2"),
        check(syllabus, F.col("papers") != F.array(F.lit("Paper I"), F.lit("Paper II")), "V23", "syllabus", "id", "papers aren't I and II"),
        check(syllabus, F.coalesce(F.size("topics"), F.lit(0)) <= 0, "V23", "syllabus", "id", "no topics"),
        check(syllabus, F.exists("topics", lambda t: blank(t)), "V23", "syllabus", "id", "a topic without a name"),
        not_empty(optionals, "V24", "optionals"),
    ]


def copy_rules(copies: DataFrame, publishers: DataFrame, *, by_subject: bool = False, subjects: DataFrame | None = None) -> list[DataFrame]:
    """Copies (id, name, rank, year, subject, publisher, url, medium, files, raw)."""
    links = copies.select("id", F.array_compact(F.concat(F.array("url"), F.coalesce(F.transform("files", lambda f: f["url"]), F.expr("cast(array() as array<string>)")))).alias("urls"))
    named = F.col("rank").isNotNull() & (F.col("rank") != 0)
    known = F.col("year").isNotNull() & (F.col("year") != 0)
    files = copies.select("id", F.explode("files").alias("f"))
    out = [
        required(copies, "raw", ("name", "rank", "year", "publisher", "url"), "V25", "copy", "id"),
        check(copies, F.col("medium").isNotNull() & (F.col("medium") != "English"), "V25", "copy", "id", "not in English"),
        check(copies, F.col("name").rlike("[ऀ-ॿ]"), "V25", "copy", "id", "name in Devanagari"),
        check(files, blank(F.col("f.paper")) | blank(F.col("f.url")), "V26", "copy", "id", "a booklet without paper or url"),
        check(links, F.size(F.array_distinct("urls")) < F.size("urls"), "V26", "copy", "id", "the same url twice"),
        check(links, F.exists("urls", lambda u: ~u.startswith("https://")), "V26", "copy", "id", "a url that isn't https"),
        unique(copies, ["year", "rank", "subject"], "V28", "copy", when=named & known) if by_subject else unique(copies, ["year", "rank"], "V27", "copy", when=named),
        check(publishers, blank(F.col("name")) | blank(F.col("url")), "V29", "publisher", F.coalesce("name", F.lit("?")), "no name or url"),
    ]
    if subjects is not None:
        out.append(references(copies, "subject", subjects, "id", "V28", "copy", "id"))
    return out


def daily_rules(daily: DataFrame) -> list[DataFrame]:
    """V24, V30, V31 over daily (id, url, skips, questions)."""
    tokens = F.regexp_extract_all("url", F.lit(r"\{(\w+)\}"), F.lit(1))
    return [
        not_empty(daily, "V24", "daily"),
        check(daily, ~F.array_contains(tokens, "yyyy") | ~(F.array_contains(tokens, "month") | F.array_contains(tokens, "mm")), "V30", "daily", "id", "no year or no month in the url"),
        check(daily, F.size(F.array_except(tokens, F.array(*[F.lit(t) for t in URL_TOKENS]))) > 0, "V30", "daily", "id", "an unknown placeholder"),
        check(daily, F.exists("skips", lambda s: (s < 0) | (s > 6)), "V31", "daily", "id", "a skip outside 0 to 6"),
        check(daily, F.col("questions").isNull() | (F.col("questions") < 1), "V31", "daily", "id", "no questions"),
    ]


# --- parsed and staged questions -----------------------------------------------------------


#: Roman numerals of references, and the digits that they stand for.
_ROMAN = r"(?:III|II|IV|I|V)"
_ROMAN_REFERENCE = rf"^(?i:only\s+)?{_ROMAN}(?:\s*,\s*{_ROMAN})*(?:\s+and\s+{_ROMAN})*(?i:\s+only)?$|^Both\s+I\s+and\s+II$|^Neither\s+I\s+nor\s+II$"


def _in_digits(x: Column) -> Column:
    """A reference in Roman numerals with digits instead; anything else as it is."""
    out = x
    for roman, digit in (("III", "3"), ("II", "2"), ("IV", "4"), ("I", "1"), ("V", "5")):
        out = F.regexp_replace(out, rf"\b{roman}\b", digit)
    return F.when(x.rlike(_ROMAN_REFERENCE), out).otherwise(x)


def option_problems(options: str = "options") -> Column:
    """What is still wrong with tidied options, as an array of messages; numerals count as the numbers they stand for."""
    o = F.col(options)
    whole = lambda x: _in_digits(x).rlike(f"^{tx.REFERENCE}$")
    refs = F.size(F.filter(o, whole)) >= 2
    numbers = lambda x: F.transform(F.regexp_extract_all(_in_digits(x), F.lit("[0-9]+"), F.lit(0)), lambda d: d.cast("int"))
    in_order = lambda x: numbers(x) == F.array_sort(F.array_distinct(numbers(x)))
    of = lambda bad, message: F.transform(F.filter(o, bad), lambda x: F.concat(F.lit(f"{message}: "), x))
    digit = lambda x: refs & _in_digits(x).rlike("[0-9]")
    past9 = lambda x: F.exists(numbers(x), lambda d: d > 9)
    return F.flatten(F.array(
        of(lambda x: x.rlike(tx.FURNITURE), "page furniture"),
        of(lambda x: tx.bad_ordering(x), "not a permutation"),
        of(lambda x: digit(x) & past9(x), "a statement number past 9"),
        of(lambda x: digit(x) & ~past9(x) & ~whole(x), "not a statement reference"),
        of(lambda x: digit(x) & ~past9(x) & whole(x) & ~x.rlike("(?i)^(?:Both|Neither)") & ~in_order(x), "statements out of order"),
        F.when((F.size(F.array_distinct(o)) < F.size(o)) | F.exists(o, lambda x: x == ""), F.array(F.lit("options not distinct and non-empty"))).otherwise(F.expr("cast(array() as array<string>)")),
    ))


def review_flags(*, shortest: int = 20) -> Column:
    """V35 over q, options, read, key cell: reasons to look at a parsed question."""
    n = F.size("options")
    return reasons(
        (n != 4, F.format_string("%d options", n)),
        (F.length("q") < shortest, "stem looks cut"),
        (F.exists("options", lambda o: blank(o)), "an empty option"),
        (F.size(F.array_distinct("options")) < n, "two equal options"),
        (~F.coalesce(F.col("read"), F.lit(True)), "number inferred"),
        (F.col("cell") == "X", "dropped"),
    )


def stray_statement(stem: str = "q", options: str = "options", floor: int = 5) -> Column:
    """Numbers that options cite above the stem's own statements (and above ``floor``)."""
    ints = lambda a: F.transform(a, lambda x: x.cast("int"))
    top = F.greatest(F.coalesce(F.array_max(ints(F.regexp_extract_all(stem, F.lit(r"(?<![0-9.])([0-9]{1,2})\.\s"), F.lit(1)))), F.lit(0)), F.lit(floor))
    cited = F.flatten(F.transform(options, lambda o: ints(F.regexp_extract_all(o, F.lit("[0-9]+"), F.lit(0)))))
    return F.array_sort(F.array_distinct(F.filter(cited, lambda x: x > top)))


def whole_papers(parsed: DataFrame, total: int, group: Iterable[str], number: str = "n") -> DataFrame:
    """Groups whose numbers are exactly 1 to ``total``."""
    g = parsed.groupBy(*group).agg(F.count("*").alias("rows"), F.countDistinct(number).alias("numbers"), F.max(number).alias("last"), F.min(number).alias("first"))
    return g.withColumn("whole", (F.col("rows") == total) & (F.col("numbers") == total) & (F.col("last") == total) & (F.col("first") == 1))


#: Words of a question that can't be asked without its picture, and characters that a scan puts in for others.
PICTURED = ("figure", "figures", "diagram", "graph", "chart", "table", "pie", "shown below")
ODD_CHARACTERS = "\u00b0\u00ae\u00ab\u00bb\u00a5#\u00a2*~|@{}[]"


def draft_flags() -> Column:
    """V38 over q, options, passage, in_group, cell."""
    everything = F.concat_ws(" ", "q", F.array_join("options", " "))
    words = lambda c, some: c.rlike(rf"(?i)\b(?:{'|'.join(some)})\b")
    odd = F.length(F.translate(everything, ODD_CHARACTERS, "")) < F.length(everything)
    misread = everything.rlike(r"[?%]\s*[0-9]") | everything.rlike(r"(?:\w|\s)_\s")  # a digit that follows what ends a phrase, a stray underscore
    return reasons(
        (F.size("options") != 4, F.format_string("%d options", F.size("options"))),
        (F.col("cell") == "X", "dropped"),
        ((F.col("cell") != "X") & (F.length("cell") > 1), F.concat(F.lit("key "), F.col("cell"))),
        (words(F.col("q"), PICTURED), "figure or table"),
        (odd | misread, "odd characters"),
        (~F.col("in_group") & words(F.col("q"), ("passage", "author")), "mentions a passage but has none"),
        (F.col("in_group") & F.col("passage").isNull(), "in a passage group with no passage found"),
    )


def all_or_nothing(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """``rows`` if ``problems`` is empty, else none of them; decided inside the query."""
    clean = problems.agg((F.count("*") == 0).alias("_clean"))
    return rows.crossJoin(F.broadcast(clean)).filter("_clean").drop("_clean")


def contradicts(answer: Column, also: Column) -> Column:
    """A letter stated elsewhere in a solution that isn't its answer."""
    return F.exists(also, lambda x: x.isNotNull() & (x != answer))


def by_reason(rows: DataFrame, reason: Column) -> DataFrame:
    """Rows counted by their first reason of rejection; accepted rows count as "accepted"."""
    return rows.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def refused_topics(staged: DataFrame, topics: DataFrame) -> DataFrame:
    """Staged rows whose topic is blank or unknown."""
    return staged.join(topics.select(F.col("id").alias("topic")), "topic", "left_anti")


def template_tokens(template: DataFrame, values: DataFrame) -> DataFrame:
    """Tokens of a template (text) that no row of values (token) fills."""
    wanted = template.select(F.explode(F.regexp_extract_all("text", F.lit("__[A-Z_]+__"), F.lit(0))).alias("token")).distinct()
    return _as(wanted.join(values.select("token"), "token", "left_anti"), "V32", "template", F.col("token"), F.lit("nothing fills it"))


def violations(parts: Iterable[DataFrame]) -> DataFrame:
    """All violations of the given rules' results."""
    return reduce(DataFrame.unionByName, parts)

