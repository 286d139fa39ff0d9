"""Labels from text: papers, captions, languages, series, sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Subject labels and the subject whose topics they name.
SUBJECT_OF = {
    "polity": "polity", "economics": "economics", "economy": "economics", "history": "history", "modern history": "history", "ancient history": "history",
    "medieval history": "history", "art and culture": "history", "geography": "geography", "environment": "environment", "ecology": "environment",
    "science": "scitech", "science and technology": "scitech", "international relations": "ir", "security": "security", "internal security": "security",
}
ENGLISH_WORDS = r"(?i)\b(?:the|following|which|statements|consider|reference|correct|above)\b"
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4"}


def _mapped(c: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), c)


def paper_code(label: Column) -> Column:
    """essay, gs1 to gs4, or null; the label has to match from end to end."""
    n = F.lower(F.regexp_extract(label, r"(?i)^general\s*studies\s*paper\s*[-\u2013]?\s*(IV|III|II|I|[1-4])$", 1))
    return F.when(label.rlike("(?i)^essay$"), F.lit("essay")).when(n != "", F.concat(F.lit("gs"), F.coalesce(_mapped(n, _ROMAN), n)))


def exam_of(caption: Column) -> Column:
    """(kind, year) of an exam table's caption; null if it isn't one."""
    p = r"(?i)civil\s*services\s*\(\s*(preliminary|main)\s*\)\s*exam(?:ination)?\.?\s*,?\s*([0-9]{4})"
    kind = F.lower(F.regexp_extract(caption, p, 1))
    return F.when(kind != "", F.struct(F.when(kind == "preliminary", "prelims").otherwise("mains").alias("kind"), F.regexp_extract(caption, p, 2).cast("int").alias("year")))


def optional_paper(label: Column, name: str) -> Column:
    """p1 or p2 if the label is a paper of the optional subject whose name matches ``name``."""
    n = F.lower(F.regexp_extract(label, rf"(?i)^{name}\s*paper\s*[-\u2013]?\s*(II|I|[12])$", 1))
    return F.when(n.isin("i", "1"), "p1").when(n.isin("ii", "2"), "p2")


def is_question_page(c: Column) -> Column:
    """English words, numbered lines and option marks enough for a page of questions."""
    return (F.regexp_count(c, F.lit(ENGLISH_WORDS)) >= 4) & (F.regexp_count(c, F.lit(r"(?m)^\s*[0-9]{1,3}\.\s+\S")) >= 2) & (F.regexp_count(c, F.lit(r"\([a-d]\)")) >= 2)


def series_letter(c: Column) -> Column:
    """A to D from "Series A" or the end of a booklet code; null if neither stands there."""
    p = r"(?i)(?<![A-Za-z])Series\s*[-\u2013]?\s*([A-D])(?![A-Za-z])|/\s*[0-9]{1,3}\s*([A-D])(?![A-Za-z])"
    return F.nullif(F.upper(F.coalesce(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.regexp_extract(c, p, 2))), F.lit(""))


def key_file_code(href: Column, year: Column) -> Column:
    """gs1 or gs2 if a link's file name looks like that year's answer key, else null. The longer numeral is tested first."""
    name = F.lower(F.regexp_extract(href, "([^/]*)$", 1))
    named = (F.contains(name, F.lit("anskey")) | F.contains(name, F.lit("answer"))) & (F.contains(name, year.cast("string")) | F.contains(name, (year % 100).cast("string"))) & name.rlike("csp|civilservicesp|prelim")
    numeral = lambda n: rf"(?:paper-|paper_|paper%20|studies-|studies_|gs-){n}"
    return F.when(named & name.rlike(numeral("ii")), "gs2").when(named & name.rlike(numeral("i")), "gs1")


def subject_hint(hint: Column, test: Column) -> Column:
    """The subject that a question's hint names, else the one in its test's title."""
    first = F.lower(F.trim(F.split(F.coalesce(hint, F.lit("")), " / ", 2)[0]))
    title = F.lower(F.trim(F.regexp_extract(F.coalesce(test, F.lit("")), r" - ([A-Za-z &]+) \(V", 1)))
    return F.coalesce(_mapped(first, SUBJECT_OF), _mapped(title, SUBJECT_OF))


def stated_answer(c: Column) -> Column:
    """The letter of the last "option x is correct"; null without one."""
    return F.lower(F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?i)option\s*\(?\s*([a-d])\s*\)?\s*is\s*(?:the\s*)?correct"), F.lit(1)), F.lit(-1)))


def needs_picture(c: Column) -> Column:
    return c.rlike(r"(?i)\b(?:map|figure|diagram|graph|image|picture|shown below|following sketch)\b")


def series_title(publisher: str, title: str, number: Column, code: Column, year: int) -> Column:
    """A test's source: name, title with a two-digit number and the code, year."""
    return F.struct(F.lit(publisher).alias("name"), F.format_string(f"{title} {year}, Test %02d (%s)", number, code).alias("test"), F.lit(year).alias("year"))
