"""Dates, templates and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expand_url(template: Column, day: Column) -> Column:
    """{yyyy} {mm} {dd} {d} {month} of a URL template filled in; the month's name is in lower case."""
    for token, form in (("{yyyy}", "yyyy"), ("{mm}", "MM"), ("{dd}", "dd"), ("{d}", "d"), ("{month}", "MMMM")):
        template = F.replace(template, F.lit(token), F.lower(F.date_format(day, form)))
    return template


def sunday_first(day: Column) -> Column:
    """Day of the week, 0 for Sunday."""
    return F.dayofweek(day) - 1


def skipped(day: Column, skips: Column) -> Column:
    return F.coalesce(F.array_contains(skips, sunday_first(day)), F.lit(False))


def last_sunday_of_may(year: Column) -> Column:
    return F.next_day(F.date_sub(F.make_date(year, F.lit(5), F.lit(31)), 7), "SU")


def sat_on(kind: Column, year: Column) -> Column:
    """The day by which a year's papers have been sat: 31 May for prelims, 1 September for mains."""
    return F.when(kind == "prelims", F.make_date(year, F.lit(5), F.lit(31))).when(kind == "mains", F.make_date(year, F.lit(9), F.lit(1)))


def next_exam(today: Column) -> Column:
    """This year's last Sunday of May, or next year's once that is past."""
    this = last_sunday_of_may(F.year(today))
    return F.when(this >= today, this).otherwise(last_sunday_of_may(F.year(today) + 1))


def substitute(template: Column, values: Column, token: str = r"__[A-Z_]+__") -> Column:
    """Tokens of a template replaced from a map in one pass: what is put in is never scanned again. Unknown tokens vanish."""
    gaps = F.split(template, token, -1)
    put = F.transform(F.regexp_extract_all(template, F.lit(token), F.lit(0)), lambda k: F.try_element_at(values, k))
    return F.array_join(F.zip_with(gaps, put, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")


def missing_tokens(template: Column, values: Column, token: str = r"__[A-Z_]+__") -> Column:
    return F.array_sort(F.array_except(F.regexp_extract_all(template, F.lit(token), F.lit(0)), F.map_keys(values)))


def keep_blocks(c: Column, name: str = "PWA") -> Column:
    """A conditional block's markers removed, its contents kept."""
    return F.regexp_replace(c, f"(?m)^<!--/?{name}-->\n", "")


def strip_blocks(c: Column, name: str = "PWA") -> Column:
    """Conditional blocks removed with their contents, then any marker left over."""
    return keep_blocks(F.regexp_replace(c, f"(?ms)^<!--{name}-->\n.*?^<!--/{name}-->\n", ""), name)


def embeddable(c: Column) -> Column:
    """The first style element and the body of a page; null without either."""
    style, body = F.regexp_extract(c, "(?s)(<style>.*?</style>)", 1), F.regexp_extract(c, "(?s)<body>\n?(.*?)\n?</body>", 1)
    return F.when((style != "") & c.rlike("(?s)<body>.*</body>"), F.concat(style, F.lit("\n"), body, F.lit("\n")))


def byte_size(c: Column) -> Column:
    """ "2.3 MB" and the like."""
    kb = c / 1024
    return F.when(c < 1024, F.format_string("%d B", c.cast("long"))).when(kb < 1024, F.format_string("%.0f KB", kb)).otherwise(F.format_string("%.1f MB", kb / 1024))
