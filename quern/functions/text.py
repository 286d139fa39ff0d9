"""Text columns: folding, tokens, escapes and repair of scanned text.

Every builder takes Columns and returns a Column, so it stays inside generated code.
A null input gives null, unless the docstring says otherwise. ``\\s`` and ``\\w`` are
Unicode-aware where the pattern starts with ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to say what a question is about.
STOP_WORDS = tuple(
    """a an the and or of in on at to for from by with as is are was were be been being
    this that these those it its which who whom whose what when where how why not no nor but if
    then than so such can could may might will would shall should must have has had do does did
    following consider statements statement correct given above only both neither one two three
    four all none about into over under between among during before after also more most other
    india indian indias year years new using used use""".split()
)

# All that a short option about statements can say.
STATEMENT_OPTIONS = (
    "1 only", "2 only", "3 only", "4 only", "1 and 2 only", "1 and 3 only", "1 and 4 only", "2 and 3 only", "2 and 4 only", "3 and 4 only",
    "1, 2 and 3", "1, 2 and 4", "1, 3 and 4", "2, 3 and 4", "1, 2 and 3 only", "1, 2 and 4 only", "1, 3 and 4 only", "2, 3 and 4 only",
    "1, 2, 3 and 4", "1, 2 and 3 and 4", "Both 1 and 2", "Neither 1 nor 2", "Only one", "Only two", "Only three", "Only four",
    "All three", "All four", "None", "None of the above", "All of the above",
)
# Digits and the letters that scans confuse them with.
CONFUSED_FROM, CONFUSED_TO = "lioszb", "110528"


def let(c: Column, of: Callable[[Column], Column]) -> Column:
    """``of(c)`` with ``c`` computed once, however often ``of`` uses it: nested uses would grow the expression without bound."""
    return F.transform(F.array(c), of)[0]


def squeeze(c: Column) -> Column:
    """Runs of white space, Unicode's included, as one blank; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case and squeezed: a question's identity."""
    return squeeze(F.lower(c))


def fold_alnum(c: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and blank as a blank, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))


def alnum_key(c: Column) -> Column:
    """Lower-case letters and digits only, with l and i read as 1."""
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), "li", "11")


def confusable_key(c: Column) -> Column:
    """Lower-case letters and digits only, with every confusable letter read as its digit."""
    return F.translate(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), CONFUSED_FROM, CONFUSED_TO)


def _references() -> dict[str, str]:
    """Named character references that end in a semicolon, as the language's library lists them."""
    from html.entities import html5

    return {name[:-1]: char for name, char in html5.items() if name.endswith(";")}


def unescape_html(c: Column) -> Column:
    """Character references decoded once: names, decimal and hexadecimal numbers. Unknown ones stay as they are.

    A text is cut at its references, which are then looked up in a constant map, so what one decodes to is never read again.
    """
    mark = r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
    named = F.create_map(*[F.lit(x) for pair in sorted(_references().items()) for x in pair])

    def char(r: Column) -> Column:
        inner = F.substring(r, F.lit(2), F.length(r) - 2)
        code = F.when(inner.rlike("^#[xX]"), F.conv(F.substring(inner, F.lit(3), F.length(inner)), 16, 10)).when(inner.startswith("#"), F.substring(inner, F.lit(2), F.length(inner))).cast("int")
        # a code point as UTF-32 bytes
        point = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.try_element_at(named, inner), point, r)

    def decoded(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(mark), F.lit(0)), char)
        return F.array_join(F.zip_with(F.split(t, mark, -1), found, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")

    return F.when(F.contains(c, F.lit("&")), let(c, decoded)).otherwise(c)


def visible_text(c: Column) -> Column:
    """Tags as blanks, references decoded, squeezed."""
    return squeeze(unescape_html(F.regexp_replace(c, "<[^>]+>", " ")))


def escape_html(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def terms(c: Column) -> Column:
    """Lower-case words of three letters or more that aren't stop words, in order."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z'-]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def rejoin_fragments(c: Column) -> Column:
    """See ``_rejoined``."""
    return let(c, _rejoined)


def _rejoined(c: Column) -> Column:
    """One line of text from lines that may be single letters or parts of words.

    Over 60 % of lines of one character: line breaks go. Else over a quarter of lines of at
    most two: only breaks between lower-case letters go. Other breaks become blanks.
    """
    lines = F.split(c, "\n", -1)
    n = F.greatest(F.size(lines), F.lit(1))
    one = F.size(F.filter(lines, lambda x: F.length(x) == 1)) / n
    tiny = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) <= 2)) / n
    joined = F.when(one > 0.6, F.replace(c, F.lit("\n"), F.lit(""))).when(tiny > 0.25, F.regexp_replace(c, "(?<=[a-z])\n(?=[a-z])", "")).otherwise(c)
    return squeeze(joined)


def minify_json(c: Column) -> Column:
    """White space outside of string literals removed."""
    return F.regexp_replace(c, r'("(?:\\.|[^"\\])*")|\s+', "$1")


def indent_json(c: Column, by: int = 2) -> Column:
    """JSON with each member on a line of its own, indented by depth; what stands inside string literals stays.

    A fold over the text's tokens: literals, empty containers, brackets, commas and colons.
    """
    token = r'"(?:\\.|[^"\\])*"|\{\s*\}|\[\s*\]|[{}\[\],:]|[^\s{}\[\],:"]+'
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit(" "), depth * by))

    def step(acc: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        empty = t.rlike(r"^(?:\{\s*\}|\[\s*\])$")
        depth = F.when(opens, acc["depth"] + 1).when(closes, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        shown = (
            F.when(opens, F.concat(t, line(depth))).when(closes, F.concat(line(depth), t)).when(t == ",", F.concat(t, line(depth)))
            .when(t == ":", F.lit(": ")).when(empty, F.regexp_replace(t, r"\s", "")).otherwise(t)
        )
        return F.struct(depth.alias("depth"), F.concat(acc["out"], shown).alias("out"))

    return F.aggregate(F.regexp_extract_all(c, F.lit(token), F.lit(0)), start, step)["out"]


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def cut_at_sentence(c: Column, most: int = 1200) -> Column:
    """At most ``most`` characters: up to the last sentence end in the second half, else cut there; an ellipsis follows."""
    return let(c, lambda c: _cut(c, most))


def _cut(c: Column, most: int) -> Column:
    head = F.substring(c, 1, most)
    stop = F.length(F.regexp_extract(head, r"(?s)^(.*\. )", 1)) - 1
    kept = F.when(stop > most // 2 + 1, F.substring(c, F.lit(1), stop)).otherwise(head)
    return F.when(F.length(c) > most, F.concat(F.rtrim(kept), F.lit(" \u2026"))).otherwise(c)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))


def latin_share(c: Column) -> Column:
    """Share of the letters that are ASCII; 0 without letters."""
    return F.regexp_count(c, F.lit("[A-Za-z]")) / F.greatest(F.regexp_count(c, F.lit(r"\p{L}")), F.lit(1))


def english_share(c: Column) -> Column:
    """Share of ASCII words of four letters or more; 0 with under 20 words."""
    words = F.regexp_count(c, F.lit("[A-Za-z]+"))
    return F.when(words < 20, F.lit(0.0)).otherwise(F.regexp_count(c, F.lit("[A-Za-z]{4,}")) / words)


# --- what booklets print on every page ------------------------------------------------------

_DASH = r"\s?[-\u2013\u2014]\s?"
#: A booklet's code, such as KSPC-B-GSPT/61A 3: letters, a letter, letters; then number and series, then the page.
BOOKLET = rf"\b[A-Z]{{2,5}}{_DASH}[A-Z]{_DASH}[A-Z]{{2,5}}\b(?:\s?/\s?[0-9]{{1,3}}\s?[A-D]\b)?(?:\s[0-9]{{1,2}}\b(?!\s?[.,)]))?"
#: A footer, such as (3 - A), and "please turn over" in brackets, with or without its letters apart.
FOOTER = rf"\(\s?[0-9]{{1,3}}{_DASH}[A-D]\s?\)"
TURN = r"(?:[0-9]{1,3}\s?)?[\[{]\s?P[\s.:;\-]{0,2}T?[\s.:;\-]{0,2}[O0][\s.:;!,]{0,2}[\]}]?"
FURNITURE = rf"{BOOKLET}(?:\s?{FOOTER})?|{FOOTER}|{TURN}"

# --- options about numbered statements ---------------------------------------------------


def _vocabulary(options, key) -> Column:
    pairs: dict[str, str | None] = {}
    for o in options:
        k = key(o)
        pairs[k] = None if k in pairs and pairs[k] != o else o
    return F.create_map(*[F.lit(x) for k, v in pairs.items() if v for x in (k, v)])


def _plain(o: str) -> str:
    return "".join(ch for ch in o.lower() if ch.isascii() and ch.isalnum())


def statement_combinations(most: int = 6, longest: int = 5) -> list[str]:
    """Every option over statements 1 to ``most``: "2 only", "1, 3 and 5 only", "Both 1 and 2" and so on."""
    out = ["Both 1 and 2", "Neither 1 nor 2", "Both I and II", "Neither I nor II", "Only one", "Only two", "Only three", "Only four", "All three", "All four", "None of the above", "All of the above"]
    for k in range(1, longest + 1):
        for chosen in combinations(range(1, most + 1), k):
            head, last = [str(x) for x in chosen[:-1]], str(chosen[-1])
            body = f"{', '.join(head)} and {last}" if head else last
            out += [f"{body} only"] + ([body] if head else [])
    return out


def without_option_tail(c: Column) -> Column:
    """An option without the rules, booklet codes and half footers at its end, however many there are."""
    return F.trim(F.regexp_replace(squeeze(c), rf"(?:\s?(?:[|]|{BOOKLET}|{_DASH}[A-D]\s?\)))+\s?$", ""))


def snap_option(c: Column, longest: int = 26) -> Column:
    """A short option put onto the closed vocabulary it must come from; longer ones are only cleaned."""
    exact = _vocabulary(STATEMENT_OPTIONS, _plain)
    near = _vocabulary(STATEMENT_OPTIONS, lambda o: _plain(o).translate(str.maketrans(CONFUSED_FROM, CONFUSED_TO)))

    def known(loose: Column) -> Column:
        return F.coalesce(F.try_element_at(exact, F.regexp_replace(F.lower(loose), "[^a-z0-9]", "")), F.try_element_at(near, confusable_key(loose)), loose)

    return let(without_option_tail(c), lambda t: F.when(F.length(t) > longest, t).otherwise(let(F.regexp_replace(t, r"\b[lJI]and\b", "1 and"), known)))


def snap_combination(c: Column, statements: Column, longest: int = 30) -> Column:
    """An option put onto ``statement_combinations``; an 8 may be a 3 where there are under eight statements."""
    known = _vocabulary(statement_combinations(), lambda o: _plain(o).translate(str.maketrans("li", "11")))

    def snapped(c: Column) -> Column:
        key = alnum_key(c)
        as3 = F.when((statements < 8) & F.contains(key, F.lit("8")), F.try_element_at(known, F.replace(key, F.lit("8"), F.lit("3"))))
        return F.when(F.length(c) > longest, c).otherwise(F.coalesce(F.try_element_at(known, key), as3, c))

    return let(c, snapped)


#: Tokens of a reference to numbered statements. A stroke is a 1 that a scan made a letter.
_STROKE = r"[lLI|i](?![A-Za-z])"
_JOINING = r"(?i:and|only|0nly|both|neither|nor|or)"
_TOKEN = rf"(?:{_JOINING}(?![A-Za-z])|[0-9]+|,|{_STROKE})"


def _reference_tokens(head: Column) -> Column:
    """A reference's tokens with strokes as 1 and "0nly" as "only"."""
    found = F.regexp_extract_all(head, F.lit(_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike("^[lLI|i]$"), F.lit("1")).when(F.lower(t) == "0nly", F.lit("only")).otherwise(t))


def _spoken(tokens: Column) -> Column:
    """Tokens one blank apart, commas close to what they follow."""
    return F.replace(F.array_join(tokens, " "), F.lit(" ,"), F.lit(","))


def digits_for_letters(c: Column) -> Column:
    """In an option that is nothing but statement numbers and joining words, letters read for digits are put back."""

    def mended(t: Column) -> Column:
        # "land" is a 1 that ran into "and"; numbers and words that touch come apart
        apart = F.regexp_replace(F.regexp_replace(t, r"(?i)\bland(?![a-z])", "1 and"), r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ")
        pure = apart.rlike(rf"^\s*{_TOKEN}(?:\s*{_TOKEN})*\s*$") & apart.rlike(rf"[0-9]|{_STROKE}")
        close = F.replace(_spoken(_reference_tokens(apart)), F.lit(", "), F.lit(","))
        return F.when(pure, F.when(F.contains(t, F.lit(", ")), _spoken(_reference_tokens(apart))).otherwise(close)).otherwise(t)

    return let(squeeze(c), mended)


def spaced_reference(c: Column) -> Column:
    """A statement reference spaced as the paper prints it: "1,2and3only" becomes "1, 2 and 3 only".

    The reference's tokens are read off the option's head and written anew; what follows stays. A first
    token "and" lost its 1; "Both" with no number before "and 2" lost its 1 too.
    """

    def again(t: Column) -> Column:
        head = F.regexp_extract(t, rf"^(?:[\s.\u00b0\-]*{_TOKEN})+", 0)
        rest = F.ltrim(F.substring(t, F.length(head) + 1, F.length(t)))
        lost = F.regexp_replace(F.regexp_replace(_spoken(_reference_tokens(head)), r"^and (?=[0-9])", "1 and "), r"^Both and 2$", "Both 1 and 2")
        about = head.rlike("[0-9]") & (head.rlike("(?i)and|nly") | F.contains(head, F.lit(","))) & ~is_ordering(t)
        return F.when(about, F.trim(F.concat(lost, F.lit(" "), rest))).otherwise(t)

    return let(squeeze(c), again)


def is_ordering(c: Column) -> Column:
    """ "3-1-2" and the like."""
    return c.rlike(r"^[0-9]+(?:\s*[-\u2013]\s*[0-9]+)+$")


def bad_ordering(c: Column) -> Column:
    """True for an ordering that isn't a permutation of 1 to its length."""
    return let(c, _bad_ordering)


def _bad_ordering(c: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return is_ordering(c) & (F.array_sort(parts) != F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))))


REFERENCE = r"(?i)(?:(?:Only\s+)?[0-9](?:\s*,\s*[0-9])*(?:\s+and\s+[0-9])*(?:\s+only)?|Both\s+1\s+and\s+2|Neither\s+1\s+nor\s+2)"


def reference_head(c: Column) -> Column:
    """The statement reference that an option starts with; null if it doesn't end cleanly."""
    return let(c, _reference_head)


def _reference_head(c: Column) -> Column:
    head = F.regexp_extract(c, f"^({REFERENCE})", 1)
    rest = F.substring(c, F.length(head) + 1, F.length(c))
    clean = (head != "") & ((rest == "") | rest.rlike(r"^\s")) & ~rest.rlike(r"^\s*[,&]") & ~rest.rlike(r"^\s*\W*\s*(?:an|nor\b|or\b)")
    return F.when(clean, head)


#: Marks that are no part of an option where they stand at its end or beginning: specks, rules, lone signs.
_SPECK = "[|~_*\u00b0;:\u00bb\u00ab\u00a7=<>^]"
_QUOTES = (("\u2018", "\u2019"), ("'", "'"))


def _even_quotes(t: Column) -> Column:
    """A quotation mark at the end goes if it opens one, closes none, or is the odd one of its kind."""
    for opening, closing in _QUOTES:
        ends = t.endswith(closing)
        opened = F.size(F.split(t, opening)) - 1
        closed = F.size(F.split(t, closing)) - 1
        odd = (closed % 2 == 1) if opening == closing else (closed > opened)
        cut = F.rtrim(F.substring(t, F.lit(1), F.length(t) - 1))
        t = F.when((ends & odd) | (t.endswith(opening) if opening != closing else F.lit(False)), cut).otherwise(t)
    return t


def tidy_tail(c: Column) -> Column:
    """An option without the specks, rules and stray quotes at either end.

    A full stop, comma, dash or quote at the end goes only if a blank stands before it.
    """
    t = F.regexp_replace(F.trim(c), rf"^(?:(?:{_SPECK}|[^\w\s(\u201c\u2018\"'])+\s*|['\u2018]\s+)+", "")
    t = F.regexp_replace(t, rf"(?:\s*{_SPECK}+|\s+[.,\-'\u2018\u2019]+)+\s*$", "")
    return let(F.trim(t), _even_quotes)


def cut_at_next_question(c: Column, n: Column) -> Column:
    """What follows the start of question n + 1 removed; a start at the very beginning stays."""
    pattern = F.concat(F.lit("(?s)(?<=.)(?:(?<=\\s)|(?<=[\u2018'|.*]))\\s*"), (n + 1).cast("string"), F.lit("\\s*[.,]{1,2}\\s+(?=[A-Z\u2018\u201c'\"]).*$"))
    return F.rtrim(F.regexp_replace(c, pattern, F.lit("")))


def renumber_statements(c: Column) -> Column:
    """A statement list in which a 3 was read as 8, put back in order."""
    return let(c, _renumbered)


def _renumbered(c: Column) -> Column:
    """A fold over the list's markers that counts what number is due."""
    mark = r"(?:(?<=\s)|^)[1-9](?=\s*[.,]\s)"
    marks = F.regexp_extract_all(c, F.lit(mark), F.lit(0))
    gaps = F.split(c, mark, -1)
    start = F.struct(F.lit(1).alias("due"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        wrong = (m == "8") & (acc["due"] == 3)
        new = F.when(wrong, F.lit("3")).otherwise(m)
        due = F.when(wrong, F.lit(4)).when(m.cast("int") == acc["due"], acc["due"] + 1).otherwise(acc["due"])
        return F.struct(due.alias("due"), F.concat(acc["out"], F.array(new)).alias("out"))

    fixed = F.aggregate(marks, start, step)["out"]
    return F.array_join(F.zip_with(gaps, fixed, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def tidy_stem(c: Column) -> Column:
    """Page furniture, rules and specks out of a question's text; statement numbers put back in order."""
    t = F.regexp_replace(squeeze(c), FURNITURE, " ")
    alone = rf"(?:^|(?<=\s))(?:[|]\s?[0-9]{{2,3}}[.]?|{_SPECK}+|[\u2018'](?=\s[0-9]\s?[.,]\s))(?=\s|$)"
    t = squeeze(F.regexp_replace(t, alone, " "))
    return renumber_statements(F.regexp_replace(t, rf"(?:\s+(?:{_SPECK}|[.,])+)+$", ""))


def clean_scan_line(c: Column) -> Column:
    """A scanned line without booklet codes and page-turn marks; null if nothing else is left."""

    def something(t: Column) -> Column:
        letters = F.regexp_replace(t, "[^A-Za-z0-9]", "")
        turn = (F.length(t) <= 10) & F.contains(letters, F.lit("P")) & letters.rlike("^[PTOQEUNA0]+$")
        return F.when((letters == "") | turn | t.rlike(rf"^{_DASH}?[A-D]\s?\)?$"), F.lit(None)).otherwise(t)

    at_end = rf"(?:\s+(?:{_DASH}[A-D]\s?\)|[\\|]+\)?|{TURN}))+\s*$"
    return let(F.trim(F.regexp_replace(F.regexp_replace(c, FURNITURE, " "), at_end, "")), something)


def clean_prose(c: Column) -> Column:
    """A passage without booklet codes, page-turn marks, stray underscores and rules."""
    t = F.regexp_replace(c, rf"{FURNITURE}|(?:^|(?<=\s))[_|]+(?=\s|$)", " ")
    return squeeze(F.regexp_replace(t, r"(?<=\w)_(?=\s|$)", " "))


def restore_brackets(c: Column) -> Column:
    """ "b) text" as "(b) text" where the opening bracket was lost."""
    return F.regexp_replace(c, r"(?<![A-Za-z0-9(])([a-d])\)(?=\s)", "($1)")


def split_options(c: Column) -> Column:
    """What follows each "(a)" to "(d)" marker, squeezed; an empty array without a marker."""
    parts = F.split(c, r"\([a-d]\)\s*", -1)
    return F.when(F.size(parts) < 2, F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), squeeze))


#: What opens a line of its own: a statement's number, and the words that close a question about statements.
_NUMERAL = r"(?:1?[1-9]|10|I{1,3}|I?V|VI)"
CLOSING = ("Which of the", "Which one of the", "Select the", "How many", "Code:", "Code :")


def lay_out_statements(c: Column) -> Column:
    """Numbered statements and the closing question on lines of their own."""
    breaks = rf"(?:^|\s)(?=(?:{_NUMERAL}\.\s\S|{'|'.join(CLOSING)}))"
    return F.trim(F.array_join(F.filter(F.split(squeeze(c), breaks, -1), lambda x: x != ""), "\n"))


#: How solutions state their answer, and what begins their list of sources.
_STATED = r"option\s*\(?\s*[a-d]\s*\)?\s*is\s*(?:the\s*)?correct(?:\s*answer)?\s*[.]?"
_SOURCES = ("Source", "Sources", "Subject", "KnowledgeBase", "Knowledge Base")


def explanation(c: Column, most: int = 1200) -> Column:
    """The argument of a solution: key cells, sources and the statement of the answer removed, cut at a sentence."""
    argument = F.split(c, rf"\b(?:{'|'.join(_SOURCES)})\s*(?::\)?|\))", 2)[0]
    cells = r"(?:Answer\s+Key\s*)?(?:[0-9]{1,3}\s*\.\s*\([a-d]\)\s*){5,}"
    told = rf"(?i)(?:^\s*|(?:hence|therefore),?\s*){_STATED}"
    return cut_at_sentence(squeeze(F.regexp_replace(argument, rf"{cells}|{told}", " ")), most)


def relabel_markers(c: Column) -> Column:
    """Option markers relabelled a, b, c, d by place; the count starts anew at each question's start.

    The text is cut at question starts first; within a question the markers are numbered by their place among
    its gaps, and a fifth one becomes (a) again.
    """
    start, mark = r"(?m)(?=^\s*[0-9]{1,3}[.,]\s+\S)", r"[({\[f|]\s*(?:[a-d@][a-z]?|[a-z][a-d@][a-z]?)\s*[)}\]|]"
    label = lambda k: F.concat(F.lit("("), F.substring(F.lit("abcd"), (k - 1) % 4 + 1, F.lit(1)), F.lit(") "))
    relabelled = lambda part: F.array_join(F.transform(F.split(part, mark, -1), lambda gap, k: F.when(k == 0, gap).otherwise(F.concat(label(k), gap))), "")
    return F.array_join(F.transform(F.split(c, start, -1), relabelled), "")


# Lines that booklets print on every page; a publisher's own go to ``more``.
BOOKLET_LINES = (
    r"\\?\[\s*[0-9]{1,3}\s*\\?\]", r"Answer\s+Key\s*&\s*Detailed\s+Answer\s+Explanations", r"Space\s+for\s+Rough\s+Work",
    r"(?:Copyright\s*)?\u00a9\s*(?:by\s*)?(?:All\s+rights\s+(?:are\s+)?reserved\.?)?",
)


def without_booklet_lines(c: Column, more: tuple[str, ...] = ()) -> Column:
    """Lines that a booklet repeats, and patterns of a publisher's own, removed in one pass."""
    return squeeze(F.regexp_replace(c, "(?is)" + "|".join([*more, *BOOKLET_LINES]), " "))
