"""Repair of a question's options together: what one means depends on the others.

An option about statements is a reference: numbers, joined by commas and "and", with "only" around
them, or "Both ... and ..." and "Neither ... nor ...". Options are read by a tokenizer; a number keeps all
values that its shape in a scan may stand for, and the statements of the stem, the other options and the
order inside the option decide between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

_TOKENS = re.compile(r"(?P<word>[^\W\d_]+)|(?P<digits>\d[\dSB]*)|(?P<comma>,)|(?P<dash>[-–])|(?P<other>\S)")
#: Strokes of a numeral, whatever a scan made of them; V adds five, or four after one stroke.
_STROKES = frozenset("Il|")
_NUMERALS = ("", "I", "II", "III", "IV", "V", "VI")
JOINING = frozenset(("and", "only", "both", "neither", "nor", "or"))


@dataclass
class Token:
    kind: str  # word, digits, comma, dash, other
    text: str
    end: int


def tokens(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], m.end()) for m in _TOKENS.finditer(text)]


def numeral(word: str) -> int | None:
    """The value of a Roman numeral up to VI, read by its strokes; None if it isn't one."""
    strokes, five, after = word.partition("V")
    if set(strokes + after) - _STROKES or not word:
        return None
    if not five:
        return len(strokes) if len(strokes) <= 3 else None
    return 5 + len(after) if not strokes and len(after) <= 1 else 4 if strokes and len(strokes) == 1 and not after else None


def like_three(digits: str) -> bool:
    """May a scan have made this of a 3? An 8, or two and three characters of 3, 8, 0, S and B with one that is round."""
    return digits == "8" or (2 <= len(digits) <= 3 and set(digits) <= set("380SB") and bool(set(digits) & set("38")))


@dataclass
class Reference:
    """What an option's head says: number tokens and their values, and the text that follows."""

    values: list[int]
    shape: list[str]  # the head's tokens, with "#" for each number
    rest: str

    def spoken(self, name=str) -> str:
        """The reference as a paper prints it."""
        left = iter(self.values)
        said = " ".join(name(next(left)) if t == "#" else t for t in self.shape)
        return said.replace(" ,", ",")

    @property
    def pure(self) -> bool:
        """No word of three letters or more follows."""
        return not re.search(r"[^\W\d_]{3,}", self.rest)


def reference(option: str, value) -> Reference | None:
    """The reference that an option begins with, or None if it has none or breaks off inside one.

    ``value`` gives a token's number or None. Joining words stand only where the grammar has them:
    [Only] n {, n} {and n} [only] | Both n and n | Neither n nor n.
    """
    found = tokens(option)
    values, shape, end, at, want = [], [], 0, 0, "number"
    lead = found[0].text.lower() if found else ""
    if lead in ("only", "both", "neither"):
        shape.append(found[0].text)
        at = 1
    joint = "nor" if lead == "neither" else "and"
    while at < len(found):
        t = found[at]
        n = value(t)
        low = t.text.lower()
        if want == "number" and n is not None:
            values.append(n), shape.append("#")
            want, end = "joint", t.end
        elif want == "joint" and (t.kind == "comma" or low == joint) and at + 1 < len(found) and value(found[at + 1]) is not None:
            shape.append("," if t.kind == "comma" else low)
            want = "number"
        elif want == "joint" and low == "only":
            shape.append(low)
            end = t.end
            break
        else:
            break
        at += 1
    rest = option[end:]
    if not values or (lead in ("both", "neither") and len(values) != 2) or (rest and not rest[0].isspace()):
        return None
    follows = next(iter(tokens(rest)), None)
    if follows and (follows.kind == "comma" or follows.text == "&" or follows.text.lower() in ("an", "and", "nor", "or")):
        return None  # it goes on, so it wasn't read to its end
    return Reference(values, shape, rest)


def roman_value(t: Token) -> int | None:
    if t.kind == "digits":
        return 1 if t.text == "1" else None
    return numeral(t.text) if t.kind == "word" or t.text == "|" else None


def romans(options: list[str]) -> list[str]:
    """Numerals put right ("Il" is II, "Ill" is III, a lone 1 is I) where two options or more are pure references.

    Numerals of a reference rise: one that repeats its predecessor has lost a stroke, unless another option says so already.
    """
    read = [reference(o, roman_value) for o in options]
    lettered = [r is not None and any(t.kind == "word" and numeral(t.text) for t in tokens(o)) for o, r in zip(options, read)]
    if sum(ok and r.pure for ok, r in zip(lettered, read)) < 2:
        return options
    name = _NUMERALS.__getitem__
    said = [r.spoken(name) if r else o for o, r in zip(options, read)]
    for k, r in enumerate(read):
        if r and len(r.values) > 1 and r.values[-1] == r.values[-2] and r.values[-1] < 6:
            more = Reference([*r.values[:-1], r.values[-1] + 1], r.shape, r.rest).spoken(name)
            said[k] = said[k] if more in said else more
    return said


def statements_in(stem: str) -> set[int]:
    """Numbers of the stem's statement list: single digits before a full stop or comma, an 8 where 3 is due counting as 3."""
    out: set[int] = set()
    found = tokens(stem)
    for t, after in zip(found, found[1:]):
        alone = t.kind == "digits" and len(t.text) == 1 and t.text != "0" and after.text in (".", ",")
        before, behind = stem[: t.end - 1][-1:], stem[after.end : after.end + 1]
        if alone and (not before or before.isspace()) and behind.isspace():
            n = int(t.text)
            out.add(3 if n == 8 and out and max(out) == 2 else n)
    return out


def ordering(option: str) -> list[str] | None:
    """The items of an order such as "3-1-2"; None if the option is something else."""
    found = tokens(option)
    digits, dashes = found[::2], found[1::2]
    good = len(found) > 1 and len(found) % 2 and all(t.kind == "digits" for t in digits) and all(t.kind == "dash" for t in dashes)
    return [t.text for t in digits] if good else None


def not_an_order(option: str) -> bool:
    """An order whose items aren't 1 to their number, each once."""
    items = ordering(option)
    return items is not None and sorted(items) != [str(k) for k in range(1, len(items) + 1)]


def restored_order(items: list[str]) -> list[str]:
    """An order with 3 put where a shape of 3 stands, if that makes it whole."""
    whole = [str(k) for k in range(1, len(items) + 1)]
    again = ["3" if x not in whole and like_three(x) else x for x in items]
    return again if sorted(again) == whole else items


def tidied(stem: str, options: list[str]) -> list[str]:
    """Cleaned options (see ``functions.text``) with 8 read as 3 where the stem has no such statement, and numerals put right."""
    listed = statements_in(stem)
    # 8 may be a statement of its own only in a stem that has one, or that lists more than four without a third
    three = not {5, 6, 7} <= listed and (not listed or 3 in listed)

    def plain(t: Token) -> int | None:
        return int(t.text) if t.kind == "digits" and len(t.text) == 1 else None

    def repaired(t: Token) -> int | None:
        return 3 if three and t.kind == "digits" and like_three(t.text) else plain(t)

    about = sum(bool((r := reference(o, plain)) and r.pure) for o in options) >= 2
    out = []
    for o in options:
        items = ordering(o)
        r = reference(o, repaired) if about else None
        if items:
            out.append("-".join(restored_order(items) if three else items))
        else:
            out.append(r.spoken() if r else o)
    return romans(out)


def tidied_questions(questions: DataFrame, *, key: str = "id", stem: str = "q", options: str = "options") -> DataFrame:
    """(key, options) for questions whose options were first cleaned by expressions. Null options stay null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.assign(**{options: [None if o is None else tidied(s or "", [x or "" for x in o]) for s, o in zip(f[stem], f[options])]})
            yield f[[key, options]]

    return questions.select(key, stem, options).mapInPandas(run, f"`{key}` {questions.schema[key].dataType.simpleString()}, `{options}` array<string>")
