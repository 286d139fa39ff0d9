"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus-digit, dotted digits, neighbouring
digits, URL schemes and cue words. From each anchor a deterministic parser expands to the
span's boundaries and validates it. Kinds whose contract is a leftmost, non-overlapping
pattern keep the end of their last match, so what they find equals a scan of the
whole text with that pattern.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import slices, texts

#: Kinds in the order of a span list: those of the base, then what the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*://|www\.)[^\s<>\"'`{}|\\^]+")
_IBAN = re.compile(r"[\s:#.=-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8})\b")
#: Blanks are taken whole (possessive), so a run of them is read a bounded number of times.
_ACCOUNT = re.compile(r"(?:\s*+(?:number|no\.?|nr\.?|#|id))?+\s*+[:#=]?+\s*+([0-9][0-9 -]{4,22}[0-9])(?![0-9])", re.I)
_SECRET = re.compile(r"[A-Za-z0-9_-]{0,20}+[\"']?+\s*+[:=]\s*+[\"']?+([A-Za-z0-9_\-/+=.]{16,})")
_SCHEMES = ("http://", "https://", "ftp://", "www.")
_ACCOUNTS = ("account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
_SECRETS = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key")


def anchors():
    """The automaton of all anchors; a task builds it once."""
    import ahocorasick

    found = ahocorasick.Automaton()

    def add(word: str, kind: str) -> None:
        found.add_word(word, (*found.get(word, ()), (kind, len(word))))

    add("@", "email")
    for a in "0123456789":
        add(f"+{a}", "phone")
        for b in "0123456789":
            add(f"{a}.{b}", "ip")
            for between in ("", " ", "-"):
                add(f"{a}{between}{b}", "card")
    for kind, cues in (("url", _SCHEMES), ("iban", ("iban",)), ("account", _ACCOUNTS), ("secret", _SECRETS)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                add(form, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _iban_ok(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str, found_by) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start; ``found_by``: what ``anchors()`` returns."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    for end, kinds in found_by.iter(text):
        for kind, n in kinds:
            at, floor = end + 1 - n, done[kind]
            if at < floor:
                continue
            if kind == "email":
                left = at
                while left > floor and text[left - 1] in _LOCAL:
                    left -= 1
                m = _DOMAIN.match(text, at)
                if m and left < at:
                    out[kind].append((left, m.end()))
                    done[kind] = m.end()
            elif kind == "ip":
                while at > floor and (text[at - 1] in _DIGITS or (text[at - 1] == "." and at - 1 > floor and text[at - 2] in _DIGITS)):
                    at -= 1
                m = _DOTTED.match(text, at)
                parts = m[0].split(".")
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                        out[kind].append((at, at + size))
                    at += size + 1
                done[kind] = m.end()
            elif kind == "card":
                while at > floor and (text[at - 1] in _DIGITS or (text[at - 1] in " -" and at - 1 > floor and text[at - 2] in _DIGITS)):
                    at -= 1
                m = _RUN.match(text, at)
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out[kind].append(m.span())
                done[kind] = m.end()
            elif kind == "phone":
                m = _PHONE.match(text, at)
                if m:
                    if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                        out[kind].append(m.span())
                    done[kind] = m.end()
            elif kind == "url":
                m = _URL.match(text, at)
                if m:
                    stop = m.start() + len(m[0].rstrip(".,;:!?)]*#%&$"))
                    if "." in text[at:stop].split("://")[-1]:
                        out[kind].append((at, stop))
                    done[kind] = m.end()  # what begins later in the run ends alike
            else:
                rule = {"iban": _IBAN, "account": _ACCOUNT, "secret": _SECRET}[kind]
                m = rule.match(text, end + 1)
                if m and (kind != "iban" or _iban_ok(m[1])):
                    out[kind].append(m.span(1))
                    done[kind] = m.end()
    return [(kind, s, e) for kind in KINDS for s, e in out[kind]]


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    merged: list[list] = []
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    out, last = [], 0
    for kind, s, e in merged:
        out += [text[last:s], f"[{kind.upper()}]"]
        last = e
    return "".join([*out, text[last:]])


def with_spans(docs: DataFrame, *, text: str = "text", to: str = "pii") -> DataFrame:
    """``docs`` with ``to``: an array of (kind, start, end). A null text has none; other columns stay."""
    frame = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != to])
    at = frame.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for b in slices(batches, 1000):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t, automaton)] for t in texts(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, to])

    schema = frame.withColumn(to, F.expr("cast(array() as array<struct<kind: string, start: bigint, end: bigint>>)")).schema
    return frame.mapInArrow(run, schema)


def digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of the base kinds, base_sha256 and spans for each row. Null keys and repeated rows stay."""
    names = [key, *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for b in slices(batches, 1000):
            rows = []
            for t in texts(b.column(1)):
                found = spans(t, automaton)
                said = [f"{k}:{s}:{e}" for k, s, e in found]
                n = [sum(f[0] == k for f in found) for k in BASE]
                rows.append((*n, hashlib.sha256(",".join(said[: sum(n)]).encode()).hexdigest(), ",".join(said)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(6))], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, *, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind; null texts stay null. ``size`` is counted anew if it is a column."""
    at = docs.columns.index(text)
    also = docs.columns.index(size) if size in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for b in slices(batches, 1000):
            new = [t if t is None else redact(t, spans(t, automaton)) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if also is not None:
                columns[also] = pa.array([None if t is None else len(t) for t in new], b.schema.field(also).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
