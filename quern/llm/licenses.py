"""Licence scan over a positional rare-token index.

Templates are word sequences with a label: short phrases, which have to stand word by word, and whole licence
texts and notices, of which a file may change a quarter. Each batch of files gets postings (positions)
of licence words only. A template is looked up by its words of highest inverse template frequency (``ANCHORS`` of
a whole text); the other words' postings are intersected with them by relative position, rarest first. For a whole
text that intersection allows ``DRIFT`` words to be put in or left out, and its share of the template's words is the
coverage. Templates with mandatory key phrases count only if a file holds those too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import raw_texts, slices
from quern.llm.license_texts import TEXTS

#: Share of a whole text's words that a file has to hold in place, words by which places may shift, and rare words that it is looked up by.
COVERED, DRIFT, ANCHORS = 0.75, 16, 6

# Phrases and labels of the contract.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: What the method adds: phrase, label, key phrases that must stand in the same file.
MORE = (
    ("gnu general public license version 2", "gpl-2.0", ()),
    ("gnu general public license version 3", "gpl-3.0", ()),
    ("gnu lesser general public license", "lgpl", ()),
    ("gnu affero general public license", "agpl", ()),
    ("apache license version 2 0", "apache-2.0", ()),
    ("cc by nc", "cc-by-nc", ()),
    ("cc by sa", "cc-by-sa", ()),
    ("cc by nd", "cc-by-nd", ()),
    ("creative commons attribution", "cc-by", ("license",)),
    ("mozilla public license", "mpl", ()),
    ("eclipse public license", "epl", ()),
    ("bsd 2 clause", "bsd-2-clause", ("license",)),
    ("bsd 3 clause", "bsd-3-clause", ("license",)),
    ("redistribution and use in source and binary forms", "bsd", ("provided that the following conditions are met",)),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ("the software is provided as is",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ()),
    ("spdx license identifier", "spdx", ()),
    ("all rights reserved", "all-rights-reserved", ()),
)

#: A-Z lowered; what is not a letter, digit or part of a non-ASCII character becomes a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def fold_words(text: str | bytes) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text
    return raw.translate(_FOLD).split()


@dataclass
class Template:
    label: str
    words: list[int]
    order: list[int]  # offsets, rarest word first
    keys: list[int]  # templates of key phrases
    kind: str  # base, more or key


@dataclass
class Whole:
    """A whole licence text: its words by place, and the places of its rare words."""

    label: str
    words: list[bytes]
    anchors: list[int]
    keys: list[int]


@dataclass
class Index:
    number: dict[bytes, int]  # words of phrases and anchors
    templates: list[Template]
    wholes: list[Whole]
    anchored: dict[int, list[tuple[int, int]]]  # anchor word -> (whole text, its place there)


def anchor_places(words: list[bytes], df: Counter) -> list[int]:
    """Places of a text's ``ANCHORS`` words that stand in the fewest templates; of equals the longer, then the earlier."""
    first = {w: k for k, w in reversed(list(enumerate(words)))}
    return sorted(sorted(first.values(), key=lambda k: (df[words[k]], -len(words[k]), k))[:ANCHORS])


def build() -> Index:
    """Word numbers, phrases and whole texts."""
    phrases = [(p, lab, (), "base") for p, lab in BASE] + [(p, lab, k, "more") for p, lab, k in MORE]
    split_texts = [(lab, fold_words(t), keys) for lab, t, keys in TEXTS]
    keys = sorted({k for *_, ks, _ in phrases for k in ks} | {k for *_, ks in split_texts for k in ks})
    phrases += [(k, "", (), "key") for k in keys]
    number: dict[bytes, int] = {}
    df: Counter = Counter(w for p, *_ in phrases for w in set(fold_words(p))) + Counter(w for _, ws, _ in split_texts for w in set(ws))
    split = [[number.setdefault(w, len(number)) for w in fold_words(p)] for p, *_ in phrases]
    by_number = {k: df[w] for w, k in number.items()}
    at = {p: k for k, (p, *_) in enumerate(phrases)}
    templates = [Template(lab, ids, sorted(range(len(ids)), key=lambda o: (by_number[ids[o]], o)), [at[k] for k in ks], kind) for (p, lab, ks, kind), ids in zip(phrases, split)]
    wholes = [Whole(lab, ws, anchor_places(ws, df), [at[k] for k in ks]) for lab, ws, ks in split_texts]
    anchored: dict[int, list[tuple[int, int]]] = {}
    for t, whole in enumerate(wholes):
        for k in whole.anchors:
            anchored.setdefault(number.setdefault(whole.words[k], len(number)), []).append((t, k))
    return Index(number, templates, wholes, anchored)


def coverage(whole: Whole, words: list[bytes], starts: set[int]) -> float:
    """The largest share of a text's words that stand in ``words`` within ``DRIFT`` of their place, over possible starts."""
    at: dict[bytes, list[int]] = {}
    mine = set(whole.words)
    for p, w in enumerate(words):
        if w in mine:
            at.setdefault(w, []).append(p)
    if sum(w in at for w in whole.words) < COVERED * len(whole.words):
        return 0.0
    shift = np.concatenate([np.array(at.get(w, ()), np.int64) - k for k, w in enumerate(whole.words)])
    place = np.repeat(np.arange(len(whole.words)), [len(at.get(w, ())) for w in whole.words])
    order = np.argsort(shift, kind="stable")
    shift, place = shift[order], place[order]
    best = 0
    for start in starts:
        lo, hi = np.searchsorted(shift, (start - DRIFT, start + DRIFT + 1))
        if hi - lo > best:
            best = max(best, len(np.unique(place[lo:hi])))
    return best / len(whole.words)


def scan(raws: list[bytes], index: Index) -> list[tuple]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each UTF-8 text."""
    number, templates = index.number, index.templates
    get, ids, split = number.get, [], []
    for raw in raws:
        ws = fold_words(raw)
        split.append(ws)
        ids.append(np.fromiter((get(w, -1) for w in ws), np.int32, len(ws)))
    sizes = [len(ws) for ws in split]
    ids = np.concatenate([*ids, np.zeros(0, np.int32)])
    begin = np.cumsum([0, *sizes])
    hits = np.flatnonzero(ids >= 0)
    hits = hits[np.argsort(ids[hits], kind="stable")]
    cut = np.searchsorted(ids[hits], np.arange(len(number) + 1))
    found: list[dict[int, list]] = []
    for t in templates:
        starts = None
        for o in t.order:
            w = t.words[o]
            mine = hits[cut[w] : cut[w + 1]] - o
            starts = mine if starts is None else starts[np.isin(starts, mine, assume_unique=True)]
            if not len(starts):
                break
        starts = starts[starts >= 0]
        doc = np.searchsorted(begin, starts, side="right") - 1
        inside = starts + len(t.words) <= begin[doc + 1]
        by: dict[int, list] = {}
        for d, s in zip(doc[inside].tolist(), (starts - begin[doc])[inside].tolist()):
            by.setdefault(d, []).append(s)
        found.append(by)
    asked: dict[tuple[int, int], set[int]] = {}  # (file, whole text) -> where the text may start
    for w, places in index.anchored.items():
        mine = hits[cut[w] : cut[w + 1]]
        doc = np.searchsorted(begin, mine, side="right") - 1
        for d, p in zip(doc.tolist(), (mine - begin[doc]).tolist()):
            for t, k in places:
                if all(d in found[key] for key in index.wholes[t].keys):
                    asked.setdefault((d, t), set()).add(p - k)
    covered: dict[int, dict[str, float]] = {}
    for (d, t), starts in asked.items():
        c = coverage(index.wholes[t], split[d], starts)
        if c >= COVERED:
            covered.setdefault(d, {})[index.wholes[t].label] = c
    out = []
    touched = {d for by in found for d in by}
    for d, n in enumerate(sizes):
        if d not in touched:
            out.append((n, 0, None, None, "", "", 0.0))
            continue
        places = [s for t, by in zip(templates, found) if t.kind == "base" for s in by.get(d, ())]
        base = {t.label for t, by in zip(templates, found) if t.kind == "base" and d in by}
        more = {t.label for t, by in zip(templates, found) if t.kind == "more" and d in by and all(d in found[k] for k in t.keys)}
        longest = max((len(t.words) for t, by in zip(templates, found) if t.label in base | more and d in by), default=0)
        whole = covered.get(d, {})
        score = max(1 - 0.5**longest if longest else 0.0, max(whole.values(), default=0.0))
        out.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more | whole.keys())), score))
    return out


def scanned(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns for each row; score: 1 - 2 to the minus words of the longest phrase found, or a whole text's coverage if that is more.

    A null text is an empty one; null keys and repeated rows stay, other columns go, empty tables give no rows. Files are
    read whole; of several places of a whole text the best covered counts. No shuffle.
    """
    index = build()
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            rows = scan(raw_texts(b.column(1)), index)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(7))], names=names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _oracle_sql() -> str:
    """The same result in SQL: phrases looked for one by one in each text's words, whole texts by joining words and shifts."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = lambda p: b" ".join(fold_words(p)).decode()
    at = lambda p: f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = {x!r}' for k, x in enumerate(plain(p).split()))})"
    holds = lambda p: f"contains(j, ' {plain(p)} ')"
    places = " || ".join(f"list_transform({at(p)}, lambda i: i - 1)" for p, _ in BASE)
    base = ", ".join(f"CASE WHEN {holds(p)} THEN '{lab}' END" for p, lab in BASE)
    more = ", ".join(f"CASE WHEN {' AND '.join(map(holds, (p, *keys)))} THEN '{lab}' END" for p, lab, keys in MORE)
    longest = ", ".join(f"CASE WHEN {holds(p)} AND list_contains(phrases, '{lab}') THEN {len(plain(p).split())} ELSE 0 END" for p, lab, *_ in (*BASE, *MORE))
    distinct = lambda x: f"list_sort(list_distinct(list_filter({x}, lambda x: x IS NOT NULL)))"
    index = build()
    words = ", ".join(f"('{x.label}', {k}, '{w.decode()}', {str(k in x.anchors).lower()}, {len(x.words)})" for x in index.wholes for k, w in enumerate(x.words))
    keyed = " OR ".join(f"(label = '{lab}' AND {' AND '.join(map(holds, keys))})" for lab, _, keys in TEXTS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, {places} AS places FROM d),
l AS (SELECT *, {distinct(f"[{base}]")} AS base, {distinct(f"[{base}, {more}]")} AS phrases FROM p),
t AS (SELECT * FROM (VALUES {words}) v(label, k, word, rare, size)),
c AS (SELECT r, label, w FROM p, (SELECT DISTINCT label FROM t) WHERE {keyed}),
h AS (SELECT r, label, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM c),
m AS (SELECT DISTINCT r, label, k, place - k AS shift, rare, size FROM h JOIN t USING (label, word)),
a AS (SELECT DISTINCT r, label, shift FROM m WHERE rare),
s AS (SELECT m.r, m.label, a.shift, count(DISTINCT m.k) / any_value(m.size)::DOUBLE AS share FROM m JOIN a ON m.r = a.r AND m.label = a.label AND m.shift BETWEEN a.shift - {DRIFT} AND a.shift + {DRIFT} GROUP BY ALL),
x AS (SELECT r, list(DISTINCT label) AS wholes, max(share) AS covered FROM s WHERE share >= {COVERED} GROUP BY r),
y AS (SELECT l.*, covered, {distinct("list_concat(phrases, coalesce(wholes, []))")} AS labels FROM l LEFT JOIN x USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(labels, ',') AS labels,
  greatest(coalesce(covered, 0.0), CASE WHEN len(phrases) = 0 THEN 0.0::DOUBLE ELSE 1 - pow(0.5::DOUBLE, greatest({longest})) END) AS score FROM y
"""


ORACLE_SQL = _oracle_sql()
