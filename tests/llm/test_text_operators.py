"""Row-wise operators against brute force: personal data, licences, rules, language, quality, pages."""

import hashlib
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from quern.llm import gbt, html_crf, langid, licenses, pii, quality_model, rule_ledger

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
#: Nulls in every column, empty and long texts, repeated rows.
ODD = [(1, "a plain text of a few words", "en", "s", 27), (1, "a plain text of a few words", "en", "s", 27), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "null id", "en", None, 7), (None, None, None, None, None), (4, " \n\t ", "en", "s", 4), (5, LONG, "en", "t", len(LONG))]


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# --- personal data --------------------------------------------------------------------------


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_pii_equals_the_patterns():
    rnd, found = random.Random(1), pii.anchors()
    parts = ["1", "2", "23", "255", "256", ".", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "4952935900253052", "é", "%", "::", "\n"]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [s for s in pii.spans(t, found) if s[0] in pii.BASE] == base_spans(t), t


def test_pii_digest_and_redaction(spark):
    t = 'mail jo.1@mail8.example.com or +1 (017) 555-7713, 10.0.0.1; card 4952935900253052 token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'
    rows = pii.digest(docs(spark, [*ODD, (9, t, "en", "s", len(t))])).collect()
    assert len(rows) == len(ODD) + 1
    by = {r.doc_id: r for r in rows}
    assert [by[9][f"n_{k}"] for k in pii.BASE] == [1, 1, 1, 1] and ",secret:" in by[9].spans
    said = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(t))
    assert by[9].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    new = {r.doc_id: r for r in pii.redacted(docs(spark, [(9, t, "en", "s", 1), (2, None, None, None, None)])).collect()}
    assert new[9].text == 'mail [EMAIL] or [PHONE], [IP]; card [CARD] token = "[SECRET]"' and new[9].n_chars == len(new[9].text) and new[2].text is None
    extra = docs(spark, ODD).withColumnRenamed("source", "pii")
    assert pii.with_spans(extra).columns == ["doc_id", "text", "lang", "n_chars", "pii"]
    assert pii.digest(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("text", "kind"), [("IBAN: DE89 3704 0044 0532 0130 00 ok", "iban"), ("account no. 12345-67890", "account"), ("see https://u:p@example.com/x?y=1.", "url"), ("api_key: ABCDEFGHIJKLMNOP1234", "secret")])
def test_pii_cues(text, kind):
    assert [k for k, *_ in pii.spans(text, pii.anchors()) if k not in pii.BASE] == [kind]


@pytest.mark.parametrize("text", ["account 123", "accounting for 12345 67890", "account\n" * 3 + "number none", "token = short", "secretary: ABCDEFGHIJKLMNOP QRS", "http://nothing", "www.", "iban unknown"])
def test_pii_near_misses(text):
    assert [s for s in pii.spans(text, pii.anchors()) if s[0] not in ("card", "url")] == ([] if "secretary" not in text else [("secret", 11, 27)])


@pytest.mark.parametrize("text", ["account" + " " * 1_000_000, "account number" + "\t" * 1_000_000 + "x", "token" + " " * 1_000_000, "http://" * 100_000, "www." * 100_000, "a" * 1_000_000 + "@", "+1((((" * 100_000, "1." * 200_000, "@a" * 200_000, "token=" * 100_000])
def test_pii_of_any_shape_takes_linear_time(text):
    found, began = pii.anchors(), time.process_time()
    pii.spans(text, found)
    assert time.process_time() - began < 3


def test_pii_bad_iban_is_no_span():
    assert pii.spans("IBAN DE88 3704 0044 0532 0130 00", pii.anchors()) == []


# --- licences --------------------------------------------------------------------------------


def licence_places(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t))
    return len(w), [(s, lab) for p, lab in licenses.BASE for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]


def test_licences_equal_a_scan(spark):
    rnd = random.Random(2)
    parts = "gnu general public license apache mit cc by nc version 3 2 0 é ; - \n Apache LICENSE. word".split(" ")
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(400)] + ["CC BY-NC 4.0", "gnu general public", "license"]
    rows = licenses.scanned(docs(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])).collect()
    for r in rows:
        n, places = licence_places(texts[r.doc_id])
        starts = [s for s, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score < 1 and (r.score > 0) == bool(r.labels)
    assert len(licenses.scanned(docs(spark, ODD)).collect()) == len(ODD)


def test_licence_key_phrases():
    got = licenses.scan([b"Redistribution and use in source and binary forms", b"Redistribution and use in source and binary forms, provided that the following conditions are met:"], licenses.build())
    assert [g[5] for g in got] == ["", "bsd"]


def brute_coverage(template, words, rare):
    """The share of a text's words within the drift of their place, by trying every start that a rare word gives."""
    best = 0
    for k in rare:
        for start in (p - k for p, w in enumerate(words) if w == template[k]):
            best = max(best, sum(template[j] in words[max(0, start + j - licenses.DRIFT) : max(0, start + j + licenses.DRIFT + 1)] for j in range(len(template))))
    return best / len(template)


def test_whole_licences_with_changes():
    rnd, index = random.Random(6), licenses.build()
    from quern.llm.license_texts import TEXTS

    made = []
    for label, text, _ in TEXTS:
        words = text.split()
        for share in (0.0, 0.1, 0.3, 0.5):
            changed = [w if rnd.random() >= share else rnd.choice(("", "other", "two more")) for w in words]
            made.append((label, " ".join(["some code"] * rnd.randint(0, 40) + changed + ["tail"] * rnd.randint(0, 9))))
    got = licenses.scan([t.encode() for _, t in made], index)
    for (label, t), row in zip(made, got):
        words = licenses.fold_words(t)
        joined = b" " + b" ".join(words) + b" "
        want = {}
        for whole, (lab, _, keys) in zip(index.wholes, TEXTS):
            if all(b" " + k.encode() + b" " in joined for k in keys) and (c := brute_coverage(whole.words, words, whole.anchors)) >= licenses.COVERED:
                want[lab] = c
        phrases = set(licenses.scan([t.encode()], licenses.Index(index.number, index.templates, [], {}))[0][5].split(",")) - {""}
        assert set(row[5].split(",")) - {""} == phrases | want.keys()
        assert row[6] >= max(want.values(), default=0)
    clean = [row for k, row in enumerate(got) if k % 4 == 0]
    assert all(label in row[5].split(",") and row[6] == 1 for (label, _), row in zip(made[::4], clean))


# --- rules --------------------------------------------------------------------------------------


def measured(t):
    w = t.split()
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)]


def test_rules_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a ", "b ", "ç ", "X", "# ", "\n", "! "]) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["x y z\n" * 9, ""]
    rows = {r.doc_id: r for r in rule_ledger.judged(docs(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        m = measured(t)
        assert [rows[k][c] for c in rule_ledger.MEASURES[:5]] == m, t
        assert rows[k].base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0]) and not (rows[k].base_failed and rows[k].kept)
    assert rule_ledger.judged(docs(spark, ODD)).count() == len(ODD)


def test_few_distinct_words_at_every_length(spark):
    rnd = random.Random(5)
    junk = lambda n, v: " ".join(f"word{rnd.randrange(v)}" for _ in range(n))
    clean = lambda n, v=0: " ".join(f"word{k}" for k in range(n))
    made = [(junk, n, v) for n in (60, 4_999, 5_000, 5_001, 20_000) for v in (3, 50, 300) if n > 60 or v == 3] + [(clean, n, 0) for n in (60, 4_999, 5_000, 20_000)]
    # a vocabulary that grows slower than the text is no fault, a block of junk in a long text is
    made += [(lambda n, v: " ".join(f"word{rnd.randrange(v)}" for _ in range(n)), 60_000, 3_000), (lambda n, v: f"{clean(9_000)} {junk(12_000, v)} {clean(9_000)}", 30_000, 50)]
    rows = rule_ledger.judged(docs(spark, [(k, f(n, v), None, None, None) for k, (f, n, v) in enumerate(made)])).collect()
    got = {r.doc_id: bool(r.failures & rule_ledger.BIT["few_distinct_words"]) for r in rows}
    assert got == {k: 0 < v < 1_000 for k, (_, _, v) in enumerate(made)}
    assert not any(r.kept for r in rows if got[r.doc_id])


def test_ablation_and_versions(spark):
    led = spark.createDataFrame([(0,), (1,), (1 | 4,), (4,), (2 | 8,)], "failures long")
    got = {(r.policy, r.rule): (r.n_failed, r.n_only, r.n_rejected) for r in rule_ledger.ablation(led).collect()}
    assert got["v1", "few_words"] == (2, 2, 3) and got["v2", "few_words"] == (2, 1, 4) and got["v2", "digits"] == (0, 0, 4)
    assert [r.kept for r in rule_ledger.apply_policy(led, "v1").collect()] == [True, False, False, True, False]


# --- language ----------------------------------------------------------------------------------


def test_language_words_then_grams(spark):
    rows = [(k, t, lang, None, None) for k in range(60) for lang, t in (("en", "the cat and the dog thing"), ("fr", "le chat et la chienne eau"))]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    model = langid.train(docs(spark, [*rows, *ODD]))
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r for r in langid.predict(docs(spark, [(1, "THE dog", None, None, None), (2, "chiennes chats", None, None, None), (3, None, "en", None, None), (4, "12 !?", "en", None, None), (5, "x" * 50_000, "en", None, None)]), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["en", "fr", "und", "und"] and 0.5 < got[1].score <= 1 and got[3].score == 0
    assert {r.lang_pred for r in langid.predict(docs(spark, ODD), langid.train(docs(spark, []))).collect()} == {"und"}
    assert langid.identified(docs(spark, ODD)).count() == len(ODD)


def test_no_language_and_no_word_is_lost(spark):
    hot = " ".join(f"hot{chr(97 + k)}" for k in range(20))
    rows = [(k, hot, "aa", None, None) for k in range(30)] + [(100, "rare small words", "zz", None, None)] * 40
    model = langid.train(docs(spark, rows), per_lang=5)
    assert model.langs == ["aa", "zz"] and len(model.words.items) == 20 + 3
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] + letters[k // 26 % 26] + letters[k // 676] * 3
    many = [(2 * k + j, f"{word(k)} common", f"l{k:03}", None, None) for k in range(300) for j in range(2)]
    model = langid.train(docs(spark, many), per_lang=1)
    assert len(model.langs) == 300 and len(model.words.items) == 301
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs(spark, many), model).collect()}
    assert got == {i: lang for i, _, lang, _, _ in many}


@pytest.mark.parametrize("dense", [0, 20_000_000])
def test_language_model_equals_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(langid, "BROADCAST_LANGS", 1)
    monkeypatch.setattr(langid, "_DENSE", dense)
    rnd = random.Random(7)
    say = lambda abc: " ".join("".join(rnd.choice(abc) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 12)))
    rows = [(k, say(abc), lang, None, None) for k, (lang, abc) in enumerate([("en", "abcd"), ("fr", "bcdé"), ("de", "cdü")] * 40)]
    model = langid.train(docs(spark, rows), per_lang=25)
    counts = {}
    for lang in ("de", "en", "fr"):
        mine = sorted((xx(k), k, t) for k, t, x, _, _ in rows if x == lang)[:25]
        counts[lang] = Counter(w for _, _, t in mine for w in t.split())

    def vector(w):
        for order in (0, 4, 3, 2, 1):
            of = (lambda x: langid.pieces(x, order)) if order else (lambda x: [x])
            tables = [Counter() for _ in counts]
            for t, c in zip(tables, counts.values()):
                for x, n in c.items():
                    for p in of(x):
                        t[p] += min(n, 10) if order else n
            size = len(set().union(*tables))
            known = [p for p in of(w) if any(p in t for t in tables)]
            if known:
                return [sum(np.log((t[p] + 0.5) / (sum(t.values()) + 0.5 * size)) for p in known) / len(known) for t in tables]
        return [0.0] * len(counts)

    for w in ["abc", "zzz", *sorted({w for r in rows for w in r[1].split()})[:80]]:
        assert np.allclose(model.vectors([w])[0], vector(w), atol=1e-4), w


def xx(k):
    """Spark's xxhash64 of (k, 5) as its place from 0 to 1."""
    import struct

    import xxhash

    h = xxhash.xxh64_intdigest(struct.pack("<q", k), 42)
    return (xxhash.xxh64_intdigest(struct.pack("<i", 5), h) >> 11) / float(1 << 53)


def test_what_has_no_letter_has_no_language(spark):
    model = langid.train(docs(spark, [(1, "some words", "en", None, None)]))
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs(spark, [(1, "²½① 12", None, None, None), (2, "x²", None, None, None), (3, "ⅷ ½", None, None, None)]), model).collect()}
    assert got == {k: "en" if any(c.isalpha() for c in t) else "und" for k, t in ((1, "²½① 12"), (2, "x²"), (3, "ⅷ ½"))}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_language_of_held_out_texts(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    held = langid.identified(d).filter("held_out").join(d.select("doc_id", "lang", "text"), "doc_id").filter("lang is not null").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


# --- quality -----------------------------------------------------------------------------------


def test_trees_learn_and_flatten():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = gbt.fit(x[:600], y[:600], trees=80, depth=3)
    assert ((forest.probability(x[600:]) > 0.5) == y[600:]).mean() > 0.93

    def one(row):
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        return total

    assert np.allclose([one(r) for r in x[:50]], forest.margin(x[:50]))
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert gbt.fit(x, np.ones(800)).probability(x[:1])[0] > 0.99


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_quality_of_held_out_texts(spark):
    d, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = quality_model.classified(d, labels).filter("held_out").join(labels, "doc_id").collect()
    most = max(Counter(r.quality for r in held).values())
    right = sum(r.predicted == r.quality for r in held)
    assert len(held) > 50 and right >= 0.95 * len(held) and right > most


def test_quality_classifier(spark):
    good, bad = "plain words make up this sentence number {}.", "bad!! bad!! bad!! {} ### ***"
    rows = [(k, (good if k % 2 else bad).format(k) * 3, "en", "s", 1) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(None, 1, 0), (1, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_model.classified(docs(spark, rows + ODD), labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 10]
    assert held and all(r.predicted == r.doc_id % 2 for r in held)
    assert {r.score for r in quality_model.classified(docs(spark, ODD), labels.limit(0)).collect()} == {0.5}
    assert quality_model.classified(docs(spark, []), labels).count() == 0


# --- pages ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def page_model():
    return html_crf.train()


def test_pages_on_held_out_layouts(page_model):
    pages = html_crf.labelled_pages(150, seed=77)
    assert sum(html_crf.extract(p, page_model) == want for p, want in pages) >= 145


def test_page_by_hand(page_model):
    page = """<html><body><nav><a href=x>Menu</a></nav><header><a href="/">Site</a></header><article><h1>A&amp;B  title</h1>
      <p>One <b>two</b>&nbsp;three<br>four<script>var t="</p>";</script></p><div class="ad">Buy now</div><p>Second &lt;one&gt; is longer than the first one was.</article>
      <div class="comments"><p>I disagree with all of it</p></div><footer>&copy; x</footer>"""
    assert html_crf.extract(page, page_model) == "A&B title\n\nOne two three four\n\nSecond <one> is longer than the first one was."
    assert html_crf.extract("", page_model) == "" and html_crf.extract("<p", page_model) == ""


def test_nothing_of_an_article_is_dropped(page_model):
    page = """<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be, as <svg><text>drawn</text></svg> here.<script src=a/>var x = 1;</script> It's done</p>
      <p>An <object>object</object>, <noscript>a still</noscript> and <x-tag title=it's>its own tag</x-tag></p><ul><li>one<li>two</ul></article>"""
    assert html_crf.extract(page, page_model) == "Let x=2 be, as drawn here. It's done\n\nAn object, a still and its own tag\n\none\n\ntwo"


class Independent(__import__("html.parser").parser.HTMLParser):
    """Blocks of a page's article, by the library's parser: for pages whose article holds nothing else."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside, self.skip = [[]], False, False

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.skip = tag in ("script", "style")
        if tag == "br":
            self.blocks[-1].append(" ")
        elif tag not in ("b", "a", "em", "span"):
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.skip = False
        if tag not in ("b", "a", "em", "span"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1].append(data)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_pages_equal_an_independent_reader(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {}
    for r in pages.collect():
        reader = Independent()
        reader.feed(r.html)
        reader.close()
        blocks = (" ".join("".join(b).split()) for b in reader.blocks)
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in html_crf.extracted(pages).collect()}
    assert set(got) == set(want) and sum(got[k] != want[k] for k in want) <= 0.005 * len(want)


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<ul><li>" + "<div>" * 5_000 + "<li></li>" * 20_000, '<a x="' * 30_000, "<a x='" * 9_999 + '"', "<script " * 20_000, "<p>" + "word " * 400_000, "<li><ul>" * 5_000 + "</p>" * 20_000])
def test_pages_of_any_shape_take_linear_time(page_model, page):
    began = time.process_time()
    html_crf.extract(page, page_model)
    assert time.process_time() - began < 5


def test_messages_equal_enumeration(page_model):
    import itertools

    trees = [html_crf.parse(p)[0] for p in ("<body><div class=menu><p>a</p></div><article><p>some text here</p></article></body>", "<p>one<ul><li>two<li>three</ul>")]
    forest = html_crf.Forest(trees)
    score, pair, got = forest.x @ page_model.weights, page_model.pair, html_crf.marginals(trees, page_model)
    _, seen = html_crf.beliefs(forest, score, pair, edges=True)
    base, edges = 0, np.zeros((2, 2, 2))
    for nodes in trees:
        total, on, of = 0.0, np.zeros(len(nodes)), np.zeros((2, 2, 2))
        for y in itertools.product((0, 1), repeat=len(nodes)):
            kinds = [(int(n.tag in html_crf._STRUCTURAL), y[n.parent], y[i]) for i, n in enumerate(nodes) if i]
            w = np.exp(score[base : base + len(nodes)] @ np.array(y) + sum(pair[k] for k in kinds))
            total += w
            on += w * np.array(y)
            for k in kinds:
                of[k] += w
        assert np.allclose(on / total, got[base : base + len(nodes)], atol=1e-9)
        edges += of / total
        base += len(nodes)
    assert np.allclose(edges, seen, atol=1e-9)


def test_page_rows(spark, page_model):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some words of the text.</p></article>", "x"), (1, "u", "<article><p>Some words of the text.</p></article>", "x"), (2, None, None, None), (None, "u", "", None)], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_crf.extracted(pages, page_model).collect())
    assert got == [("1", "Some words of the text.", 23), ("1", "Some words of the text.", 23), ("2", "", 0), ("None", "", 0)]
    assert html_crf.extracted(pages.limit(0), page_model).count() == 0
