"""Operators over the whole corpus against brute force: near-duplicates, scores, mixing, leaks, the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quern.llm import decontam, katz, katz_tables, mixing, near_text, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}" for k in range(20_000))
ODD = [(1, "a plain text of a few words", "en", "s", 27), (1, "a plain text of a few words", "en", "s", 27), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "null id here", "en", None, 7), (None, None, None, None, None), (4, LONG, "en", "t", len(LONG))]


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed, n, words=60, longest=40):
    """Made-up documents with exact and near copies."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(words)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.4:
            w = rnd.choice(texts).split()
            for _ in range(rnd.choice((0, 0, 1, 2))):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(rnd.choice((" ", "\n")).join(w))
        else:
            texts.append(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, longest))))
    return [(k, t, rnd.choice(("en", "fr")), rnd.choice(("s0", "s0", "s1", "s2", None)), len(t)) for k, t in enumerate(texts)]


# --- near-duplicates ---------------------------------------------------------------------------


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps):
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    root = list(range(len(x)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(x))]


def test_fingerprints_and_components(spark):
    rows = corpus(1, 250, longest=120)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.clustered(docs(spark, rows)).collect()}
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps)
    assert got == {k: (fps[k], roots[k]) for k in range(len(rows))}
    assert len(set(roots)) < len(set(fps)) < len(rows)


def balls(rnd, n, centres=3):
    xs = set()
    mids = [rnd.getrandbits(64) for _ in range(centres)]
    while len(xs) < n:
        x = rnd.choice(mids) if rnd.random() < 0.7 else rnd.getrandbits(64)
        for _ in range(rnd.randint(0, 6)):
            x ^= 1 << rnd.randrange(64)
        xs.add(x)
    return sorted(xs)


@pytest.mark.parametrize("n", [1, 2, 40, 70, 300, 1500])
def test_gray_index_equals_all_pairs(n):
    x = np.array(balls(random.Random(n), n), np.uint64)
    x = x[np.argsort(simhash.gray_rank(x))]
    assert simhash.gray_groups(x).tolist() == brute_components(x)


def test_gray_rank_is_the_sequence():
    rank = np.arange(64, dtype=np.uint64)
    assert (simhash.gray_rank(rank ^ (rank >> np.uint64(1))) == rank).all()


@pytest.mark.parametrize("route_rows", [50_000, 20, 3])
def test_hot_routes_are_dealt_out_again(spark, route_rows):
    x = balls(random.Random(9), 200, centres=2)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in x], "fp long")
    root = {r.v: r.root for r in simhash.components(simhash.links(df, route_rows=route_rows)).collect()}
    groups = defaultdict(set)
    for v in x:
        s = int(np.uint64(v).astype(np.int64))
        groups[root.get(s, s)].add(v)
    want = defaultdict(set)
    for v, r in zip(x, brute_components(x)):
        want[r].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.v: r.root for r in simhash.components(e).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_near_duplicates_odd_rows(spark):
    got = simhash.clustered(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fp == 0} == {2}
    kept = simhash.deduplicated(docs(spark, ODD)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "4", "None"] and len(kept[0]) == 5
    assert simhash.clustered(docs(spark, [])).count() == 0 and simhash.deduplicated(docs(spark, [])).count() == 0
    clash = docs(spark, ODD).withColumnRenamed("lang", "near_row").withColumnRenamed("source", "root")
    assert simhash.deduplicated(clash).columns == ["doc_id", "text", "near_row", "root", "n_chars"]


# --- language-model scores ----------------------------------------------------------------------


def brute_scores(rows, order=2):
    toks = [(k, (t or "").encode().lower().split() + ["</s>"]) for k, t, *_ in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in toks]
    grams = lambda t, k: list(zip(*(([*["<s>"] * (k - 1), *t])[i:] for i in range(k))))
    c = {k: Counter(g for (_, t), h in zip(toks, held) if not h for g in grams(t, k)) for k in range(1, order + 1)}
    c1 = Counter({g[0]: n for g, n in c[1].items()})
    n, v = sum(c1.values()), len(c1)
    d = {k: katz.discounts([0] + [sum(x == r for x in c[k].values()) for r in range(1, 7)]) for k in c}
    left = sum((1 - d[1][min(x, 6)]) * x for x in c1.values())
    scale = 1.0 if left >= 0.5 else n / (n + 0.5) if n else 1.0
    seen = {w: scale * d[1][min(x, 6)] * x / n for w, x in c1.items()}
    unknown = 1 - sum(seen.values())
    ctx, kept, mass = Counter(), Counter(), Counter()

    def p(*g):
        if len(g) == 1:
            return seen.get(g[0], unknown)
        a = g[:-1]
        if c[len(g)][g]:
            return d[len(g)][min(c[len(g)][g], 6)] * c[len(g)][g] / (ctx[a] + 0.5)
        return (ctx[a] - kept[a] + 0.5) / (ctx[a] + 0.5) / (1 - mass[a]) * p(*g[1:]) if ctx[a] else p(*g[1:])

    for k in range(2, order + 1):
        for g, x in c[k].items():
            ctx[g[:-1]] += x
            kept[g[:-1]] += d[k][min(x, 6)] * x
            mass[g[:-1]] += p(*g[1:])
    out = []
    for (k, t), h in zip(toks, held):
        base = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((k, h, len(t), sum(c1[w] > 0 for w in t), n, base, sum(math.log10(p(*g)) for g in grams(t, order))))
    return out, p, [*c1, "no such word"], list(ctx)


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, round(r[5], 5), r[2])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-6)


@pytest.mark.parametrize(("seed", "words"), [(1, 20), (2, 300)])
def test_scores_equal_brute_force(spark, monkeypatch, seed, words):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 700)
    rows = corpus(seed, 200, words=words) + ODD
    want, p, vocabulary, contexts = brute_scores(rows)
    same(katz.scored(docs(spark, rows)).collect(), want)
    for a in contexts[:40]:
        assert sum(p(*a, b) for b in vocabulary) == pytest.approx(1)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stored_tables_equal_brute_force(spark, order):
    rows = corpus(12, 120, words=25) + ODD
    want, p, vocabulary, contexts = brute_scores(rows, order)
    same(katz_tables.scored(docs(spark, rows), order=order).collect(), want)
    for a in contexts[:20]:
        assert sum(p(*a, b) for b in vocabulary) == pytest.approx(1)
    assert katz_tables.scored(docs(spark, []), order=order).count() == 0


def test_hot_tokens_only_move_work(spark, monkeypatch):
    rows = corpus(4, 150, words=8)
    want = brute_scores(rows)[0]
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 200)
    words = sorted({w for r in rows for w in r[1].encode().split()})[:4]
    pairs = [(v, w) for v in (katz._START, *words) for w in (*words[:2], katz._END)]
    ids = katz.pair_id(katz.hashes([w for _, w in pairs]), katz.hashes([v for v, _ in pairs]) & katz._LOW48)
    hot = katz.Hot(np.sort(katz.hashes([katz._END, *words])), np.sort(ids))
    monkeypatch.setattr(katz, "placement", lambda *a: (hot, 7))
    same(katz.scored(docs(spark, rows)).collect(), want)


def test_placement_finds_what_is_frequent(spark, monkeypatch):
    monkeypatch.setattr(katz, "HOT_SAMPLE", 0.999)
    monkeypatch.setattr(katz, "PART_TOKENS", 100)
    rows = [(k, f"x{k} very often y{k}", "en", "s", 1) for k in range(400)]
    hot, parts = katz.placement(docs(spark, rows), "text", None)
    assert parts >= 19 and set(katz.hashes([b"very", b"often", katz._END])) <= set(hot.tokens)
    assert katz.pair_id(katz.hashes([b"often"]), katz.hashes([b"very"]) & katz._LOW48)[0] in hot.pairs


def test_scores_without_training_rows(spark):
    from pyspark.sql import functions as F

    got = katz.scored(docs(spark, ODD), held_out=F.lit(True)).collect()
    assert len(got) == len(ODD) and all(r.base_score == pytest.approx(0) and r.score == pytest.approx(0) and r.n_known == 0 for r in got)
    assert katz.scored(docs(spark, [])).count() == 0


def test_discounts():
    d = katz.discounts([0, 100, 40, 20, 12, 8, 5])
    assert all(0 < x < 1 for x in d[1:6]) and d[6] == 1
    assert katz.discounts([0] * 7)[1] == 0.5


# --- mixing -------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Shares by weight, the excess over three times a size given to the others again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**target, **share}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    rows = corpus(seed, 300) + ODD
    got = mixing.mixed(docs(spark, rows)).collect()
    again = mixing.mixed(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    want = brute_targets(size)
    total, most = sum(size.values()), max(r.size for r in got)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(size[s], round(t, 6)) for s, t in want.items()})
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    assert total - most <= sum(r.taken for r in got) <= total
    taken, target = Counter(), {}
    for r in got:
        taken[r.target] += r.taken
        target[r.target] = r.target
    assert all(abs(taken[t] - t) <= 2 * most for t in target if t)


def test_mixture_keeps_rows_and_columns(spark):
    rows = corpus(5, 120) + ODD
    df = docs(spark, rows).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "mix_row")
    out = mixing.mixture(df)
    assert out.columns == ["doc_id", "text", "size", "source", "mix_row", "mix_copies"]
    taken = sum(r.taken for r in mixing.mixed(df).collect())
    assert sum(len(r.text.split()) * r.mix_copies for r in out.collect()) == taken
    assert mixing.mixture(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [(1, None, None, None, None)])).first().taken == 0


# --- leaks ----------------------------------------------------------------------------------------


def runs(words, n):
    return {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}


def brute_leaks(rows, items):
    """Question and answer each to 0.8 of their shingles somewhere in the text; an item of one sentence as a whole."""
    out = set()
    for k, t, *_ in rows:
        have = decontam.split_words(t or "")
        for i, item in items:
            parts = [decontam.split_words(x) for x in decontam.question_answer(item)]
            parts = parts if all(parts) else [decontam.split_words(item)]
            shares = [len(runs(p, n) & runs(have, n)) / len(runs(p, n)) for p in parts if (n := min(5, len(p)))]
            if shares and min(shares) >= 0.8:
                out.add((k, i))
    return out


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, f"{say(rnd.randint(8, 40))}. {say(rnd.randint(2, 9)).capitalize()}.") for i in range(30)]
    rows = []
    for k in range(200):
        t = say(rnd.randint(0, 300))
        if k % 3 == 0:
            item = rnd.choice(items)[1]
            item = item.upper() if k % 2 else item.replace(" ", "### ") if k % 5 == 0 else item
            t = f"{t} {item} {say(50)}"
        rows.append((k, t, "en", "s", 1))
    bench = spark.createDataFrame([*items, (99, None), (98, " ")], "item_id long, text string")
    got = decontam.contaminated(docs(spark, rows + ODD), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(rows, items) and len(got) >= 66
    assert all(r.score >= 0.6 and min(r.question_overlap, r.answer_overlap) >= 0.8 for r in got)
    kept = decontam.cleaned(docs(spark, rows + ODD), bench)
    assert kept.count() == len(rows) + len(ODD) - len({r.doc_id for r in got}) and kept.columns == docs(spark, []).columns
    assert decontam.contaminated(docs(spark, rows), bench.limit(0)).count() == 0 and decontam.cleaned(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_leaks_with_words_between_question_and_answer(spark):
    rnd = random.Random(12)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    parts = [(say(9) + "?", say(3).capitalize() + "."), (say(8) + "?", say(9).capitalize() + "."), (say(30) + "?", say(10).capitalize() + ".")]
    items = [*((k, f"{q} {a}") for k, (q, a) in enumerate(parts)), (9, say(10))]
    rows = []
    for k in range(60):
        q, a = parts[k % 3]
        between = ("Answer:", say(4), say(decontam.GAP))[k // 3 % 3]
        rows.append((k, f"{say(k * 7)} {q} {between} {a} {say(30)}", "en", "s", 1))
    rows += [(100 + k, f"{say(20)} {q} {say(20)}", "en", "s", 1) for k, (q, _) in enumerate(parts)]
    rows += [(110 + k, f"{say(20)} {a} {say(20)}", "en", "s", 1) for k, (_, a) in enumerate(parts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k % 3) for k in range(60)} | brute_leaks(rows[60:], items)
    assert any(r.overlap < 0.8 and r.question_overlap == r.answer_overlap == 1 for r in got)
    assert not {r.doc_id for r in decontam.cleaned(docs(spark, rows), bench).collect()} & set(range(60))


def brute_bm25(items, words):
    """Scores of the items with a passage, over each item's score with itself."""
    split = [decontam.split_words(t) for _, t in items]
    n, mean = len(split), sum(map(len, split)) / len(split)
    df = Counter(w for ws in split for w in set(ws))
    out = []
    for ws in split:
        of = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, c in Counter(ws).items()}
        out.append(sum(v for w, v in of.items() if w in words) / sum(of.values()))
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.6])
def test_wand_equals_brute_force(threshold):
    """Every passage with an item that reaches the threshold is walked, and the walk finds all its items."""
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(80)]
    items = [(i, " ".join(rnd.choice(vocab[: rnd.choice((20, 80))]) for _ in range(rnd.randint(1, 20)))) for i in range(60)]
    index = decontam.build(items, threshold)
    texts = [[rnd.choice(vocab).encode() for _ in range(rnd.randint(0, 120))] for _ in range(60)]
    found, step, n = set(decontam.promising(index, texts)), index.width // 2, 0
    for d, ws in enumerate(texts):
        for at in range(0, max(1, len(ws)), step):
            words = set(ws[at : at + index.width])
            want = {k: v for k, v in enumerate(brute_bm25(items, words)) if v >= threshold}
            got = dict(decontam.wand(index, words))
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
            assert (d, at) in found or not want
            n += len(want)
    assert n > 20


@pytest.mark.parametrize("shard_words", [100, 250])
def test_shards_change_nothing(spark, shard_words):
    rnd = random.Random(18)
    vocab = [f"w{k}" for k in range(150)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, f"{say(rnd.randint(5, 25))}? {say(rnd.randint(1, 8)).capitalize()}." if i % 4 else say(rnd.randint(1, 9))) for i in range(40)]
    rows = [(k, f"{say(40)} {rnd.choice(items)[1]} {say(30)}", "en", "s", 1) for k in range(80)]
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    plain = lambda df: sorted((r.doc_id, r.item_id, r.first_word, *(round(r[k], 9) for k in ("score", "overlap", "question_overlap", "answer_overlap"))) for r in df.collect())
    whole = plain(decontam.contaminated(docs(spark, rows), bench))
    assert plain(decontam.contaminated(docs(spark, rows), bench, shard_words=shard_words)) == whole and len(whole) >= 80
    assert {r.doc_id for r in decontam.cleaned(docs(spark, rows), bench, shard_words=shard_words).collect()} == {r[0] for r in rows} - {w[0] for w in whole}


# --- near texts ----------------------------------------------------------------------------------


def brute_near(texts, similar=0.8):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similar * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r == max(x, y) else r for r in root]
    return root


def test_near_texts_equal_brute_force(spark):
    rows = corpus(21, 250, longest=150)
    roots = brute_near([r[1] for r in rows])
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()}
    assert got == set(roots) and len(got) < len(rows)
    apart = [simhash.fingerprints([r[1].encode()])[0] for r in rows]
    assert any(k != r and np.bitwise_count(apart[k] ^ apart[r]) > 4 for k, r in enumerate(roots))


def brute_set_fingerprint(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(x, 42) for x in {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def joined(n, pairs):
    root = list(range(n))
    for x, y in pairs:
        x, y = root[x], root[y]
        root = [min(x, y) if r == max(x, y) else r for r in root]
    return root


@pytest.mark.parametrize("near, route_rows", [(4, 50_000), (7, 50_000), (7, 40)])
def test_direct_links_are_near_and_span(spark, near, route_rows):
    rnd, x = random.Random(near), []
    for k in range(700):
        fp = rnd.choice(x) if k % 4 else rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 9) if k % 4 else 0):
            fp ^= 1 << rnd.randrange(64)
        x.append(fp)
    x = np.unique(np.array(x, np.uint64))
    place = {int(v): k for k, v in enumerate(x.view(np.int64))}
    table = spark.createDataFrame([(v,) for v in place], "fp long")
    found = [(place[r.a], place[r.b]) for r in simhash.links(table, near=near, route_rows=route_rows, direct=True).collect()]
    bits = np.bitwise_count(x[:, None] ^ x[None, :])
    assert found and all(bits[a, b] <= near for a, b in found)
    assert joined(len(x), found) == joined(len(x), np.argwhere(bits <= near).tolist())


def test_near_dedup_searches_fingerprints_in_gray_order(spark, monkeypatch):
    """The stage's candidates are the operator's links of fingerprints; what is similar but further apart is found too."""
    rows = corpus(23, 200, longest=150)
    searched, search = [], simhash.links
    monkeypatch.setattr(near_text, "links", lambda distinct, **how: searched.append((how["near"], {r.fp for r in distinct.collect()})) or search(distinct, **how))
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), "").collect()}
    want = {r[0]: np.uint64(brute_set_fingerprint(r[1])) for r in rows if r[1].split()}
    assert searched == [(corpus_pipeline.NEAR, {int(x.astype(np.int64)) for x in want.values()})]
    roots = brute_near([r[1] for r in rows])
    assert got == set(roots)
    apart = [np.bitwise_count(want[k] ^ want[r]) for k, r in enumerate(roots) if k != r and k in want]
    assert min(apart) <= corpus_pipeline.NEAR < max(apart)


@pytest.mark.parametrize("chunk", [1, 64])
def test_units_are_searched_by_fingerprints(chunk):
    """The index of a unit finds all that is similar, and nothing beyond its radius."""
    rnd = random.Random(43)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(120):
        w = base[:] if k % 3 else [f"w{rnd.randrange(5_000)}" for _ in range(200)]
        for _ in range(rnd.randint(1, 8)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10_000)}"
        texts.append(" ".join(w))
    parts = [near_text.shingle_set(t.encode()) for t in texts]
    fps, n = near_text.set_fingerprints(parts), len(texts)
    assert [int(x) for x in fps] == [brute_set_fingerprint(t) for t in texts]
    signs, keys = np.stack([near_text.signature(p) for p in parts]), np.zeros((n, near_text.BANDS), np.int64)
    for side in (np.zeros(n, np.int64), np.arange(n) % 2):
        likes = [(i, j) for i in range(n) for j in range(i) if (side[i] != side[j] or not side.any()) and near_text.similarity(parts[i], parts[j]) >= 0.8]
        for wide in (near_text.WIDE, 6):
            got = near_text.unit_links(0, side, np.arange(n), fps, signs, keys, parts, agree=0, wide=wide, chunk=chunk)
            assert joined(n, got) == joined(n, [(i, j) for i, j in likes if np.bitwise_count(fps[i] ^ fps[j]) <= wide])
            assert 0 < len(got) < n


def test_many_copies_of_one_text_are_few_links(spark):
    """Copies changed apart from each other, of which most are similar to the original only, and some to another copy only."""
    rnd = random.Random(41)
    base = [f"w{k}" for k in range(120)]
    rows = [" ".join(base)]
    for k in range(400):
        w = base[:]
        for _ in range(rnd.randint(1, 5)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10_000)}"
        rows.append(" ".join(w))
    rnd.shuffle(rows)
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(rows)]
    assert {r.doc_id for r in near_text.deduplicated(docs(spark, rows)).collect()} == set(brute_near([r[1] for r in rows]))


@pytest.mark.parametrize("block", [2, 5])
def test_crowded_buckets_equal_brute_force(spark, monkeypatch, block):
    """Texts that share a long passage meet in buckets of many components; blocks of a few members change nothing."""
    rnd = random.Random(31)
    say = lambda n: " ".join(f"w{rnd.randrange(5_000)}" for _ in range(n))
    shared, rows = say(60), []
    for _ in range(50):
        t = f"{shared} {say(rnd.choice((8, 15, 40)))}".split()
        rows.append(" ".join(t))
        for _ in range(rnd.randint(0, 4)):
            w = t[:]
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(rows)]
    calls = []
    left_over = near_text._left_over
    monkeypatch.setattr(near_text, "_left_over", lambda spread, *how: calls.append(spread.count()) or left_over(spread, *how))
    got = {r.doc_id for r in near_text.deduplicated(docs(spark, rows), block=block).collect()}
    assert got == set(brute_near([r[1] for r in rows])) and 1 < len(got) < len(rows) and calls[0] > 20


def test_near_texts_odd_rows(spark):
    stage = lambda df: corpus_pipeline.near_dedup(spark, df, "")
    assert sorted(str(r.doc_id) for r in stage(docs(spark, ODD)).collect()) == ["1", "2", "4", "None"]
    assert stage(docs(spark, [])).count() == 0
    clash = docs(spark, ODD).withColumnRenamed("lang", "near_row").withColumnRenamed("source", "root")
    assert stage(clash).columns == ["doc_id", "text", "near_row", "root", "n_chars"]


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice(("alpha", "beta", "gamma", "delta", "eps", "zeta")) + str(rnd.randint(0, 50)) for _ in range(n))
    good = [(k, say(60), "en", f"s{k % 3}", 1) for k in range(60)]
    junk = [(100 + k, "!! ### ".join(say(40).split()), "en", "s0", 1) for k in range(40)]
    item = "what is the leaked question of this test. It is the answer here."
    rows = [*good, *junk, (200, good[0][1], "en", "s1", 1), (201, f"{say(30)} {item} {say(30)}", "en", "s1", 1), (202, f"{say(40)} mail me@example.com now", "en", "s2", 1)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in good + junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids.append({r.doc_id for r in now.collect()})
    clean = {r[0] for r in good}
    assert ids[0] == clean | {200, 201, 202} and ids[1] == ids[0] - {200} and ids[2] == ids[1] - {201} and ids[3] == ids[2]
    assert "[EMAIL]" in now.filter("doc_id = 202").first().text
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert mixed and {r.doc_id for r in mixed} <= ids[3] and all(1 <= r.mix_copies <= 3 for r in mixed)
    assert len(corpus_pipeline.STAGES) == 5
