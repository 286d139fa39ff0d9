"""Language identification, words first.

A known word is scored by its log frequency in each language. An unseen word falls
back to its character n-grams, from four characters down to one: the longest order
of which a gram is known decides.

The only bound is on labelled rows: the model is learnt from at most ``PER_LANG`` of each
language, those of the smallest hashes; every word and gram of theirs is kept, and the number of
languages isn't bounded. A vector is kept as the languages that know the word, since
log((c + 1/2) / (total + V/2)) is a language's constant plus log(2c + 1). Scoring is one pass
without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, slices, texts

PER_LANG, ORDERS = 800, (4, 3, 2, 1)
#: Languages up to which the table of their cuts is broadcast; beyond, it is joined by shuffle.
BROADCAST_LANGS = 50_000
_WORD = re.compile(r"[^\W\d_]+")
#: Values that a worker's memo of word vectors holds at most.
_MEMO = 4_000_000


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters. Numerals that aren't digits, such as superscripts, are no letters."""
    found = _WORD.findall(text.lower())
    if text.isascii():
        return found
    return [w if w.isalpha() else x for w in found if w.isalpha() or (x := "".join(c for c in w if c.isalpha()))]


def pieces(word: str, order: int) -> list[str]:
    padded = f"^{word}$" if order > 1 else word
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


#: Values up to which a table is also kept as a full matrix, which is quicker; results are the same.
_DENSE = 20_000_000


class Table:
    """Counts by language of words or grams: for each language a constant, for each item the languages that know it."""

    def __init__(self, counts: list[Counter]):
        items = {w: k for k, w in enumerate(sorted(set().union(*counts)))} if counts else {}
        total = np.array([sum(c.values()) for c in counts], float)
        self.constant = -np.log(2 * total + max(1, len(items))).astype(np.float32)
        at = np.concatenate([np.fromiter(map(items.__getitem__, c), np.int64, len(c)) for c in counts] or [np.zeros(0, np.int64)])
        lang = np.repeat(np.arange(len(counts), dtype=np.int32), [len(c) for c in counts])
        gain = np.concatenate([np.log(2 * np.fromiter(c.values(), float, len(c)) + 1) for c in counts] or [np.zeros(0)]).astype(np.float32)
        order = np.argsort(at, kind="stable")
        self.items, self.lang, self.gain = items, lang[order], gain[order]
        self.start = np.searchsorted(at[order], np.arange(len(items) + 1))
        self.full = None
        if len(items) * len(counts) <= _DENSE:
            self.full = np.zeros((len(items), len(counts)), np.float32)
            self.full[at[order], self.lang] = self.gain

    def means(self, known: list[int], sizes: list[int]) -> np.ndarray:
        """A vector for each run of ``sizes`` items among ``known`` (item numbers): the mean of the run."""
        cuts = np.cumsum([0, *sizes])[:-1]
        if self.full is not None:
            total = np.add.reduceat(self.full[known], cuts, axis=0)
        else:
            begin, n = self.start[known], self.start[np.array(known) + 1] - self.start[known]
            at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            total = np.zeros((len(sizes), len(self.constant)), np.float32)
            np.add.at(total, (np.repeat(np.repeat(np.arange(len(sizes)), sizes), n), self.lang[at]), self.gain[at])
        return total / np.array(sizes, np.float32)[:, None] + self.constant


class Model:
    """Languages, and the tables of words and of grams of each order."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        self.words = Table([counts[name] for name in self.langs])
        grams = []
        for order in ORDERS:
            by = []
            for name in self.langs:
                of: dict[str, int] = defaultdict(int)
                for w, c in counts[name].items():
                    n = min(c, 10)
                    for x in pieces(w, order):
                        of[x] += n
                by.append(Counter(of))
            grams.append(Table(by))
        self.grams = grams

    def vectors(self, words: list[str]) -> np.ndarray:
        """Log frequency of each word in each language; of an unknown word the mean of its known grams, of the longest order that has any."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        items = self.words.items
        known = [k for k, w in enumerate(words) if w in items]
        if known:
            out[known] = self.words.means([items[words[k]] for k in known], [1] * len(known))
        left = [k for k, w in enumerate(words) if w not in items]
        for table, order in zip(self.grams, ORDERS):
            flat, sizes, done, rest, get = [], [], [], [], table.items.get
            for k in left:
                found = [x for x in map(get, pieces(words[k], order)) if x is not None]
                if found:
                    flat += found
                    sizes.append(len(found)), done.append(k)
                else:
                    rest.append(k)
            if done:
                out[done] = table.means(flat, sizes)
            left = rest
        return out


def sampled(docs: DataFrame, *, learn_from: Column | None, text: str, lang: str, key: str, per_lang: int) -> DataFrame:
    """(l, t): at most ``per_lang`` texts of each language, of the keys with the smallest hashes.

    Counts by language give a hash below which about twice as many stand, so what is ranked of a
    language doesn't grow with it; rows of one key, language and hash of the text count once.
    """
    good = F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()
    rows = docs.filter(good if learn_from is None else good & learn_from).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    # the place of a key: uniform in 0 to 1
    place = F.shiftrightunsigned(F.xxhash64(F.col("k"), F.lit(5)), 11) / F.lit(float(1 << 53))
    narrow = rows.select("k", "l", place.alias("u"))
    counted = narrow.groupBy("l").agg((F.lit(2.0 * per_lang + 64) / F.count("*")).alias("share"))
    few = counted.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    small = F.broadcast if few else (lambda df: df)
    near = narrow.join(small(counted), "l").filter(F.col("u") < F.col("share")).select("l", "u", "k").distinct()
    nth = F.row_number().over(Window.partitionBy("l").orderBy("u", "k"))
    cuts = near.withColumn("n", nth).filter(F.col("n") <= per_lang).groupBy("l").agg(F.max(F.struct("u", "k")).alias("cut"))
    kept = rows.withColumn("u", place).join(small(cuts), "l").filter((F.col("u") < F.col("cut.u")) | ((F.col("u") == F.col("cut.u")) & (F.col("k") <= F.col("cut.k"))))
    return kept.groupBy("l", "k").agg(F.min("t").alias("t")).select("l", "t")


def train(docs: DataFrame, *, learn_from: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG) -> Model:
    """Learn from rows whose text, language and key aren't null and that meet ``learn_from``. No rows: no languages.

    ``per_lang`` bounds the rows of each language; neither their words nor the languages are bounded.
    Of rows with one key and language the smallest text counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = defaultdict(Counter)
        for b in slices(batches, 500):
            for name, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                by[name].update(words_of(t))
        flat = [(name, w, c) for name, counter in by.items() for w, c in (counter or {"": 0}).items()]
        for at in range(0, len(flat), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat[at : at + 50_000])], names=["l", "w", "c"])

    sample = sampled(docs, learn_from=learn_from, text=text, lang=lang, key=key, per_lang=per_lang)
    found = sample.mapInArrow(count, "l string, w string, c long").groupBy("l", "w").agg(F.sum("c").alias("c")).toArrow()
    by: dict[str, Counter] = defaultdict(Counter)
    for name, w, c in zip(*(found.column(x).to_pylist() for x in ("l", "w", "c"))):
        if w:
            by[name][w] = c
    return Model(by)


class _Memo(dict):
    """Row numbers of words in a growing table of vectors; row 0 is for what has no letter."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table, self.used = model, np.zeros((1024, len(model.langs)), np.float32), 1

    def learn(self, words: set[str]) -> None:
        """Rows for the words that have none yet."""
        if len(self) * max(4, len(self.model.langs)) > _MEMO:
            self.clear()
            self.used = 1
        new = [w for w in words if w not in self]
        letters = {w: w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in new}
        real = [w for w in new if letters[w]]
        while self.used + len(real) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[self.used : self.used + len(real)] = self.model.vectors([letters[w] for w in real])
        self.update(dict.fromkeys(new, 0))
        self.update(zip(real, range(self.used, self.used + len(real))))
        self.used += len(real)


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score for each row; null keys and repeated rows stay, other columns go.

    ``und`` and 0 where the text is null or has no letter, or nothing was learnt. Of languages that
    score alike the first by name is taken. A text of any length is read whole.
    The score is the language's share after a softmax over the mean log frequency times the words, at most 30.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(model)
        for b in slices(batches, 500, 4 << 20):
            names, scores = [], []
            found = [_WORD.findall(t.lower()) for t in texts(b.column(1))]
            memo.learn(set().union(*found))
            for words in found:
                places = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                n = int(np.count_nonzero(places))
                if not n or not model.langs:
                    names.append("und"), scores.append(0.0)
                    continue
                z = sum(memo.table[places[at : at + 50_000]].sum(0, dtype=np.float64) for at in range(0, len(places), 50_000)) / n * min(n, 30)
                z = np.exp(z - z.max())
                k = int(z.argmax())
                names.append(model.langs[k]), scores.append(float(z[k] / z.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; learnt from the rows that aren't held out."""
    model = train(docs, learn_from=crc_mod("doc_id", 4) != 2)
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
