"""Benchmark decontamination: a BM25 index of the test items, queried by every passage.

The items are the indexed side, each training passage (a window of words) is a
query. Scores are divided by the item's score against itself, so one threshold
holds for all items. Retrieval is block-max WAND: a passage's posting lists are walked
by their current items, the pivot is the first item at which the lists' maxima together
reach the threshold, and it is scored only if the maxima of its block do as well. Before that
walk, all passages of a batch are held at once against the block maxima of their postings,
which leaves few to walk. What is retrieved is then verified by shares of five-word shingles:
an item's question and its answer have to stand in the passage both, though other words may keep
them apart; an item of one sentence has to stand there as a whole.

The items are a stated query set. An index holds at most about ``SHARD_WORDS`` words, so what is sent to
executors is bounded; more items are dealt out to several indexes by hash, each of which reads the
documents once more. Document frequencies, their number, mean length and the width of a passage are
those of all items, so scores don't depend on the shards. Documents are never shuffled.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import slices, texts, written

SHARD_WORDS = 2_000_000
THRESHOLD, OVERLAP, SHINGLE, BLOCK = 0.6, 0.8, 5, 8
#: Words that may stand between question and answer of the longest item so that one passage still holds both.
GAP = 16
K1, B = 1.2, 0.75
_CLOSE = 1e-9

#: Every byte that is not a letter, digit or part of a non-ASCII character becomes a blank.
_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def split_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANKED).split()


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """XXH64 values, sorted and distinct, of the runs of ``size`` words; fewer words are one run, no words none."""
    import xxhash

    h = xxhash.xxh64_intdigest
    runs = (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else ()
    return np.unique(np.fromiter((h(x) for x in runs), np.uint64))


def question_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what precedes it the question; one sentence: no answer."""
    parts = [x for x in re.split(r"(?<=[.?!])\s+", text.strip()) if x]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


@dataclass
class Part:
    """Words of an item or of its question or answer as shingles, of five words or of all if there are fewer."""

    size: int
    shingles: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Part:
        return cls(min(SHINGLE, len(words)), shingles(words))

    def share(self, passage: _Passage) -> float:
        """Share of the part's shingles that stand in a passage; 1 for a part without words."""
        if not self.size:
            return 1.0
        return float(np.isin(self.shingles, passage.shingles(self.size), assume_unique=True).mean())


class _Passage:
    """A passage's words, and its shingles of each size once they are asked for."""

    def __init__(self, words: list[bytes]):
        self.words, self.made = words, {}

    def shingles(self, size: int) -> np.ndarray:
        if size not in self.made:
            self.made[size] = shingles(self.words, size)
        return self.made[size]


@dataclass
class Statistics:
    """What BM25 needs of all items: their number and mean words, the longest one's words, and in how many each word stands."""

    n: int
    mean: float
    longest: int
    df: dict[bytes, int]

    @classmethod
    def of(cls, items: list[list[bytes]]) -> Statistics:
        sizes = [len(ws) for ws in items if ws]
        return cls(len(sizes), sum(sizes) / max(1, len(sizes)), max(sizes, default=1), Counter(w for ws in items for w in set(ws)))


@dataclass
class Index:
    ids: list
    parts: list  # for each item: the whole, the question, the answer
    terms: dict  # word -> term number
    start: array  # postings of each term: CSR over item and impact, a share of the item's score against itself
    item: array
    impact: array
    top: array  # largest impact of each term
    block_start: array  # and in each block of items: CSR
    block: array
    block_top: array
    heavy_start: np.ndarray  # the same of the postings that matter: CSR
    heavy: np.ndarray
    heavy_top: np.ndarray
    rest: np.ndarray  # for each block: most that all other postings can add
    width: int  # words of a passage
    threshold: float


def _by_block(term: np.ndarray, item: np.ndarray, impact: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CSR start, block, largest impact) of postings sorted by term and item."""
    cut = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)]) if len(term) else np.zeros(0, np.int64)
    return np.searchsorted(term[cut], np.arange(terms + 1)), item[cut] // BLOCK, np.maximum.reduceat(impact, cut) if len(cut) else impact


def build(items: list[tuple], threshold: float = THRESHOLD, statistics: Statistics | None = None) -> Index:
    """Index of (id, text) under the statistics of all items (default: these). Items without a word are left out."""
    split = [(i, t or "", split_words(t or "")) for i, t in items]
    split = [x for x in split if x[2]]
    s = statistics or Statistics.of([ws for _, _, ws in split])
    terms: dict[bytes, int] = {}
    term, item, impact, rest, heavy = [], [], [], np.zeros(-(-len(split) // BLOCK)), []
    for k, (_, _, ws) in enumerate(split):
        norm = K1 * (1 - B + B * len(ws) / s.mean)
        got = {w: np.log1p((s.n - s.df[w] + 0.5) / (s.df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in Counter(ws).items()}
        whole, outside = sum(got.values()), 0.0
        for w, v in sorted(got.items(), key=lambda x: (x[1], x[0])):
            v /= whole
            term.append(terms.setdefault(w, len(terms))), item.append(k), impact.append(v)
            light = outside + v < threshold / 2  # the lightest words of an item, under half of what it takes
            heavy.append(not light)
            outside += v if light else 0.0
        rest[k // BLOCK] = max(rest[k // BLOCK], outside)
    term, item, impact, heavy = np.array(term, np.int64), np.array(item, np.int64), np.array(impact, float), np.array(heavy, bool)
    order = np.lexsort((item, term))
    term, item, impact, heavy = term[order], item[order], impact[order], heavy[order]
    start = np.searchsorted(term, np.arange(len(terms) + 1))
    top = np.maximum.reduceat(impact, start[:-1]) if len(terms) else impact
    parts = [tuple(Part.of(x) for x in (ws, *map(split_words, question_answer(t)))) for _, t, ws in split]
    walked = [array("d" if x.dtype == float else "q", x.tolist()) for x in (start, item, impact, top, *_by_block(term, item, impact, len(terms)))]
    return Index([i for i, _, _ in split], parts, terms, *walked, *_by_block(term[heavy], item[heavy], impact[heavy], len(terms)), rest, 2 * (s.longest + GAP), threshold)


def promising(index: Index, docs: list[list[bytes]]) -> list[tuple[int, int]]:
    """(document, first word) of the passages that reach the threshold by block maxima. Passages overlap by half."""
    step = max(1, index.width // 2)
    get = index.terms.get
    term = np.fromiter((get(w, -1) for ws in docs for w in ws), np.int64)
    size = np.array([len(ws) for ws in docs], np.int64)
    doc = np.repeat(np.arange(len(docs)), size)
    pos = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)
    live = np.flatnonzero(term >= 0)
    live = live[index.heavy_start[term[live] + 1] > index.heavy_start[term[live]]]
    if not len(live):
        return []
    doc, pos, term = doc[live], pos[live] // step, term[live]
    # the passage that begins at step p holds words of steps p and p + 1; each term counts once
    most = int(pos.max()) + 2
    passage = np.concatenate([doc * most + pos + 1, doc * most + pos])
    both = np.unique(passage * len(index.terms) + np.tile(term, 2))
    passage, term = np.divmod(both, len(index.terms))
    n = index.heavy_start[term + 1] - index.heavy_start[term]
    at = np.repeat(index.heavy_start[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    keys, where = np.unique(np.repeat(passage, n) * len(index.rest) + index.heavy[at], return_inverse=True)
    bound = np.bincount(where, index.heavy_top[at], len(keys))
    passage, block = np.divmod(keys, len(index.rest))
    found = np.unique(passage[bound + index.rest[block] >= index.threshold - _CLOSE])
    return [(int(p // most), max(0, int(p % most - 1) * step)) for p in found]


def wand(index: Index, words: set[bytes]) -> list[tuple[int, float]]:
    """(item number, score) of all items that score at least the threshold with a passage of these words.

    Block-max WAND: lists are kept by the item they stand at. The pivot is the first item by which
    the maxima of the lists up to it reach the threshold; only if those of its block reach it too, it is
    scored or the lists before it are moved up to it. Otherwise all lists up to the pivot go to the end of
    the block, or to the next list's item if that comes first.
    """
    need, out = index.threshold - _CLOSE, []
    item, start, top, block_start, blocks, tops = index.item, index.start, index.top, index.block_start, index.block, index.block_top
    lists = [[item[start[t]], t, start[t]] for w in words if (t := index.terms.get(w)) is not None]

    while lists:
        lists.sort()
        total, pivot = 0.0, -1
        for k, (_, t, _) in enumerate(lists):
            total += top[t]
            if total >= need:
                pivot = k
                break
        if pivot < 0:
            return out
        at = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == at:
            pivot += 1
        block = at // BLOCK
        bound = 0.0
        for _, t, _ in lists[: pivot + 1]:
            x = bisect_left(blocks, block, block_start[t], block_start[t + 1])
            if x < block_start[t + 1] and blocks[x] == block:
                bound += tops[x]
        if bound < need:
            to = (block + 1) * BLOCK
            if pivot + 1 < len(lists):
                to = min(to, lists[pivot + 1][0])
        elif lists[0][0] == at:
            score = sum(index.impact[p] for _, _, p in lists[: pivot + 1])
            if score >= need:
                out.append((at, score))
            to = at + 1
        else:
            to = at
        for one in lists[: pivot + 1]:
            if one[0] < to:
                end = start[one[1] + 1]
                one[2] = bisect_left(item, to, one[2], end)
                one[0] = item[one[2]] if one[2] < end else -1
        lists = [one for one in lists if one[0] >= 0]
    return out


def matches(index: Index, docs: list[list[bytes]], overlap: float = OVERLAP) -> list[tuple]:
    """(document, item id, score, overlap, question overlap, answer overlap, first word), the best passage of each.

    An item matches if the passage holds ``overlap`` of its question's shingles and of its answer's, or of all of them where it has no answer.
    """
    best: dict[tuple[int, int], tuple] = {}
    for d, at in promising(index, docs):
        passage = _Passage(docs[d][at : at + index.width])
        for k, score in wand(index, set(passage.words)):
            whole, question, answer = (p.share(passage) for p in index.parts[k])
            verified = min(question, answer) if index.parts[k][2].size and index.parts[k][1].size else whole
            if verified >= overlap and ((d, k) not in best or best[d, k][:2] < (whole, score)):
                best[d, k] = (whole, score, question, answer, at)
    return [(d, index.ids[k], score, whole, q, a, at) for (d, k), (whole, score, q, a, at) in sorted(best.items())]


def indexes(benchmark: DataFrame, *, key: str, text: str, threshold: float, shard_words: int | None = None) -> Iterator[Index]:
    """Indexes of all items, each of about ``shard_words`` words at most, under the same statistics.

    Words are counted by Spark. Only the items of one shard and the frequencies of their words
    are at the driver at a time.
    """
    shard_words = shard_words or SHARD_WORDS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            words = [split_words(t) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))], names=["k", "t", "n", "w"])

    kind = benchmark.schema[key].dataType.simpleString()
    items = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(counted, f"k {kind}, t string, n long, w array<binary>").filter("n > 0")
    items = written(items, "test-items")
    total = items.agg(F.count("*").alias("n"), F.sum("n").alias("words"), F.max("n").alias("longest")).first()
    shards = max(1, -(-(total.words or 0) // shard_words))
    place = F.pmod(F.xxhash64("k", "t"), F.lit(shards)).alias("shard")
    words = items.select(place, F.explode("w").alias("w"))
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    df = written(words.distinct().join(df, "w"), "test-words") if shards > 1 else df.withColumn("shard", F.lit(0))
    for k in range(shards):
        rows = items.filter(place == k).select("k", "t").orderBy("k", "t").collect()
        found = df.filter(F.col("shard") == k).select("w", "df").toArrow()
        known = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
        yield build([(r.k, r.t) for r in rows], threshold, Statistics(total.n, (total.words or 0) / max(1, total.n), total.longest or 1, known))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_words: int | None = None) -> DataFrame:
    """A row for each pair of a document and a test item that it holds; documents are read whole, whatever their length.

    key, item id, score (BM25 over the item's self score), overlap, question_overlap,
    answer_overlap, first_word, of the passage with the largest overlap, then score, then the first. Null texts hold
    nothing; null keys and repeated rows are kept as they are, and repeated items count each; no items or no documents: no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    item = benchmark.schema[item_key].dataType.simpleString()
    names = [key, item_key, "score", "overlap", "question_overlap", "answer_overlap", "first_word"]
    schema = f"`{key}` {kind}, `{item_key}` {item}, score double, overlap double, question_overlap double, answer_overlap double, first_word long"
    out = None
    for index in indexes(benchmark, key=item_key, text=item_text, threshold=threshold, shard_words=shard_words):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 400):
                found = matches(index, [split_words(t) for t in texts(b.column(1))], overlap)
                at = pa.array([f[0] for f in found], pa.int64())
                columns = [b.column(0).take(at)] + [pa.array([f[k] for f in found]) for k in range(1, 7)]
                if found:
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        part = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def cleaned(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_words: int | None = None) -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns stay, null texts too. No shuffle."""
    at = docs.columns.index(text)
    for index in indexes(benchmark, key=item_key, text=item_text, threshold=threshold, shard_words=shard_words):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 400):
                bad = {f[0] for f in matches(index, [split_words(t) for t in texts(b.column(at))], overlap)}
                yield b.take(pa.array([i for i in range(b.num_rows) if i not in bad], pa.int64()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
