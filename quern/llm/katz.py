"""Katz backoff scores: Good-Turing discounted bigrams over discounted unigrams.

P(w | v) is d(c) c(v, w) / (c(v) + 1/2) for a bigram seen in training, else
alpha(v) P(w); P(w) is d(c) c(w) / N for a known token, and what the discounts leave
goes to one class of unknown tokens. alpha(v) divides what v's seen bigrams leave (half a
count at least, hence the 1/2) by the unigram mass of tokens not seen after v, so that each
context sums to one exactly.

The tables are partitioned by token hash, and the corpus meets them in three exchanges of a
few large binary rows:

* A chunk of documents numbers its words, and sends each distinct bigram once, with the
  documents that hold it, to the partition of its second token. There counts, the
  counts of counts and P(w) are at hand, and for a seen bigram all but c(v); but c(v) is
  at hand where v itself is the second token, so its share is added there.
* A bigram unseen in training needs alpha(v): first tokens' sums and these few requests
  meet in the partition of the first token.
* Sums come back by chunk.

Tokens are told apart by 64 bits of XXH64 (48 bits as first token). Very frequent tokens and bigrams,
found in a sample that only decides on placement, are spread over all partitions: a token's bigrams by first token, a
bigram's occurrences by chunk, its partial counts meeting in the one row of totals. The sample also gives the
number of partitions, so that each holds about ``PART_TOKENS`` tokens whatever the input.

``katz_tables`` has the same model of any order over stored tables.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, raw_texts, slices, written

CHUNK_TOKENS, CHUNK_DOCS = 1_500_000, 60_000
TOP = 5  # counts above are not discounted
HOT_SHARE, HOT_SAMPLE = 0.25, 0.01
PART_TOKENS = 2_600_000
_END, _START = b"\n</s>", b"\n<s>"
_LOW48 = np.uint64((1 << 48) - 1)
PAIRS, DOCS, SUMS, FIRST, FIX = range(5)
_ROW = "dest long, chunk long, kind int, blob binary"


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(blob, np.int64, n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    dest, chunk, kind, blob = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int64()), pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["dest", "chunk", "kind", "blob"])


def _in_parts(rows: list[tuple], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size >= most:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def discounts(n: np.ndarray, top: int = TOP) -> np.ndarray:
    """Katz's d(r) for r up to ``top`` from counts of counts n[1..top + 1], 1 above; where Good-Turing gives none, (r - 1/2) / r."""
    d = np.ones(top + 2)
    n = np.asarray(n, float)
    ratio = (top + 1) * n[top + 1] / n[1] if n[1] > 0 else 1.0
    for r in range(1, top + 1):
        d[r] = ((r + 1) * n[r + 1] / n[r] / r - ratio) / (1 - ratio) if n[r] > 0 and ratio < 1 else 0.0
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


@dataclass
class Hot:
    """Hashes, sorted, of frequent tokens, and of frequent bigrams by ``pair_id``; the second token of each is among the tokens."""

    tokens: np.ndarray
    pairs: np.ndarray


def pair_id(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A hash of a bigram from the hashes of its second token and of its first (48 bits)."""
    return (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + v * np.uint64(0x94D049BB133111EB)


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted ``known``, and where."""
    at = np.searchsorted(known, values)
    return ((at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == values)) if len(known) else np.zeros(len(values), bool), at


class Stats:
    """Totals that every partition needs, from (what, value) rows."""

    def __init__(self, what: list[int], value: list[int], hot: Hot):
        got = dict(zip(what, value))
        self.docs = got.get(0, 0)
        self.hot_count = np.array([got.get(100 + k, 0) for k in range(len(hot.tokens))], np.int64)
        self.pair_count = np.array([got.get(1_000_000 + k, 0) for k in range(len(hot.pairs))], np.int64)
        uni = np.array([0, *(got.get(10 + r, 0) for r in range(1, TOP + 2))], np.int64)
        for c in self.hot_count:
            if 0 < c <= TOP + 1:
                uni[c] += 1
        self.tokens = got.get(1, 0) + int(self.hot_count.sum())
        self.types = got.get(2, 0) + int((self.hot_count > 0).sum())
        bi = np.array([0, *(got.get(20 + r, 0) for r in range(1, TOP + 2))], np.int64)
        for c in self.pair_count:
            if 0 < c <= TOP + 1:
                bi[c] += 1
        self.d1, self.d2 = discounts(uni), discounts(bi)
        # counts above TOP keep their share; below, each count of counts loses what its discount takes
        left = sum(float(uni[r]) * r * (1 - self.d1[r]) for r in range(1, TOP + 1))
        n = max(self.tokens, 1)
        self.scale = 1.0 if left >= 0.5 or not self.tokens else n / (n + 0.5)
        self.unknown = left / n if self.scale == 1.0 and self.tokens else 1.0 - self.scale * (1 - left / n) if self.tokens else 1.0

    def p1(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * self.d1[np.minimum(c, TOP + 1)] * c / max(self.tokens, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def _bucket(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def chunk_rows(chunk: int, ids: pa.Array, held: np.ndarray, flat: np.ndarray, sizes: np.ndarray, words: list[bytes], hot: Hot, parts: int) -> list[tuple]:
    """A chunk's rows: its documents, and its bigrams for each partition.

    ``flat``: word numbers, each document's followed by that of the end token. Documents are numbered with those to learn from
    first, so a row says which are held out by one number.
    """
    h = hashes(words)
    start = int(flat.max()) + 1 if len(flat) else 0
    h = np.append(h[:start], hashes([_START]))
    rank = np.empty(len(h), np.int64)
    by = np.argsort(h)
    rank[by] = np.arange(len(h))
    first = np.empty_like(flat)
    first[1:] = flat[:-1]
    first[np.cumsum(sizes) - sizes] = start
    dest = _bucket(h, parts)[flat].astype(np.int64)
    if len(hot.tokens):
        spread = np.flatnonzero(np.isin(h, hot.tokens)[flat])
        mixed = (h[flat[spread]] ^ (h[first[spread]] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD1342543DE82EF95)
        if len(hot.pairs):
            by_chunk = np.isin(pair_id(h[flat[spread]], h[first[spread]] & _LOW48), hot.pairs)
            turned = mixed[by_chunk] + np.uint64((chunk * 0x9E3779B97F4A7C15) & (2**64 - 1))
            mixed[by_chunk] = (turned ^ (turned >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        dest[spread] = _bucket(mixed, parts)
    n = len(h)
    key = (dest * n + rank[flat]) * n + rank[first]
    del dest, first
    order = np.argsort(key, kind="stable")
    by_use = np.argsort(held, kind="stable")
    number = np.empty(len(sizes), np.uint16)
    number[by_use] = np.arange(len(sizes))
    key, doc = key[order], np.repeat(number, sizes)[order]
    del order
    pair = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.diff(np.r_[pair, len(key)])
    k = key[pair]
    v = h[by[k % n]] & _LOW48
    k //= n
    wcut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    wn = np.diff(np.r_[wcut, len(k)])
    w, wdest = h[by[k[wcut] % n]], k[wcut] // n
    held, sizes, ids = held[by_use], sizes[by_use], ids.take(pa.array(by_use))
    use = np.array([len(sizes), int((~held).sum())], np.int64)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("k", ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([ids], names=["k"]))
    rows = [(chunk % parts, chunk, DOCS, pack(held.astype(np.uint8), sizes.astype(np.int64), np.frombuffer(sink.getvalue(), np.uint8)))]
    edge = np.flatnonzero(np.r_[True, wdest[1:] != wdest[:-1], True])
    pair_at, place_at = np.r_[0, np.cumsum(wn)], np.r_[0, np.cumsum(many)]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        p, q = pair_at[a], pair_at[b]
        mine = doc[place_at[p] : place_at[q]]
        rows.append((int(wdest[a]), chunk, PAIRS, pack(w[a:b], wn[a:b].astype(np.uint32), (v[p:q] >> np.uint64(16)).astype(np.uint32), (v[p:q] & np.uint64(0xFFFF)).astype(np.uint16), many[p:q].astype(np.uint32), mine, use)))
    return rows


class Part:
    """The bigrams of one partition, from all chunks."""

    def __init__(self, rows: list[tuple[int, bytes]], hot: Hot):
        ws, vs, many, self.docs, self.of, train = [], [], [], [], [], []
        for chunk, blob in rows:
            w, wn, hi, lo, m, doc, use = unpack(blob, np.uint64, np.uint32, np.uint32, np.uint16, np.uint32, np.uint16, np.int64)
            size, learnt = use.tolist()
            ws.append(np.repeat(w, wn)), vs.append((hi.astype(np.uint64) << np.uint64(16)) | lo), many.append(m)
            train.append(np.add.reduceat((doc < learnt).astype(np.int64), np.cumsum(m, dtype=np.int64) - m))
            self.docs.append(doc), self.of.append((chunk, len(m), size, learnt))
        w, v, train = np.concatenate(ws), np.concatenate(vs), np.concatenate(train)
        del ws, vs
        self.many = many
        mixed = pair_id(w, v)
        found, at, self.pair = np.unique(mixed, return_index=True, return_inverse=True)
        self.c2 = np.bincount(self.pair, train, len(at)).astype(np.int64)
        self.v = v[at]
        self.words, self.word_of_pair = np.unique(w[at], return_inverse=True)
        self.c1 = np.bincount(self.word_of_pair, self.c2, len(self.words)).astype(np.int64)
        self.is_hot, self.hot_at = _among(self.words, hot.tokens)
        self.pair_hot, self.pair_at = _among(found, hot.pairs)

    def stats(self) -> list[tuple[int, int]]:
        """Partial totals; of hot tokens and bigrams only their own counts."""
        c1, c2, out = self.c1[~self.is_hot], self.c2[~self.pair_hot], []
        out += [(1, int(c1.sum())), (2, int((c1 > 0).sum()))]
        for r in range(1, TOP + 2):
            out += [(10 + r, int((c1 == r).sum())), (20 + r, int((c2 == r).sum()))]
        out += [(1_000_000 + int(k), int(c)) for k, c in zip(self.pair_at[self.pair_hot], self.c2[self.pair_hot])]
        return out + [(100 + int(k), int(c)) for k, c in zip(self.hot_at[self.is_hot], self.c1[self.is_hot])]

    def solve(self, s: Stats, parts: int, end: int) -> list[tuple]:
        """Sums of each chunk's documents, first tokens' sums, and requests for unseen bigrams."""
        c1 = self.c1.copy()
        c1[self.is_hot] = s.hot_count[self.hot_at[self.is_hot]]
        p1 = s.p1(c1)
        base, c2 = s.base(c1), self.c2.copy()
        c2[self.pair_hot] = s.pair_count[self.pair_at[self.pair_hot]]
        mine = np.divide(self.c2, c2, out=np.zeros(len(c2)), where=c2 > 0)  # share of a bigram's count that is here
        context = np.where((c1 > 0) & (self.words != np.uint64(end)), -np.log10(c1 + 0.5), 0.0)
        seen = c2 > 0
        d2c = s.d2[np.minimum(c2, TOP + 1)] * c2
        with np.errstate(divide="ignore"):
            score = np.where(seen, np.log10(d2c), np.log10(p1)[self.word_of_pair]) + context[self.word_of_pair]
        base, known = base[self.word_of_pair], (c1 > 0)[self.word_of_pair]
        rows, asks, begin = [], [], 0
        for (chunk, n, size, learnt), doc, many in zip(self.of, self.docs, self.many):
            pair = np.repeat(self.pair[begin : begin + n], many)
            begin += n
            open_ = doc >= learnt
            here = np.flatnonzero(np.bincount(doc, minlength=size))
            sums = (np.bincount(doc, base[pair], size)[here], np.bincount(doc, score[pair], size)[here], np.bincount(doc[open_], known[pair[open_]], size)[here].astype(np.uint32))
            rows.append((chunk % parts, chunk, SUMS, pack(np.array([s.tokens, s.docs], np.int64), here.astype(np.uint16), *sums)))
            lost = np.flatnonzero(open_)
            lost = lost[~seen[pair[lost]]]
            if len(lost):
                asks.append((chunk, self.v[pair[lost]], doc[lost]))
        left, mass = np.where(seen, c2 - d2c, 0.0) * mine, np.where(seen, p1[self.word_of_pair], 0.0) * mine
        firsts, of = np.unique(self.v[seen], return_inverse=True)
        left, mass = np.bincount(of, left[seen], len(firsts)), np.bincount(of, mass[seen], len(firsts))
        return rows + _to_first(firsts, left, mass, asks, parts)


def _first_bucket(v: np.ndarray, parts: int) -> np.ndarray:
    return (((v >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _to_first(v: np.ndarray, left: np.ndarray, mass: np.ndarray, asks: list, parts: int) -> list[tuple]:
    rows = []
    dest = _first_bucket(v, parts)  # v is sorted, and so are its partitions
    cut = np.searchsorted(dest, np.arange(parts + 1))
    for k in np.unique(dest).tolist():
        a, b = cut[k], cut[k + 1]
        rows.append((k, -1, FIRST, pack((v[a:b] >> np.uint64(16)).astype(np.uint32), (v[a:b] & np.uint64(0xFFFF)).astype(np.uint16), left[a:b].astype(np.float64), mass[a:b].astype(np.float64))))
    if asks:  # one row for each partition, whatever the number of chunks
        chunks = np.array([c for c, _, _ in asks], np.int64)
        of, keys, doc = np.repeat(np.arange(len(asks), dtype=np.uint32), [len(d) for _, _, d in asks]), np.concatenate([x for _, x, _ in asks]), np.concatenate([d for _, _, d in asks])
        dest = _first_bucket(keys, parts)
        order = np.argsort(dest, kind="stable")
        of, keys, doc = of[order], keys[order], doc[order]
        cut = np.searchsorted(dest[order], np.arange(parts + 1))
        for k in np.unique(dest).tolist():
            mine = slice(cut[k], cut[k + 1])
            rows.append((k, -1, FIX, pack(chunks, of[mine], keys[mine], doc[mine])))
    return rows


def fixes(firsts: list[bytes], asks: list[bytes], parts: int) -> list[tuple]:
    """log10 of alpha over the share that a seen bigram's context has, summed by document, for the requests of one partition."""
    v, left, mass = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0)]
    for blob in firsts:
        hi, lo, a, m = unpack(blob, np.uint32, np.uint16, np.float64, np.float64)
        v.append((hi.astype(np.uint64) << np.uint64(16)) | lo), left.append(a), mass.append(m)
    keys, of = np.unique(np.concatenate(v), return_inverse=True)
    left, mass = np.bincount(of, np.concatenate(left), len(keys)), np.bincount(of, np.concatenate(mass), len(keys))
    fix = np.append(np.log10((left + 0.5) / np.maximum(1 - mass, 1e-12)), 0.0)
    keys = np.append(keys, np.uint64(2**64 - 1))
    where, got = [], []
    for blob in asks:
        chunks, of, want, doc = unpack(blob, np.int64, np.uint32, np.uint64, np.uint16)
        at = np.searchsorted(keys, want)
        where.append((chunks[of] << 16) | doc), got.append(np.where(keys[at] == want, fix[at], 0.0))
    where, of = np.unique(np.concatenate(where), return_inverse=True)
    got = np.bincount(of, np.concatenate(got), len(where))
    chunk = where >> 16
    edge = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
    return [(int(chunk[a]) % parts, int(chunk[a]), FIX, pack((where[a:b] & 0xFFFF).astype(np.uint16), got[a:b])) for a, b in zip(edge[:-1], edge[1:])]


def _grouped(batches: Iterator[pa.RecordBatch], by: str = "dest") -> Iterator[tuple[int, list[tuple]]]:
    """(dest or chunk, rows of (chunk, kind, blob, further columns)) from rows sorted by it."""
    now, held = None, []
    for b in batches:
        more = [b.column(k).to_pylist() for k in range(4, b.num_columns)]
        for i, (dest, chunk, kind, blob) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
            dest = chunk if by == "chunk" else dest
            if dest != now:
                if held:
                    yield now, held
                now, held = dest, []
            held.append((chunk, kind, blob, *(m[i] for m in more)))
    if held:
        yield now, held


def placement(docs: DataFrame, text: str, parts: int | None) -> tuple[Hot, int]:
    """Frequent tokens and bigrams, and the number of partitions, from a sample; they decide on placement only.

    Frequent: a share over a quarter of a partition's. Each task of the sample sends what makes up a fifty-thousandth of its tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for b in slices(batches, 500):
            for raw in raw_texts(b.column(0)):
                ws = raw.lower().split()
                ws.append(_END)
                seen.update(ws)
                seen.update(b" ".join(p) for p in zip([_START, *ws], ws))  # no word holds a blank
                n += len(ws)
        found = [(w, c) for w, c in seen.items() if c * 50_000 >= n and c > 1] + [(b"", n)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([c for _, c in found], pa.int64())], names=["w", "c"])

    counted = docs.select(text).sample(False, HOT_SAMPLE, 3).mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))
    counted = written(counted, "katz-sample")
    total = counted.filter(F.octet_length("w") == 0).agg(F.sum("c").alias("n")).first().n or 0
    parts = parts or max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total / HOT_SAMPLE) // PART_TOKENS))
    rows = counted.filter((F.octet_length("w") > 0) & (F.col("c") * parts >= HOT_SHARE * total)).orderBy(F.col("c").desc(), "w").limit(8 * int(parts / HOT_SHARE)).collect()
    pairs = [bytes(r.w).split(b" ") for r in rows if b" " in bytes(r.w)]
    tokens = sorted({bytes(r.w) for r in rows if b" " not in bytes(r.w)} | {w for _, w in pairs})
    ids = pair_id(hashes([w for _, w in pairs]), hashes([v for v, _ in pairs]) & _LOW48) if pairs else np.zeros(0, np.uint64)
    return Hot(np.sort(hashes(tokens)), np.sort(ids)), parts


def scored(docs: DataFrame, *, key: str = "doc_id", text: str = "text", held_out: Column | None = None, parts: int | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for each row.

    Learns from the rows that aren't ``held_out`` (default: crc32 of the key mod 10 is 0).
    A null text has one token, the end; a null key counts as the empty text and is
    kept; repeated rows count each. Nothing to learn from: every score is 0.
    """
    held_out = crc_mod(key, 10) == 0 if held_out is None else held_out
    hot, parts = placement(docs, text, parts)
    end = int(hashes([_END])[0])
    frame = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), held_out.alias("h"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 24
        made = 0

        def done() -> Iterator[pa.RecordBatch]:
            rows = chunk_rows(base + made, pa.concat_arrays(ids), np.concatenate(held), np.concatenate(flat), np.array(sizes, np.int64), list(number), hot, parts)
            yield from _in_parts(rows)

        number, ids, held, flat, sizes, n = {_END: 0}, [], [], [], [], 0
        for b in slices(batches, 500):
            line: list[int] = []
            for raw in raw_texts(b.column(1)):
                at = len(line)
                line += [number.setdefault(w, len(number)) for w in raw.lower().split()]
                line.append(0)
                sizes.append(len(line) - at)
            ids.append(b.column(0)), held.append(b.column(2).to_numpy(zero_copy_only=False)), flat.append(np.array(line, np.int64))
            n += len(line)
            if n >= CHUNK_TOKENS or len(sizes) + 500 >= CHUNK_DOCS:
                yield from done()
                made += 1
                number, ids, held, flat, sizes, n = {_END: 0}, [], [], [], [], 0
        if sizes:
            yield from done()

    sent = frame.mapInArrow(send, _ROW).repartitionById(parts, F.col("dest").cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, int] = defaultdict(int)
        for _, rows in _grouped(batches):
            for _, kind, blob in rows:
                if kind == DOCS:
                    out[0] += int((unpack(blob, np.uint8)[0] == 0).sum())
            pairs = [(c, blob) for c, kind, blob in rows if kind == PAIRS]
            if pairs:
                for what, value in Part(pairs, hot).stats():
                    out[what] += value
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.int64())], names=["what", "value"])

    totals = sent.sortWithinPartitions("dest").mapInArrow(count, "what int, value long").groupBy("what").agg(F.sum("value").alias("value"))
    totals = totals.agg(F.collect_list("what").alias("what"), F.collect_list("value").alias("value"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dest, rows in _grouped(batches):
            s = Stats(rows[0][3], rows[0][4], hot)
            yield from _in_parts([(dest, c, kind, blob) for c, kind, blob, *_ in rows if kind == DOCS])
            pairs = [(c, blob) for c, kind, blob, *_ in rows if kind == PAIRS]
            del rows
            if pairs:
                yield from _in_parts(Part(pairs, hot).solve(s, parts, end))

    solved = sent.crossJoin(F.broadcast(totals)).sortWithinPartitions("dest").mapInArrow(solve, _ROW)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            yield from _in_parts([(c % parts, c, kind, blob) for c, kind, blob in rows if kind in (DOCS, SUMS)])
            asks = [blob for _, kind, blob in rows if kind == FIX]
            if asks:
                yield from _in_parts(fixes([blob for _, kind, blob in rows if kind == FIRST], asks, parts))

    met = solved.repartitionById(parts, F.col("dest").cast("int")).sortWithinPartitions("dest").mapInArrow(meet, _ROW)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, by="chunk"):
            held, sizes, ids = next(unpack(blob, np.uint8, np.int64, np.uint8) for _, k, blob in rows if k == DOCS)
            base, score, known, tokens, n = np.zeros(len(held)), np.zeros(len(held)), np.zeros(len(held), np.int64), 0, 0
            for _, k, blob in rows:
                if k == SUMS:
                    total, doc, b, s, m = unpack(blob, np.int64, np.uint16, np.float64, np.float64, np.uint32)
                    tokens, n = int(total[0]), int(total[1])
                    base[doc] += b
                    score[doc] += s
                    known[doc] += m
                elif k == FIX:
                    doc, x = unpack(blob, np.uint16, np.float64)
                    score[doc] += x
            score -= np.log10(n + 0.5) if n else 0.0
            keys = pa.ipc.open_stream(ids.tobytes()).read_all().column(0).combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, pa.array(held.astype(bool)), pa.array(sizes), pa.array(np.where(held, known, sizes)), pa.array(np.full(len(held), tokens)), pa.array(base), pa.array(score)], names=names)

    return met.repartitionById(parts, F.col("dest").cast("int")).sortWithinPartitions("chunk").mapInArrow(gather, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
