"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are made row by row. Distinct ones are dealt out by the pigeonhole
rule: of five blocks of bits, two fingerprints with at most four differing bits share one.
A route (block and its bits) that holds more than ``ROUTE_ROWS`` fingerprints is dealt out
again by the bits that are left, which is exact too. Within a route the
fingerprints are sorted by Gray rank, so neighbours differ little; each upper node
keeps the bits that its group shares, and a search adds up differences from node to
node and drops a group once they exceed the limit. A group that is already in the
searcher's component is dropped as well, so a dense group gives a spanning set of
links, not all pairs. Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import free_name, raw_texts, row_identity, slices, written

NEAR, WORDS, ROUTE_ROWS, LEVELS = 4, 4, 50_000, 3
LEAF = 16
#: Searchers times fingerprints that a chunk of a search holds at most, one searcher at least.
CELLS = 1 << 20
#: Lanes of a uint64 that hold the bits of each byte value, low bit first.
_LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def fingerprints(raws: list[bytes], words: int = WORDS) -> np.ndarray:
    """64-bit SimHash of each UTF-8 text over shingles of ``words`` words; no word: zero."""
    import xxhash

    h, out, starts, sizes, hashes = xxhash.xxh64_intdigest, np.zeros(len(raws), np.uint64), [], [], []
    full: list[int] = []
    for i, raw in enumerate(raws):
        ws = raw.lower().split()
        if not ws:
            continue
        joined = b" ".join(ws)
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
        begin = [0, *ends[: max(0, len(ws) - words)].tolist()]
        stop = (ends[min(words, len(ws)) - 1 :] - 1).tolist()
        full.append(i), starts.append(len(hashes)), sizes.append(len(begin))
        hashes += [h(joined[s:e], 42) for s, e in zip(begin, stop)]
    if full:
        out[full] = majority(np.array(hashes, np.uint64), starts, sizes)
    return out


def majority(hashes: np.ndarray, starts: list[int], sizes: list[int]) -> np.ndarray:
    """The bits set in over half of each run of ``hashes``; no run is empty."""
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    cuts = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(starts, sizes)])
    part = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).astype(np.int64)
    per = np.cumsum([0, *(-(-n // 255) for n in sizes)])[:-1]
    ones = np.add.reduceat(part, per, axis=0)
    bits = (2 * ones > np.array(sizes)[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, nxt := label[label]):
            label = nxt


def _spanned(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_merge`` and those of the pairs that make it: a forest."""
    one, two = [a[:0]], [b[:0]]
    while len(at := np.flatnonzero(label[a] != label[b])):
        a, b = a[at], b[at]
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        high, first = np.unique(high, return_index=True)
        label[high] = low[first]
        one.append(a[first]), two.append(b[first])
        while not np.array_equal(label, nxt := label[label]):
            label = nxt
    return label, np.concatenate(one), np.concatenate(two)


def gray_index(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The levels of the index over ``x``, which is sorted by Gray rank, leaves first: bits that a node shares, their mask, its first place and that after its last."""
    n = len(x)
    levels = [(x, np.full(n, ~np.uint64(0)), np.arange(n), np.arange(1, n + 1))]
    while len(levels[-1][0]) > LEAF:
        pat, mask, lo, hi = levels[-1]
        at = np.arange(0, len(pat), LEAF)
        lead = pat[at][np.minimum(np.arange(len(pat)) // LEAF, len(at) - 1)]
        same = np.bitwise_and.reduceat(mask & ~(pat ^ lead), at)
        levels.append((pat[at] & same, same, lo[at], hi[np.minimum(at + LEAF - 1, len(pat) - 1)]))
    return levels


def gray_search(levels: list[tuple], label: np.ndarray, fps: np.ndarray, own: np.ndarray, after: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(searcher, place) for the fingerprints within ``near`` bits of the searchers ``fps``, beyond place ``after``, but not those of the searcher's ``own`` label."""
    width = len(levels[-1][0])
    qs, node = np.repeat(np.arange(len(fps)), width), np.tile(np.arange(width), len(fps))
    acc = np.zeros(len(qs), np.int64)
    known = np.zeros(len(qs), np.uint64)
    for level in range(len(levels) - 1, -1, -1):
        pat, mask, lo, hi = levels[level]
        acc = acc + np.bitwise_count((fps[qs] ^ pat[node]) & mask[node] & ~known)
        low, high = np.minimum.reduceat(label, lo), np.maximum.reduceat(label, lo)
        keep = (acc <= near) & (hi[node] > after[qs] + 1) & ~((low[node] == high[node]) & (low[node] == own[qs]))
        qs, node, acc = qs[keep], node[keep], acc[keep]
        if level == 0 or not len(qs):
            break
        known = mask[node]
        below = len(levels[level - 1][0])
        fan = np.minimum(LEAF, below - node * LEAF)
        step = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        node = np.repeat(node * LEAF, fan) + step
        qs, acc, known = np.repeat(qs, fan), np.repeat(acc, fan), np.repeat(known, fan)
    return qs, node


def gray_groups(x: np.ndarray, near: int = NEAR, chunk: int = 256, pairs: list | None = None) -> np.ndarray:
    """A component label for each of the fingerprints ``x``, which are sorted by Gray rank.

    ``pairs`` gets arrays (a, b) of places that are near and span the components.
    """
    label, levels, chunk = np.arange(len(x)), gray_index(x), max(1, min(chunk, CELLS // max(1, len(x))))
    for q0 in range(0, len(x), chunk):
        q = np.arange(q0, min(len(x), q0 + chunk))
        qs, node = gray_search(levels, label, x[q], label[q], q, near)
        if len(qs) and pairs is None:
            label = _merge(label, q[qs], node)
        elif len(qs):
            label, *found = _spanned(label, q[qs], node)
            pairs.append(found)
    return label


def route_links(key: np.ndarray, fp: np.ndarray, near: int = NEAR, pairs: list | None = None) -> np.ndarray:
    """Labels over rows sorted by route ``key`` and Gray rank; equal labels are linked inside a route.

    ``pairs`` gets arrays (a, b) of places that are near and span what is linked.
    """
    n = len(key)
    label = np.arange(n)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, n])
    small = int(size[size <= 4 * LEAF].max(initial=1))
    a, b = [], []
    for d in range(1, small):
        i = np.flatnonzero((key[d:] == key[:-d]) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= near))
        a.append(i), b.append(i + d)
    if a and pairs is None:
        label = _merge(label, np.concatenate(a), np.concatenate(b))
    elif a:
        label, *found = _spanned(label, np.concatenate(a), np.concatenate(b))
        pairs.append(found)
    for s, m in zip(cut[size > 4 * LEAF], size[size > 4 * LEAF]):
        inside = None if pairs is None else []
        label[s : s + m] = s + gray_groups(fp[s : s + m], near, pairs=inside)
        if inside:
            pairs += [(s + x, s + y) for x, y in inside]
    return label


def _routes(frame: DataFrame, bits: int, near: int) -> tuple[DataFrame, int]:
    """(key, rest, fp) dealt out by each of near + 1 blocks of the ``bits`` low bits of rest."""
    blocks, width, out = near + 1, -(-bits // (near + 1)), []
    left = bits - (bits - width * (blocks - 1) if bits > width * (blocks - 1) else 1)
    for k in range(blocks):
        lo, hi = min(bits, k * width), min(bits, (k + 1) * width)
        value = F.shiftrightunsigned("rest", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi > lo else F.lit(0)
        above = F.shiftleft(F.shiftrightunsigned("rest", hi), lo) if hi < 64 else F.lit(0).cast("long")
        rest = above.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << lo) - 1).cast("long")))
        out.append(F.struct(F.xxhash64(F.col("key"), F.lit(k), value.cast("long")).alias("key"), rest.alias("rest"), F.col("fp")))
    return frame.select(F.explode(F.array(*out)).alias("r")).select("r.*"), left


def links(distinct: DataFrame, *, near: int = NEAR, route_rows: int = ROUTE_ROWS, direct: bool = False) -> DataFrame:
    """(a, b) between fingerprints ``fp`` (long), enough of them to span every component; with ``direct`` each is a pair within ``near`` bits."""
    todo, bits, done = distinct.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp"), 64, None
    for level in range(LEVELS):
        todo, bits = _routes(todo, bits, near)
        if level + 1 < LEVELS:
            todo = written(todo, "simhash-routes") if level else todo
            hot = todo.groupBy("key").count().filter(F.col("count") > route_rows).select("key")
            hot = written(hot, "simhash-hot")
            if hot.isEmpty():
                break
            cold = todo.join(hot, "key", "left_anti")
            done = cold if done is None else done.unionByName(cold)
            todo = todo.join(hot, "key", "left_semi")
    todo = todo if done is None else done.unionByName(todo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def solved(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((gray_rank(fp), key))
            key, fp = key[order], fp[order]
            pairs = [] if direct else None
            label = route_links(key, fp, near, pairs)
            i = np.flatnonzero(label != np.arange(len(label)))
            j = label[i]
            if pairs:
                i, j = (np.concatenate(side) for side in zip(*pairs))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], names=["a", "b"])

        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(key) >= 200_000 and key[0] != key[-1]:
                last = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1
                yield from solved(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(key):
            yield from solved(key, fp)

    return todo.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b); root is the smallest vertex reachable.

    Alternating large-star and small-star steps, each written to the shared folder,
    until the set of edges stays as it is.
    """
    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return r[0], r[1]

    e = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    now = state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "star")
        before, now = now, state(e)
        if now == before:
            break
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def fingerprinted(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, fp (the fingerprint's bits as a long) for each row."""
    kind = docs.schema[key].dataType.simpleString()
    frame = docs.select(F.col(key).alias("doc_id"), row_identity(key, text).alias("row_key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            fp = fingerprints(raw_texts(b.column(2))).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "row_key", "fp"])

    return frame.mapInArrow(run, f"doc_id {kind}, row_key binary, fp long")


def _named(rows: DataFrame, near: int, route_rows: int) -> DataFrame:
    """fp, component_id, root for each distinct fingerprint of ``rows`` (doc_id, fp)."""
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, near=near, route_rows=route_rows))
    member = distinct.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = distinct.join(roots, F.col("fp") == F.col("v")).groupBy("root").agg(F.min("least").alias("linked"))
    return member.join(linked, "root", "left").select("fp", F.least("least", "linked").alias("component_id"), "root")


def clustered(docs: DataFrame, *, key: str = "doc_id", text: str = "text", near: int = NEAR, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """doc_id, row_key, fp, component_id, root for each row; component_id is the smallest id reachable.

    Nulls: a null text is an empty one (fingerprint zero), a null id never is a
    component's id unless the component has no other. Repeated rows stay. Empty: no rows.
    """
    rows = written(fingerprinted(docs, key=key, text=text), "simhash-rows")
    return rows.join(_named(rows, near, route_rows), "fp")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", near: int = NEAR, route_rows: int = ROUTE_ROWS, similar: float | None = None) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest id; all columns stay.

    Rows are linked by fingerprints of at most ``near`` differing bits; or, with ``similar``, by that Jaccard similarity of their
    five-word shingles: then candidates meet by fingerprints, first those of at most ``near`` differing bits, and their sets decide (see
    ``near_text``). Copies are aggregated by fingerprint before components meet
    them. Texts are shuffled once, by row, so that a large group of copies is spread out. Of rows equal in id and text the one with the
    smallest hash of all its columns stays.
    """
    from quern.llm import near_text

    if similar is not None:
        return near_text.deduplicated(docs, key=key, text=text, similar=similar, near=near, route_rows=route_rows)
    rows = written(fingerprinted(docs, key=key, text=text), "simhash-rows")
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("m"))
    keep = first.join(_named(rows, near, route_rows), "fp").groupBy("root").agg(F.min("m").alias("m")).select(F.col("m.row_key").alias(at := free_name(docs, "near_row")))
    return near_text.one_of_each(docs.withColumn(at, row_identity(key, text)).join(keep, at, "left_semi"), at)
