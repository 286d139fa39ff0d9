"""Similar texts of the SimHash operator: five-word shingles with a Jaccard similarity of 0.8 or more.

Texts with equal sets of shingles become one, with the SimHash fingerprint of its set. Candidates are found by fingerprints and
decided by the sets themselves:

* the operator's Gray-order index over the whole corpus, dealt out by pigeonhole, gives pairs of at most ``NEAR`` differing bits that
  span what is that near;
* a pair of similarity 0.8 may differ in more bits than pigeonhole can deal out, so the rest is searched up to ``WIDE`` bits (passed with
  probability 1.1e-6 at most at 0.8) inside buckets, one for each band of ``ROWS`` min-hashes; a pair of similarity s shares no band with
  probability (1 - s^ROWS)^BANDS: 3.2e-6 at 0.8. Buckets that the first search made one component are done.

No bucket is ever gathered whole:

* every member of a bucket is held against its lead, then every member that isn't similar to it against the lead
  of those, which joins the copies of one or two texts however many they are; the lead is the text that meets most others in all its buckets, as
  the original of many copies does;
* what is left of a bucket that still spans components is searched in units by the Gray-order index: members of its largest component
  in blocks of ``BLOCK`` against the others in blocks. Pairs of different components within ``WIDE`` bits whose signatures agree in ``AGREE`` places or
  more (a pair of similarity 0.8 does with probability 1 - 1e-7) are decided by their sets, those that agree most first, and
  each in the unit of its first common band only. A pair that links joins its components, so a unit gives links, never pairs.

Components of the decided pairs are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import free_name, hashable, raw_texts, row_identity, slices, written
from quern.llm.simhash import ROUTE_ROWS, components, gray_index, gray_rank, gray_search, links, majority

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 24, 4
BLOCK, BLOCK_BYTES, AGREE = 4096, 64 << 20, 56
NEAR, WIDE = 7, 28
_SEEDS, _ODD = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_ODD |= np.uint64(1)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD1342543DE82EF95], np.uint64)


def shingle_set(raw: bytes, words: int = SHINGLE) -> np.ndarray:
    """Sorted XXH64 values of a text's shingles; fewer words than a shingle are one; no word: none."""
    import xxhash

    ws = raw.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    begin = [0, *ends[: max(0, len(ws) - words)].tolist()]
    stop = (ends[min(words, len(ws)) - 1 :] - 1).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip(begin, stop)], np.uint64))


def signature(part: np.ndarray) -> np.ndarray:
    """The min-hashes of a set of shingles that isn't empty."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(part), 4096):
        low = np.minimum(low, ((part[None, at : at + 4096] ^ _SEEDS) * _ODD).min(axis=1))
    return low


def set_fingerprints(parts: list[np.ndarray]) -> np.ndarray:
    """64-bit SimHash of each set of shingles; an empty one: zero."""
    out, full = np.zeros(len(parts), np.uint64), [i for i, p in enumerate(parts) if len(p)]
    if full:
        sizes = [len(parts[i]) for i in full]
        out[full] = majority(np.concatenate([parts[i] for i in full]), np.cumsum([0, *sizes[:-1]]).tolist(), sizes)
    return out


def bands(low: np.ndarray) -> np.ndarray:
    """A key for each band of a signature."""
    return (low.reshape(BANDS, ROWS) * _PLACE).sum(axis=1, dtype=np.uint64) ^ _SEEDS[:BANDS, 0]


def _described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, row_key, same (equal for equal sets of shingles), fp (fingerprint of the set, as a long), bands and 16 bits of each min-hash for each row; no bands for a text without a word."""
    kind = docs.schema[key].dataType.simpleString()
    frame = docs.select(F.col(key).alias("doc_id"), row_identity(key, text).alias("row_key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, 200, 4 << 20):
            parts = [shingle_set(raw) for raw in raw_texts(b.column(2))]
            same = np.array([xxhash.xxh64_intdigest(p.tobytes(), 7) for p in parts], np.uint64).view(np.int64)
            low = [signature(p) if len(p) else None for p in parts]
            keys = pa.array([[] if x is None else bands(x).view(np.int64) for x in low], pa.list_(pa.int64()))
            signs = pa.array([None if x is None else (x & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for x in low], pa.binary())
            fp = pa.array(set_fingerprints(parts).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same), fp, keys, signs], names=["doc_id", "row_key", "same", "fp", "bands", "sign"])

    return frame.mapInArrow(run, f"doc_id {kind}, row_key binary, same long, fp long, bands array<long>, sign binary")


def _sets(docs: DataFrame, members: DataFrame, key: str, text: str) -> DataFrame:
    """(same, part): the set of shingles of each member (same, row_key)."""
    rows = docs.select(row_identity(key, text).alias("row_key"), F.col(text).alias("text")).join(members, "row_key").select("same", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200, 4 << 20):
            parts = [shingle_set(raw).tobytes() for raw in raw_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.binary())], names=["same", "part"])

    return rows.mapInArrow(run, "same long, part binary").dropDuplicates(["same"])  # rows equal in key and text have one set


def decided(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``similar``."""
    left = sets.select(F.col("same").alias("a"), F.col("part").alias("pa"))
    right = sets.select(F.col("same").alias("b"), F.col("part").alias("pb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for b in slices(batches, 500, 16 << 20):
            keep = []
            for i, (x, y, z) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                if x != last:
                    last, mine = x, np.frombuffer(y, np.uint64)
                other = np.frombuffer(z, np.uint64)
                if min(len(mine), len(other)) < similar * max(len(mine), len(other)) - 1e-9:
                    continue
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if both >= similar * (len(mine) + len(other) - both) - 1e-9:
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def unit_links(band: int, side: np.ndarray, root: np.ndarray, fps: np.ndarray, signs: np.ndarray, keys: np.ndarray, parts: list[np.ndarray], similar: float = SIMILAR, agree: int = AGREE, wide: int = WIDE, chunk: int = 64) -> list[tuple[int, int]]:
    """Links (places) that join what is similar in a unit: members of side 0 with those of side 1, or with each other where there are none.

    ``keys``: the bands of each member, of which ``band`` is the unit's. Each chunk of searchers meets what is within ``wide`` bits by the index.
    """
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    whole = not len(two)
    two = one if whole else two
    if not len(one) or not len(two):
        return []
    at = int(np.flatnonzero(keys[one[0]] == band)[0])
    comp = np.unique(root, return_inverse=True)[1]
    size, out = np.array([len(p) for p in parts]), []
    two = two[np.argsort(gray_rank(fps[two]), kind="stable")]
    levels = gray_index(fps[two])
    for q0 in range(0, len(one), chunk):
        q = one[q0 : q0 + chunk]
        qs, place = gray_search(levels, comp[two], fps[q], comp[q], np.full(len(q), -1), wide)
        a, b, near = q[qs], two[place], []
        for k in range(0, len(a), 8192):
            i, j = a[k : k + 8192], b[k : k + 8192]
            score = (signs[i] == signs[j]).sum(axis=1)
            good = (score >= agree) & ((keys[i] == keys[j]).argmax(axis=1) == at) & (np.minimum(size[i], size[j]) >= similar * np.maximum(size[i], size[j]) - 1e-9)
            good &= (j > i) | (not whole)
            near += zip((-score[good]).tolist(), i[good].tolist(), j[good].tolist())
        for _, i, j in sorted(near):
            if comp[j] != comp[i] and similarity(parts[i], parts[j]) >= similar - 1e-12:
                out.append((i, j))
                comp[comp == comp[j]] = comp[i]
    return out


def _left_over(spread: DataFrame, similar: float, block: int) -> DataFrame:
    """(a, b) that link the members of the buckets ``spread`` (band, same, root, fp, sign, bands, part) across components.

    A bucket's members are of its core (the largest component) or others, each dealt out to blocks of so many members or
    ``BLOCK_BYTES`` of sets. A unit is a block of others with itself, with a later block of others, or with a block of the core.
    """
    size = F.octet_length("part")
    sizes = spread.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    core = sizes.groupBy("band").agg(F.max(F.struct("n", "bytes", "root")).alias("core"), F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"))
    inside = F.col("root") == F.col("core.root")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(size / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("same"), F.when(inside, F.col("n_core")).otherwise(F.col("n_others"))).cast("int")
    j = spread.join(core, "band").withColumns({"n_core": blocks(F.col("core.n"), F.col("core.bytes")), "n_others": blocks(F.col("all") - F.col("core.n"), F.col("all_bytes") - F.col("core.bytes"))})
    j = j.withColumns({"inside": inside, "own": own})
    cores = F.transform(F.sequence(F.lit(0), F.col("n_others") - 1), lambda o: F.struct(F.concat(F.lit("c"), F.col("own"), F.lit("-"), o).alias("unit"), F.lit(1).alias("side")))
    with_core = F.transform(F.sequence(F.lit(0), F.col("n_core") - 1), lambda c: F.struct(F.concat(F.lit("c"), c, F.lit("-"), F.col("own")).alias("unit"), F.lit(0).alias("side")))
    others = F.transform(F.sequence(F.lit(0), F.col("n_others") - 1), lambda o: F.struct(F.concat(F.lit("o"), F.least(o, F.col("own")), F.lit("-"), F.greatest(o, F.col("own"))).alias("unit"), F.when(o < F.col("own"), 1).otherwise(0).alias("side")))
    units = j.select("band", "same", "root", "fp", "sign", "bands", "part", F.explode(F.when(F.col("inside"), cores).otherwise(F.concat(with_core, others))).alias("u")).select("band", "u.*", "same", "root", "fp", "sign", "bands", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            side, same, root, fp, sign, keys, parts = zip(*rows)
            side = np.array(side)
            if now[1][0] == "c" and not (side.any() and (side == 0).any()):
                return  # others without a core, or the reverse
            found = unit_links(now[0], side, np.array(root, np.int64), np.array(fp, np.int64).view(np.uint64), np.stack([np.frombuffer(x, np.uint16) for x in sign]), np.array(keys, np.int64), [np.frombuffer(x, np.uint64) for x in parts], similar)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([same[k] for k in a], pa.int64()), pa.array([same[k] for k in b], pa.int64())], names=["a", "b"])

        now, held = ("", ""), []
        for batch in batches:
            for band, unit, *row in zip(*(batch.column(k).to_pylist() for k in range(9))):
                if (band, unit) != now:
                    if held:
                        yield from solved(held)
                    now, held = (band, unit), []
                held.append(row)
        if held:
            yield from solved(held)

    return units.repartition("band", "unit").sortWithinPartitions("band", "unit").mapInArrow(run, "a long, b long")


def near_pairs(distinct: DataFrame, near: int = NEAR, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """Pairs (a, b) of ``distinct`` (same, fp) that span what is within ``near`` differing bits, by the Gray-order index of the operator."""
    first = written(distinct.groupBy("fp").agg(F.min("same").alias("first")), "near-fingerprints")
    equal = distinct.join(first, "fp").filter("same <> first").select(F.col("same").alias("a"), F.col("first").alias("b"))
    left, right = first.select(F.col("fp").alias("a"), F.col("first").alias("one")), first.select(F.col("fp").alias("b"), F.col("first").alias("two"))
    apart = links(first.select("fp"), near=near, route_rows=route_rows, direct=True).join(left, "a").join(right, "b")
    return equal.unionByName(apart.select(F.col("one").alias("a"), F.col("two").alias("b")))


def similar_roots(distinct: DataFrame, sets_of, *, similar: float = SIMILAR, block: int = BLOCK, near: int = NEAR, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """(v, root) for the values of ``same`` in ``distinct`` (same, fp, bands, sign, row_key) that are linked by pairs of at least ``similar``.

    ``sets_of`` gives the sets of a table of (same, row_key).
    """
    pairs = written(near_pairs(distinct.filter(F.size("bands") > 0).select("same", "fp"), near, route_rows), "near-pairs")
    each = distinct.select("same", "fp", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    live = written(each.join(shared, "band"), "near-buckets")
    weight = live.groupBy("same").agg(F.sum("n").alias("weight"))
    met = live.select("same").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("same"))).distinct()
    sets = written(sets_of(distinct.join(met, "same").select("same", "row_key")), "near-sets")
    close = written(decided(pairs, sets, similar), "near-links")

    # the text that meets most others; of equals the smallest
    best = F.max_by(F.struct(F.col("same").alias("lead"), F.col("fp").alias("lead_fp"), F.col("root").alias("lead_root")), F.struct("weight", -F.col("same"))).alias("l")
    apart = (F.min("root") < F.max("root")).alias("apart")
    lead = lambda rows: rows.join(weight, "same").groupBy("band").agg(best, apart).filter("apart").select("band", "l.*")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.select(F.col("v").alias("same"), "root"), "same", "left").withColumn("root", F.coalesce("root", "same"))

    def against(rows: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
        """Links of members (band, same, fp, root) with their bucket's lead, and the members of other components that have none."""
        led = written(rows.join(lead(rows), "band").filter("root <> lead_root").select(*rows.columns, "lead", "lead_fp"), f"near-{what}")
        within = led.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("lead_fp"))) <= WIDE)
        found = written(decided(within.select(F.col("same").alias("a"), F.col("lead").alias("b")).distinct(), sets, similar), "near-links")
        linked = found.select(F.col("a").alias("same"), F.col("b").alias("lead"))
        return found, written(led.join(linked, ["same", "lead"], "left_anti").select(*rows.columns), "near-strays")

    rows = rooted(live.select("band", "same", "fp"), components(close))
    ones, strays = against(written(rows.select("band", "same", "fp", "root"), "near-rooted"), "first")
    twos, _ = against(strays, "second")
    found = close.unionByName(ones).unionByName(twos)
    roots = components(found)
    crowded = live.join(strays.select("band").distinct(), "band", "left_semi")  # a bucket without strays is one component
    rows = rooted(crowded.select("band", "same"), roots)
    several = rows.groupBy("band").agg(apart, F.count("*").alias("n")).filter("apart and n > 2").select("band")
    spread = rows.join(several, "band", "left_semi").join(distinct.select("same", "fp", "sign", "bands"), "same").join(sets, "same")
    more = written(_left_over(written(spread.select("band", "same", "root", "fp", "sign", "bands", "part"), "near-spread"), similar, block), "near-links")
    return roots if more.isEmpty() else components(found.unionByName(more))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, block: int = BLOCK, near: int = NEAR, route_rows: int = ROUTE_ROWS) -> DataFrame:
    """One row of ``docs`` for each group linked by pairs of at least ``similar``, that of the smallest id; all columns stay.

    A null text is an empty one; empty texts are copies of each other. A null id stays only where
    its group has no other. Of rows equal in id and text the one with the smallest hash of all its columns stays.
    """
    rows = written(_described(docs, key, text), "near-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")).alias("m")
    distinct = written(rows.groupBy("same").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sign").alias("sign")), "near-distinct")
    members = distinct.select("same", "fp", "bands", "sign", F.col("m.row_key").alias("row_key"))
    roots = similar_roots(members, lambda some: _sets(docs, some, key, text), similar=similar, block=block, near=near, route_rows=route_rows)
    named = distinct.join(roots, F.col("same") == F.col("v"), "left").select("m", F.coalesce("root", "same").alias("root"))
    keep = named.groupBy("root").agg(F.min("m").alias("m")).select(F.col("m.row_key").alias(at := free_name(docs, "near_row")))
    return one_of_each(docs.withColumn(at, row_identity(key, text)).join(keep, at, "left_semi"), at)


def one_of_each(rows: DataFrame, by: str) -> DataFrame:
    """One row of each value of ``by``, that with the smallest hash of all its columns; ``by`` goes."""
    held = [f"`{c}`" for c in rows.columns if c != by]
    least = F.min_by(F.struct(*held), F.xxhash64(*[c for c in hashable(rows) if c != f"`{by}`"]))
    return rows.groupBy(by).agg(least.alias("_row")).select("_row.*")
