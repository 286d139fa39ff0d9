"""Quality classifier: gradient-boosted trees over document statistics.

The trees are learnt on the driver from a sample of labelled rows of at most
``max_train_rows`` (a documented bound: the rows with the smallest hashes), and
sent to the executors as a few kilobytes of arrays. Scoring is one pass over the
table without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import gbt
from quern.llm.common import crc_mod, raw_texts, slices

#: Labelled rows that a model is learnt from, at most.
MAX_TRAIN_ROWS = 20_000
#: From this score on a document counts as good.
GOOD = 0.7

_CLASSES = (b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"(){}[]=_\\/+-~^@", b"\"'`", b"abcdefghijklmnopqrstuvwxyz", b" \t\r\x0b\x0c", b"\n")


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(_CLASSES) + 1))
    for k, members in enumerate(_CLASSES):
        m[list(members), k] = 1
    m[128:, len(_CLASSES)] = 1
    return m


def statistics(raws: list[bytes]) -> np.ndarray:
    """One row of numbers for each UTF-8 text; an empty text has zeros."""
    hist, rest = np.zeros((len(raws), 256)), np.zeros((len(raws), 11))
    for i, raw in enumerate(raws):
        words = raw.split()
        n = len(words)
        if not n:
            continue
        hist[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lens = np.fromiter(map(len, words), np.int64, n)
        same = sum(a == b for a, b in zip(words, words[1:]))
        pairs = len(set(zip(words, words[1:])))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        counts = Counter(words)
        rest[i] = (
            np.log1p(n), lens.mean(), lens.std(), lens.max(), len(counts) / n, counts.most_common(1)[0][1] / n, same / n, pairs / max(1, n - 1),
            1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), n / max(1, len(lines)),
        )
    n = np.maximum(np.expm1(rest[:, :1]), 1)
    size = np.maximum(hist.sum(1, keepdims=True), 1)
    classes = hist @ _class_matrix()
    return np.hstack([rest, classes / size, classes[:, :7] / n])


WIDTH = 11 + len(_CLASSES) + 1 + 7


def train(docs: DataFrame, labels: DataFrame, *, learn_from: Column | None = None, text: str = "text", key: str = "doc_id", label: str = "quality", max_train_rows: int = MAX_TRAIN_ROWS) -> gbt.Forest:
    """Learn ``label`` (0 or 1) from ``docs`` joined to ``labels`` by ``key``.

    ``learn_from`` is a condition over ``key``. Labels other than 0 and 1 and null keys
    are left out; of several labels of one key the larger counts. The sample is
    the ``max_train_rows`` rows of smallest hash, first of labels, then of joined rows.
    """
    mine = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if learn_from is not None:
        mine = mine.filter(learn_from)
    mine = mine.groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64(F.col("k"), F.lit(7))
    bounded = mine.orderBy(order, "k").limit(max_train_rows)
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(bounded), "k")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            x = statistics(raw_texts(b.column(1))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["k", "y", "x"])

    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()
    rows = joined.mapInArrow(measure, f"k {kind}, y int, x array<double>").orderBy(order, "k").limit(max_train_rows).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, WIDTH)
    return gbt.fit(x, np.array(rows.column("y").to_pylist(), float))


def score(docs: DataFrame, model: gbt.Forest, *, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``to`` (an own column of that name is replaced)."""
    keep = [c for c in docs.columns if c != to]
    frame = docs.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            p = model.probability(statistics(raw_texts(b.column(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, to])

    return frame.mapInArrow(run, frame.withColumn(to, F.lit(0.0)).schema)


def classified(docs: DataFrame, labels: DataFrame, *, good: float = GOOD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Nulls: a null text scores as an empty one, a null doc_id is scored too and
    never learnt from. Repeated rows stay repeated. Empty labels: every score is 0.5.
    """
    model = train(docs, labels, learn_from=crc_mod("doc_id", 4) != 2)
    slim = docs.select("doc_id", "text")
    return score(slim, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= good).cast("int").alias("predicted"))
