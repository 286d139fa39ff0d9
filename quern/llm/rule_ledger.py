"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps what was measured and
one bit for each failed rule; policies are versioned masks over these bits, so a
policy can be changed, compared or ablated without reading a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import raw_texts, slices

#: What is measured, in order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct_words", "n_digits", "n_fewest_distinct")

#: Words of a block of ``n_fewest_distinct``, the fewest distinct words in any: shares of distinct words compare only over like lengths.
BLOCK = 4999

#: Rules by bit: name, and the failing condition over the measures (integers only, so that engines agree).
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("upper_case", "10 * n_upper > 4 * n_letters"),
    ("marks", "10 * n_marks > 3 * n_words"),
    ("few_distinct_words", f"n_words >= 50 AND 100 * n_fewest_distinct < 8 * least(n_words, {BLOCK})"),
    ("digits", "10 * n_digits > 5 * word_chars"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Policies by version: the rules that reject.
POLICIES = {"v1": ("few_words", "repeated_windows"), "v2": tuple(name for name, _ in RULES)}

_WINDOW = 8
_SYMBOLS, _UPPER, _LETTERS, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), b"0123456789"


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _classes() -> np.ndarray:
    m = np.zeros((256, 6), np.int64)
    m[:, 0] = 1
    m[0x80:0xC0, 0] = 0  # bytes that go on with a character
    m[list(b" \t\n\r\x0b\x0c"), 0] = 0
    for k, members in enumerate((_SYMBOLS, _UPPER, _LETTERS, b"!?", _DIGITS), 1):
        m[list(members), k] = 1
    return m


def measure(raws: list[bytes]) -> np.ndarray:
    """MEASURES of each UTF-8 text, as integers."""
    out = np.zeros((len(raws), len(MEASURES)), np.int64)
    number: dict[bytes, int] = {}
    ids, hist, sizes = [], np.zeros((len(raws), 256), np.int64), np.zeros(len(raws), np.int64)
    for i, raw in enumerate(raws):
        words = raw.split()
        sizes[i] = len(words)
        if not words:
            continue
        hist[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        mine = [number.setdefault(w, len(number)) for w in words]
        ids += mine
        lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
        out[i, 3], out[i, 5], out[i, 9] = len(lines) - len(set(lines)), len(lines), len(set(mine))
        # blocks lie end to end, the last one ends with the text
        out[i, 11] = min(len(set(mine[at : at + BLOCK])) for at in {*range(0, len(mine) - BLOCK, BLOCK), max(0, len(mine) - BLOCK)})
    got = hist @ _classes()
    out[:, 0], out[:, 1], out[:, 2], out[:, 6], out[:, 7], out[:, 8], out[:, 10] = sizes, *(got[:, k] for k in range(6))
    if len(ids) > _WINDOW:
        # a window's value: the sum of random 64-bit values of its words, each turned by its place
        value = np.random.default_rng(8).integers(0, 2**64, len(number), np.uint64)[np.array(ids)]
        n = len(ids) - _WINDOW + 1
        window = np.zeros(n, np.uint64)
        for k in range(_WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + value[k : n + k]
        doc = np.repeat(np.arange(len(raws)), sizes)
        whole = np.flatnonzero(doc[:n] == doc[_WINDOW - 1 :])
        if not len(whole):
            return out
        window = window[whole] ^ (doc[whole].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        at = whole[order[np.r_[False, same] | np.r_[same, False]]]
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + _WINDOW, -1)
        out[:, 4] = np.bincount(doc, np.cumsum(change)[:-1] > 0, len(raws))
    return out


def ledger(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the measures, and ``failures``: a bit for each rule of RULES that the text fails.

    A null text is an empty one. Null keys and repeated rows stay; one row in, one row out, no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 300):
            got = measure(raw_texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(MEASURES)))], names=[key, *MEASURES])

    measured = docs.select(F.col(key), F.col(text)).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{m} long" for m in MEASURES)]))
    return measured.withColumn("failures", F.expr(" | ".join(f"if({rule}, {BIT[name]}L, 0L)" for name, rule in RULES)))


def apply_policy(rows: DataFrame, policy: str, *, to: str = "kept") -> DataFrame:
    """``rows`` of a ledger with the verdict of a policy."""
    return rows.withColumn(to, F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """For each policy and rule: documents that fail the rule, that only this rule rejects, and that the policy rejects.

    The rows are first counted by bitmask, of which there are at most 2 to the number of rules.
    """
    counted = rows.groupBy("failures").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(mask(p)).alias("mask"), F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for p in policies for name in POLICIES[p]])
    each = counted.select("failures", "n", F.explode(rules).alias("r")).select("failures", "n", "r.*")
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("policy", "rule").agg(of(F.col("failures").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), of(hit == F.col("bit")).alias("n_only"), of(hit != 0).alias("n_rejected"))


def judged(docs: DataFrame, *, policy: str = "v2") -> DataFrame:
    """The contract's columns for each row, and ``failures``."""
    rows = apply_policy(ledger(docs), policy, to="verdict")
    failed = F.col("failures").bitwiseAND(F.lit(mask("v1"))) != 0
    return rows.select("doc_id", *MEASURES[:5], failed.alias("base_failed"), (~failed & F.col("verdict")).alias("kept"), "failures")


_DUCK = {
    "n_upper": "[A-Z]", "n_letters": "[A-Za-z]", "n_marks": "[!?]", "n_digits": "[0-9]", "n_symbols": "[#*$%&|<>]",
}
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS v FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM g) WHERE c > 1),
p AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM h, range(8) q(k) GROUP BY r),
m AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        {", ".join(f"len(regexp_extract_all(t, '{p}'))::BIGINT AS {n}" for n, p in _DUCK.items())},
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        list_min(list_transform(list_concat(range(0, greatest(len(w) - {BLOCK}, 0), {BLOCK}), [greatest(len(w) - {BLOCK}, 0)]), lambda s: len(list_distinct(w[s + 1:s + {BLOCK}]))))::BIGINT AS n_fewest_distinct
      FROM d LEFT JOIN l USING (r) LEFT JOIN p USING (r)),
f AS (SELECT *, ({" | ".join(f"CASE WHEN {rule} THEN {BIT[name]}::BIGINT ELSE 0::BIGINT END" for name, rule in RULES)}) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {mask("v1")}) <> 0 AS base_failed,
  (failures & {mask("v1")}) = 0 AND (failures & {mask("v2")}) = 0 AS kept, failures FROM f
"""
