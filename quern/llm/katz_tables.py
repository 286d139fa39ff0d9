"""Katz backoff of any order over stored n-gram tables, evaluated recursively per token.

For each order k a table of the n-grams seen in training is stored, partitioned by the n-gram's hash, with its discounted
probability, and one of contexts with their backoff weight. A token's probability is that of its longest seen n-gram, times the
backoff weights of the seen contexts that are longer. Weights are exact: what a context's discounts leave (half a count at
least) over the mass, in the next lower order, of tokens that weren't seen after it; each context sums to one.

``katz.scored`` computes the same for order two in packed rows; this form moves a row for each token and order, which takes
more disk than the check tool grants, but has no limit of order and leaves its tables behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower_sql, crc_mod, written
from quern.llm.katz import TOP, discounts

_START, _END = "\n<s>", "\n</s>"


def _grams(docs: DataFrame, key: str, text: str, held_out: Column, order: int) -> DataFrame:
    """(row, key, held, at, g1..gn, c1..cn): each token's n-gram hashes and their contexts', those shorter than a text padded with a start token."""
    words = F.regexp_extract_all(ascii_lower_sql(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    padded = F.concat(F.array_repeat(F.lit(_START), order - 1), words, F.array(F.lit(_END)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), held_out.alias("held"), padded.alias("w"))
    rows = rows.select("row", "key", "held", "w", F.explode(F.sequence(F.lit(order), F.size("w"))).alias("at"))
    # two hashes tell n-grams apart by 128 bits; one column of both is a row's key
    wide = lambda a: F.concat(F.xxhash64(a).cast("string"), F.lit("."), F.md5(F.array_join(a, " ").cast("binary")))
    gram = lambda k: wide(F.slice("w", F.col("at") - k + 1, F.lit(k)))
    context = lambda k: wide(F.slice("w", F.col("at") - k + 1, F.lit(k - 1)))
    return rows.select("row", "key", "held", "at", *[gram(k).alias(f"g{k}") for k in range(1, order + 1)], *[context(k).alias(f"c{k}") for k in range(2, order + 1)])


def _discount(counts: DataFrame) -> list[float]:
    """Good-Turing's factors for counts 1 to ``TOP``, and 1 above."""
    found = {r.n: r.m for r in counts.filter(F.col("n") <= TOP + 1).groupBy("n").agg(F.count("*").alias("m")).collect()}
    return discounts([0, *(found.get(r, 0) for r in range(1, TOP + 2))]).tolist()


def tables(grams: DataFrame, order: int, parts: int) -> tuple[list[DataFrame], list[DataFrame], float, int, int]:
    """(seen n-grams by order, contexts by order from two on, an unknown token's probability, tokens, types), all stored.

    A table of n-grams: g, n, p. A table of contexts: c, weight.
    """
    train = grams.filter(~F.col("held"))
    store = lambda df, by, what: written(df.repartition(parts, by), what)
    ones = train.groupBy(F.col("g1").alias("g")).agg(F.count("*").alias("n"))
    ones = store(ones, "g", "katz-1-counts")
    total = ones.agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).first()
    tokens, types = total.tokens or 0, total.types or 0
    d = F.array(*[F.lit(x) for x in _discount(ones)])
    kept = F.element_at(d, F.least(F.col("n"), F.lit(TOP + 1)).cast("int") + 1) * F.col("n")
    left = ones.agg(F.sum(F.col("n") - kept).alias("x")).first().x or 0.0
    scale = 1.0 if left >= 0.5 or not tokens else tokens / (tokens + 0.5)
    unknown = (left / tokens if scale == 1.0 else 1.0 - scale * (1 - left / tokens)) if tokens else 1.0
    seen, contexts = [store(ones.select("g", "n", (F.lit(scale) * kept / F.lit(max(tokens, 1))).alias("p")), "g", "katz-1")], []
    for k in range(2, order + 1):
        counts = train.groupBy(F.col(f"g{k}").alias("g")).agg(F.count("*").alias("n"), F.first(f"c{k}").alias("c"), F.first(f"g{k - 1}").alias("lower"))
        counts = store(counts, "g", f"katz-{k}-counts")
        d = F.array(*[F.lit(x) for x in _discount(counts)])
        kept = F.element_at(d, F.least(F.col("n"), F.lit(TOP + 1)).cast("int") + 1) * F.col("n")
        below = seen[-1].select(F.col("g").alias("lower"), F.col("p").alias("q"))
        of = counts.join(below, "lower").groupBy("c").agg(F.sum("n").alias("all"), F.sum(F.col("n") - kept).alias("left"), F.sum("q").alias("mass"))
        of = store(of, "c", f"katz-{k}-contexts")
        weight = (F.col("left") + 0.5) / (F.col("all") + 0.5) / F.greatest(1 - F.col("mass"), F.lit(1e-12))
        contexts.append(of.select("c", weight.alias("weight")))
        seen.append(store(counts.join(of.select("c", "all"), "c").select("g", "n", (kept / (F.col("all") + 0.5)).alias("p")), "g", f"katz-{k}"))
    return seen, contexts, unknown, tokens, types


def scored(docs: DataFrame, *, order: int = 3, key: str = "doc_id", text: str = "text", held_out: Column | None = None, parts: int | None = None) -> DataFrame:
    """The columns of ``katz.scored``, by a model of any order from one on.

    Learns from the rows that aren't ``held_out`` (default: crc32 of the key mod 10 is 0). A null text has one token,
    the end; null keys are kept, repeated rows count each, other columns go; an empty table gives no rows. Nothing to learn from: every score is 0.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held_out = crc_mod(key, 10) == 0 if held_out is None else held_out
    grams = written(_grams(docs, key, text, held_out, order), "katz-grams")
    seen, contexts, unknown, tokens, types = tables(grams, order, parts)
    ones = seen[0].select(F.col("g").alias("g1"), F.col("n").alias("c"), F.col("p").alias("p1"))
    j = grams.join(ones, "g1", "left").withColumn("log", F.log10(F.coalesce("p1", F.lit(unknown))))
    for k in range(2, order + 1):  # the recursion, from the shortest n-gram up: a longer one that was seen decides anew
        own = seen[k - 1].select(F.col("g").alias(f"g{k}"), F.col("p").alias("own"))
        of = contexts[k - 2].select(F.col("c").alias(f"c{k}"), "weight")
        j = j.join(own, f"g{k}", "left").join(of, f"c{k}", "left")
        j = j.withColumn("log", F.coalesce(F.log10("own"), F.col("log") + F.coalesce(F.log10("weight"), F.lit(0.0)))).drop("own", "weight")
    base = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(tokens + 0.1 * (types + 1)))
    out = j.groupBy("row").agg(F.first("key").alias(key), F.first("held").alias("held_out"), F.count("*").alias("n_tokens"), F.count("c").alias("n_known"), F.sum(base).alias("base_score"), F.sum("log").alias("score"))
    return out.select(key, "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
