"""Matching and counting: lookups, priorities, ranking, dedupe, modes, medians."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as tx

# --- lookups ---------------------------------------------------------------------------


def key_letters(questions: DataFrame, keys: DataFrame, *, number: str = "n") -> DataFrame:
    """Each question with its key's cell, and the answer as an index.

    A cell of several letters or X has no single answer: null. A number past the key: null.
    """
    joined = questions.join(keys.select("year", "code", "set", "letters"), ["year", "code", "set"], "left").withColumn("cell", F.get("letters", F.col(number) - 1))
    at = F.instr(F.lit("ABCD"), F.col("cell")) - 1
    return joined.withColumn("answer", F.when((F.length("cell") == 1) & (at >= 0), at)).drop("letters")


def known(rows: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key the parent holds."""
    return rows.join(parent.select(F.col(parent_key).alias(key)), key, "left_semi")


def unknown(rows: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key the parent lacks; a null key is unknown."""
    return rows.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def fill_missing(rows: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Null values filled from a lookup; what is there stays."""
    joined = rows.join(found.select(*keys, F.col(value).alias("_found")), keys, "left")
    return joined.withColumn(value, F.coalesce(value, "_found")).drop("_found")


def by_priority(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key by ``order``, which should end in a sequence column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def first_link(papers: DataFrame, links: DataFrame, rule: Column) -> DataFrame:
    """For each paper (year, code) the first link by name that ``rule`` accepts (over year, code, href).

    A rule join: the links are the small side, and are broadcast only by the planner's own size check.
    """
    return papers.join(links, rule).groupBy("year", "code").agg(F.min("href").alias("href"))


def overridden(rows: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """Values that a person read win over computed ones."""
    return rows.join(overrides.select(key, F.col(value).alias("_read")), key, "left").withColumn(value, F.coalesce("_read", value)).drop("_read")


def reviewed(draft: DataFrame, review: DataFrame, *, columns: Iterable[str] = ("topic", "q", "options", "passage")) -> DataFrame:
    """A draft with a person's decisions by number: status unread, skipped, kept or added; fields of the review win."""
    r = review.select("n", F.coalesce("skip", F.lit(False)).alias("_skip"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_seen"))
    j = draft.withColumn("_drafted", F.lit(True)).join(r, "n", "full_outer")
    status = F.when(F.col("_seen").isNull(), "unread").when(F.col("_skip"), "skipped").when(F.col("_drafted").isNull(), "added").otherwise("kept")
    out = j.withColumn("status", status)
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)) if c in draft.columns else F.col(f"_{c}"))
    return out.drop("_skip", "_seen", "_drafted", *[f"_{c}" for c in columns])


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio; null counts as empty."""
    return SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def aligned_readings(left: DataFrame, right: DataFrame, *, on: str = "n", text: str = "q", agree: float = 0.72, head: int = 400) -> DataFrame:
    """Two readings of the same paper, aligned by number: agree, differ, only_left, only_right, with the ratio.

    The equi join comes first, so the ratio is taken once for each aligned pair only.
    """
    cut = lambda c: F.substring(tx.fold_alnum(c), 1, head)
    a = left.select(F.col(on), cut(F.col(text)).alias("_a"), F.lit(1).alias("_in_a"))
    b = right.select(F.col(on), cut(F.col(text)).alias("_b"), F.lit(1).alias("_in_b"))
    j = a.join(b, on, "full_outer").withColumn("ratio", F.when(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull(), _similarity("_a", "_b")))
    verdict = F.when(F.col("_in_b").isNull(), "only_left").when(F.col("_in_a").isNull(), "only_right").when(F.col("ratio") >= agree, "agree").otherwise("differ")
    return j.select(on, "ratio", verdict.alias("verdict"))


def worst(readings: DataFrame, limit: int = 12) -> DataFrame:
    """The disagreements of lowest ratio."""
    return readings.filter("verdict = 'differ'").orderBy("ratio", "n").limit(limit)


def carried_passage(rows: DataFrame, *, group: str, number: str = "n", header: str = "pid", count: str = "items") -> DataFrame:
    """The most recent passage header, for as many numbers as its directions name."""
    w = Window.partitionBy(group).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(header).isNotNull(), F.struct(F.col(header).alias("pid"), F.col(number).alias("at"), F.col(count).alias("items"))), ignorenulls=True).over(w)
    return rows.withColumn("_last", last).withColumn("passage", F.when(F.col(number) < F.col("_last.at") + F.col("_last.items"), F.col("_last.pid"))).drop("_last")


def start_pages(questions: DataFrame, lines: DataFrame, *, chars: int = 12) -> DataFrame:
    """The page of the first line that carries a question's number and begins as its stem does."""
    p = r"^\s*([0-9]{1,2})[.,]\s+(\S.{0,30})"
    numbered = lines.select(F.regexp_extract("line", p, 1).alias("_n"), F.trim(F.substring(F.regexp_extract("line", p, 2), 1, chars)).alias("_head"), "idx", "page").filter("_n != ''").withColumn("n", F.col("_n").cast("int"))
    found = questions.join(numbered, "n").filter(F.startswith("q", F.col("_head")))
    return found.groupBy("n").agg(F.min_by("page", "idx").alias("page"))


def merged_answers(explained: DataFrame, table: DataFrame) -> DataFrame:
    """Answers of explanations, and of the key table where an explanation is missing."""
    j = explained.join(table.select("n", F.col("answer").alias("_table")), "n", "full_outer")
    also = F.array_compact(F.concat(F.coalesce("also", F.expr("cast(array() as array<string>)")), F.array("_table")))
    return j.select("n", F.coalesce("answer", "_table").alias("answer"), also.alias("also"))


# --- aggregates --------------------------------------------------------------------------


def modes(rows: DataFrame, group: list[str], value: str, seq: str) -> DataFrame:
    """A3: the most frequent value of each group; of equals, the one met first."""
    counted = rows.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(seq).alias("_first"))
    return by_priority(counted, group, F.col("n").desc(), "_first").drop("_first")


def range_of(rows: DataFrame, value: str, ranges: int = 256) -> Callable[[Column], Column]:
    """A function from a numeric value to its range, of ``ranges`` that hold about as many rows each.

    The bounds come from approximate quantiles, so they only place rows; at most ``ranges`` numbers reach the driver.
    """
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(rows.filter(F.col(value).isNotNull()).approxQuantile(value, shares, 0.5 / ranges)))
    bounds = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.expr("cast(array() as array<double>)")
    return lambda v: F.size(F.filter(bounds, lambda c: c < v))


def upper_medians(rows: DataFrame, group: str, value: str, *, least: int = 3) -> DataFrame:
    """A5: the upper median of each group's values; the whole table's for groups of under ``least``. Null values don't count.

    Distinct values are counted, counts are summed by range of values, and only the range that holds the median is put in
    order, so neither a large group nor the whole table is sorted in one task.
    """
    rows = rows.filter(F.col(value).isNotNull())
    place = range_of(rows, value)

    def median(df: DataFrame, keys: list[str]) -> DataFrame:
        counts = df.groupBy(*keys, value).agg(F.count("*").alias("n")).withColumn("_range", place(F.col(value)))
        run = Window.partitionBy(*keys).orderBy("_range")
        sums = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("_sum"))
        sums = sums.withColumns({"_upto": F.sum("_sum").over(run), "_all": F.sum("_sum").over(Window.partitionBy(*keys))})
        held = sums.filter((F.col("_upto") > F.floor(F.col("_all") / 2)) & (F.col("_upto") - F.col("_sum") <= F.floor(F.col("_all") / 2)))
        named = held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_r"), (F.col("_upto") - F.col("_sum")).alias("_before"), "_all")
        same = F.col("_range") == F.col("_r")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        inside = counts.join(named, same)
        at = F.col("_before") + F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy(value))
        return inside.withColumn("_at", at).filter(F.col("_at") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias("median"), F.first("_all").alias("n"))

    own = median(rows, [group])
    whole = median(rows.withColumn("_one", F.lit(1)), ["_one"]).select(F.col("median").alias("_whole"))
    return own.crossJoin(F.broadcast(whole)).select(group, F.when(F.col("n") >= least, F.col("median")).otherwise(F.col("_whole")).alias("median"))


def numbered(rows: DataFrame, key: str, seq: str, *, to: str = "k") -> DataFrame:
    """``rows`` with their place within their key, from 1, in order of the numeric ``seq`` (distinct within a key; no nulls).

    Places are counted by range of ``seq`` first, then within a range, so a key with many rows is spread over tasks.
    """
    placed = rows.withColumn("_range", range_of(rows, seq)(F.col(seq)))
    counts = placed.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_range")) - F.col("_n")
    ahead = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(seq))
    joined = placed.join(ahead, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(to, F.col("_before") + inside).drop("_key", "_r", "_range", "_before")


def previous(rows: DataFrame, key: str, seq: str, value: str, *, to: str) -> DataFrame:
    """``rows`` with ``value`` of the row before them within their key, in order of the numeric ``seq`` (no nulls); null for the first.

    Rows look back inside a range of ``seq``; the first of a range gets the last value of the ranges before it, which come from one
    row for each key and range, so a key with many rows is spread over tasks.
    """
    placed = rows.withColumn("_range", range_of(rows, seq)(F.col(seq)))
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(key, "_range").orderBy(seq))
    lasts = placed.groupBy(key, "_range").agg(F.max_by(F.struct(F.col(value).alias("v")), seq).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(key).orderBy("_range"))
    ahead = lasts.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), before.alias("_ahead"))
    joined = placed.withColumn("_inside", inside).join(ahead, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(to, F.coalesce("_inside", "_ahead")["v"]).drop("_key", "_r", "_range", "_inside", "_ahead")


def missing_numbers(rows: DataFrame, group: str, number: str, last: Column) -> DataFrame:
    """Numbers from 1 to ``last`` (an aggregate over the group) that a group lacks."""
    want = rows.groupBy(group).agg(last.alias("_last")).select(group, F.explode(F.sequence(F.lit(1), F.greatest("_last", F.lit(1)))).alias(number))
    return want.join(rows.select(group, F.col(number).cast("int").alias(number)), [group, number], "left_anti")


def best_copies(rows: DataFrame, key: str, body: str, seq: str) -> DataFrame:
    """Of several copies of a key the one with the larger share of Latin letters, the first of equals."""
    return rows.groupBy(key).agg(F.max_by(body, F.struct(tx.latin_share(F.col(body)), -F.col(seq))).alias(body))


def fill_rates(rows: DataFrame, group: str, value: str) -> DataFrame:
    """How many rows of a group have a value."""
    return rows.groupBy(group).agg(F.count_if(F.col(value).isNotNull()).alias("got"), F.count("*").alias("total"))


def gaps(rows: DataFrame, group: str, value: str, label: str) -> DataFrame:
    """Labels of a group's rows without a value, listed."""
    return rows.filter(F.col(value).isNull()).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(label)), ", ").alias("gaps"))


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps' entries, the right one's where both have a key."""
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(b, a))


def years_down(rows: DataFrame, group: str, year: str) -> DataFrame:
    """A group's years, newest first."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_set(year), False).alias("years"))


def nested_counts(topics: DataFrame, group: str, array: str) -> DataFrame:
    """A1: rows and members of their arrays, for each group."""
    return topics.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size(array), F.lit(0))).alias("members"))


def number_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A10: keys with where they are: both, left or right."""
    j = left.select(key, F.lit(1).alias("_l")).distinct().join(right.select(key, F.lit(1).alias("_r")).distinct(), key, "full_outer")
    return j.select(key, F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both").alias("side"))


# --- ranking by rare terms -----------------------------------------------------------------


def term_bags(topics: DataFrame, *, key: str = "id", weighted: Iterable[tuple[str, int]] = (("name", 3), ("subject", 1), ("subtopics", 1))) -> DataFrame:
    """(topic, term, tf) with each field's terms at its weight; ``subtopics`` may be an array."""
    parts = None
    for field, weight in weighted:
        text = F.col(field) if topics.schema[field].dataType.simpleString() == "string" else F.array_join(field, " \n ")
        got = topics.select(F.col(key).alias("topic"), F.explode(tx.terms(text)).alias("term"), F.lit(weight).alias("w"))
        parts = got if parts is None else parts.unionByName(got)
    return parts.groupBy("topic", "term").agg(F.sum("w").alias("tf"))


#: Weights of terms for topics up to which ranking sends them to every task and shuffles nothing.
SMALL_BAGS = 1_000_000


def rank_topics(queries: DataFrame, bags: DataFrame, topics: int | DataFrame, *, key: str = "id", text: str = "text", top: int = 3, subject: str | None = None, small: int = SMALL_BAGS) -> DataFrame:
    """The best topics of each text by shared rare terms, with the lead over the runner-up.

    score = sum over shared terms of min(count, 3) * ln(1 + tf) * idf, added from the largest down, so that neither the order of
    words nor that of rows decides its last bit; equal scores (to nine decimals) in order of the topic's id. With ``subject`` (a column of queries that may be null) only topics whose
    id begins with it compete. ``weak``: score under 8, or a lead under 1.25. Terms of idf 0 are dropped first.

    While the topics' weights are at most ``small`` in number they go to every task, and a text is ranked where it stands;
    beyond, counts and weights meet by term.
    """
    n = F.lit(topics) if isinstance(topics, int) else F.col("_topics")
    counted = bags if isinstance(topics, int) else bags.crossJoin(F.broadcast(topics.agg(F.count("*").alias("_topics"))))
    rare = counted.groupBy("term").agg(F.greatest(F.lit(0.0), F.log(F.first(n) / (1 + F.count("*")))).alias("idf")).filter("idf > 0")
    live = bags.join(rare, "term").select("term", "topic", F.log(1 + F.col("tf")).alias("w"), "idf")
    hint = F.col(subject) if subject else F.lit(None).cast("string")
    held = live.limit(small + 1).toArrow()
    if held.num_rows <= small:
        return _ranked_in_place(queries.select(F.col(key), hint.alias("_subject"), tx.terms(F.col(text)).alias("_terms")), held.to_pydict(), key, top)
    q = queries.select(F.col(key).alias("_id"), hint.alias("_subject"), F.explode(tx.terms(F.col(text))).alias("term")).groupBy("_id", "_subject", "term").agg(F.least(F.count("*"), F.lit(3)).alias("c"))
    j = q.join(live, "term").filter(F.col("_subject").isNull() | F.col("topic").startswith(F.concat(F.col("_subject"), F.lit("-"))))
    shares = F.sort_array(F.collect_list(F.col("c") * F.col("w") * F.col("idf")), False)
    scored = j.groupBy("_id", "topic").agg(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x).alias("score")).filter("score > 0")
    order = Window.partitionBy("_id").orderBy(F.round("score", 9).desc(), "topic")
    scored = scored.withColumns({"rank": F.row_number().over(order), "_next": F.lead("score").over(order)}).filter(F.col("rank") <= top)
    lead = F.coalesce(F.col("score") / F.col("_next"), F.lit(9.9))
    weak = (F.col("score") < 8) | (lead < 1.25)
    return scored.select(F.col("_id").alias(key), "rank", "topic", "score", F.when(F.col("rank") == 1, lead).alias("lead"), F.when(F.col("rank") == 1, weak).alias("weak"))


def _ranked_in_place(queries: DataFrame, live: dict[str, list], key: str, top: int) -> DataFrame:
    """``rank_topics`` of (key, _subject, _terms) by weights (term, topic, w, idf)."""
    topics = sorted(set(live["topic"]))
    at = {t: k for k, t in enumerate(topics)}
    weights: dict[str, list[tuple[int, float, float]]] = {}
    for term, topic, w, idf in zip(live["term"], live["topic"], live["w"], live["idf"]):
        weights.setdefault(term, []).append((at[topic], w, idf))
    kind = queries.schema[key].dataType.simpleString()
    schema = pa.schema([("rank", pa.int32()), ("topic", pa.string()), ("score", pa.float64()), ("lead", pa.float64()), ("weak", pa.bool_())])

    def ranked(subject: str | None, terms: list[str]) -> Iterator[tuple]:
        shares: dict[int, list[float]] = {}
        for term, n in Counter(t for t in terms if t in weights).items():
            for k, w, idf in weights[term]:
                shares.setdefault(k, []).append(min(n, 3) * w * idf)
        scores: dict[int, float] = {}
        for k, found in shares.items():
            if subject is None or topics[k].startswith(f"{subject}-"):
                scores[k] = 0.0
                for x in sorted(found, reverse=True):  # not sum(), which compensates
                    scores[k] += x
        best = sorted((-round(v, 9), k) for k, v in scores.items() if v > 0)[: top + 1]
        for rank, (_, k) in enumerate(best[:top], 1):
            lead = (scores[k] / scores[best[1][1]] if len(best) > 1 else 9.9) if rank == 1 else None
            yield rank, topics[k], scores[k], lead, None if lead is None else scores[k] < 8 or lead < 1.25

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, owner = [], []
            for i, (subject, terms) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                found = list(ranked(subject, terms or []))
                rows += found
                owner += [i] * len(found)
            made = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema).to_batches() or [pa.RecordBatch.from_pylist([], schema)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *pa.Table.from_batches(made).combine_chunks().to_batches()[0].columns] if rows else [b.column(0).slice(0, 0), *made[0].columns], names=[key, *schema.names])

    return queries.mapInArrow(run, f"`{key}` {kind}, rank int, topic string, score double, lead double, weak boolean")


def duplicates_of(rows: DataFrame, identity: Column, key: str, seq: str) -> DataFrame:
    """Rows whose identity an earlier row has, with that first row's key. Null identities are equal.

    Identities travel as hashes, and first rows are aggregated before the exchange, so neither
    long texts nor a large group of copies burdens one task.
    """
    marked = rows.withColumn("_identity", F.coalesce(F.sha2(identity.cast("binary"), 256), F.lit("null")))
    firsts = marked.groupBy("_identity").agg(F.min(F.struct(F.col(seq).alias("s"), F.col(key).alias("k"))).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    joined = marked.join(firsts.select("_identity", "_first"), "_identity").filter(F.col(seq) > F.col("_first.s"))
    return joined.withColumn("first_of", F.col("_first.k")).drop("_identity", "_first")


def listed_last(rows: DataFrame, last: Column, seq: str) -> DataFrame:
    """Rows in order of ``seq``, those for which ``last`` is true after the others."""
    return rows.orderBy(F.coalesce(last, F.lit(False)), seq)

