"""Mixing sources to target weights by weighted fair queueing.

Each document, in a shuffled order of its source, gets a virtual finish time: the
source's cumulative words divided by the source's target. Taking documents in order
of finish time until the budget is used up serves every source in proportion to
its target. A source whose target exceeds its size goes round again, up to
``most`` times.

No step gathers a source: the running sums go over hash ranges of each source
(sums of ranges, then sums inside a range), and the cut in virtual time is found
from a histogram of finish times, refined twice, of at most 4097 rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, free_name, hashable, row_identity, written

#: Hash ranges of each source.
RANGES = 4096
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
_STEPS, _MOST_STEPS, _SUB = 1024, 4096, 4096


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, *, most: int = 3) -> DataFrame:
    """source, src (rank), source_size, total, target: shares by weight, stopped at ``most`` times the size.

    Sources by code point, null last, weigh 1, 2, 3, repeating. The level at which
    the rest is shared is found by sorting sources by size over weight, once.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("src", rank)
    s = s.withColumn("weight", (F.col("src") - 1) % 3 + 1)
    order = Window.orderBy((F.lit(most) * F.col("source_size") / F.col("weight")).asc(), "src")
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything))
    before = F.sum("source_size").over(order) - F.col("source_size")
    lighter = F.sum("weight").over(order) - F.col("weight")
    s = s.withColumn("level", (F.col("total") - F.lit(most) * before).cast("double") / (F.sum("weight").over(everything) - lighter).cast("double"))
    s = s.withColumn("place", F.row_number().over(order))
    free = F.lit(most) * F.col("source_size") >= F.col("level") * F.col("weight")
    s = s.withColumn("level", F.min_by(F.when(free, F.col("level")), F.when(free, F.col("place"))).over(everything))
    return s.select("source", "src", "source_size", "total", F.least((F.lit(most) * F.col("source_size")).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _cut(copies: DataFrame, budget: int) -> tuple[int, int, float, int]:
    """Where virtual time stops: bucket, sub-bucket, and the last (finish, src) inside it that the budget holds."""

    def stop(rows: list, left: int, last: int) -> tuple[int, int]:
        for r in sorted(rows):
            if r[1] > left:
                return r[0], left
            left -= r[1]
        return last, left

    b, left = stop(copies.groupBy("vb").agg(F.sum("size")).collect(), budget, _MOST_STEPS + 1)
    inside = copies.filter(F.col("vb") == b)
    sb, left = stop(inside.groupBy("sb").agg(F.sum("size")).collect(), left, _SUB)
    run = F.sum("size").over(Window.orderBy("finish", "src"))
    end = inside.filter(F.col("sb") == sb).select("finish", "src", run.alias("run")).filter(F.col("run") <= left).agg(F.max(F.struct("finish", "src")).alias("m")).first().m
    return b, sb, (end.finish if end else float("-inf")), (end.src if end else 0)


def mixed(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", most: int = 3) -> DataFrame:
    """doc_id, row_key, size, source_size, target, taken for each row of ``docs``; taken counts repeats.

    Nulls: a null text has size 0, a null source is a source, a null key is shuffled
    as the empty text. Rows of size 0 are never taken. Repeated rows count each.
    Empty table: no rows. The order is fixed by md5 of the key and the row's identity, so rows of one key are spread,
    only rows equal in key, source and text tie, and reruns agree.
    """
    narrow = written(docs.select(F.col(key).alias("doc_id"), row_identity(key, source, text).alias("row_key"), F.col(source).alias("source"), words(text).alias("size")), "mix-sizes")
    per_source = written(source_targets(narrow, most=most), "mix-sources")
    few = per_source.count() <= BROADCAST_SOURCES
    first = per_source.select("total").first()
    d = narrow.withColumnRenamed("source", "s").join(F.broadcast(per_source) if few else per_source, F.col("s").eqNullSafe(F.col("source"))).drop("s", "source", "total")
    d = d.withColumn("order", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lower(F.hex("row_key"))).cast("binary")))
    d = d.withColumn("range", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    sums = d.groupBy("src", "range").agg(F.sum("size").alias("sum"))
    ahead = sums.select("src", "range", (F.sum("sum").over(Window.partitionBy("src").orderBy("range")) - F.col("sum")).alias("ahead"))
    inside = F.sum("size").over(Window.partitionBy("src", "range").orderBy("order", "size", "row_key").rowsBetween(Window.unboundedPreceding, 0))
    d = written(d.join(ahead, ["src", "range"]).withColumn("cum", F.col("ahead") + inside).select("doc_id", "row_key", "size", "source_size", "target", "src", "cum"), "mix-order")

    finish = [F.try_divide((F.lit(e) * F.col("source_size") + F.col("cum")).cast("double"), F.col("target")) for e in range(most)]
    live = d.filter((F.col("size") > 0) & (F.col("target") > 0))

    def placed(f: Column) -> tuple[Column, Column]:
        vb = F.least(F.floor(f * _STEPS), F.lit(_MOST_STEPS)).cast("long")
        return vb, F.least(F.floor((f * _STEPS - vb) * _SUB), F.lit(_SUB - 1)).cast("long")

    copies = live.select("size", "src", F.explode(F.array(*finish)).alias("finish"))
    vb, sb = placed(F.col("finish"))
    copies = copies.withColumns({"vb": vb, "sb": sb})
    b, s, f_end, src_end = _cut(copies, first.total or 0) if first else (0, 0, 0.0, 0)

    def took(f: Column) -> Column:
        v, w = placed(f)
        last = (v == b) & (w == s) & ((f < F.lit(f_end)) | ((f == F.lit(f_end)) & (F.col("src") <= src_end)))
        return F.when((F.col("target") > 0) & ((v < b) | ((v == b) & (w < s)) | last), F.col("size")).otherwise(F.lit(0))

    taken = sum((took(f) for f in finish), F.lit(0))
    return d.select("doc_id", "row_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixture(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", most: int = 3) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all their columns, and ``mix_copies``: how often each is taken.

    Rows equal in key, source and text are told apart by number, in the order of a hash of all their columns.
    """
    row, nth, share, to = (free_name(docs, n) for n in ("mix_row", "mix_nth", "mix_shares", "mix_copies"))
    shares = mixed(docs, text=text, key=key, source=source, most=most).filter("taken > 0")
    shares = shares.groupBy(F.col("row_key").alias(row)).agg(F.array_sort(F.collect_list(F.try_divide("taken", "size").cast("int"))).alias(share))
    order = F.row_number().over(Window.partitionBy(row).orderBy(F.xxhash64(*hashable(docs))))
    rows = docs.withColumn(row, row_identity(key, source, text)).withColumn(nth, order)
    joined = rows.join(shares, row).withColumn(to, F.get(share, F.col(nth) - 1))
    return joined.filter(F.col(to) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], to)


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(length(source) || ':' || source, '-') || coalesce(length(text) || ':' || text, '-')) AS i,
         md5(coalesce(doc_id::VARCHAR, '') || i) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS src FROM d GROUP BY source),
w AS (SELECT *, (src - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, row_number() OVER o AS place,
        ((sum(source_size) OVER () - 3 * (sum(source_size) OVER o - source_size))::DOUBLE
          / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY 3 * source_size / weight::DOUBLE, src)),
v AS (SELECT min_by(level, place) AS level FROM l WHERE 3 * source_size >= level * weight),
t AS (SELECT source, src, source_size, total, least((3 * source_size)::DOUBLE, v.level * weight) AS target FROM l, v),
c AS (SELECT doc_id, size, source_size, target, total, src,
        (sum(size) OVER (PARTITION BY src ORDER BY k, size, i ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, row_number() OVER () AS id FROM c),
x AS (SELECT *, (e * source_size + cum)::DOUBLE / target AS finish FROM r, (VALUES (0), (1), (2)) q(e) WHERE size > 0 AND target > 0),
y AS (SELECT id, size FROM (SELECT *, sum(size) OVER (ORDER BY finish, src ROWS UNBOUNDED PRECEDING) AS run FROM x) WHERE run <= total),
z AS (SELECT id, sum(size)::BIGINT AS taken FROM y GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM r LEFT JOIN z USING (id)
"""
