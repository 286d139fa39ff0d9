"""Constraint, lookup and aggregate queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import dates
from quern.functions import text as tx
from quern.operators import match, quality, sequences
from quern.sources import sinks


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_violations(spark, sf_dir):
    t = {n: _read(spark, sf_dir, n) for n in ("labels", "documents", "orders", "lineitem", "customer", "supplier")}
    found = quality.violations([
        quality.unique(t["lineitem"], ["l_orderkey", "l_linenumber"], "line key", "lineitem"),
        quality.references(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey", "line order", "lineitem"),
        quality.references(t["labels"], "doc_id", t["documents"], "doc_id", "label document", "labels"),
        quality.references(t["documents"], "doc_id", t["labels"], "doc_id", "document label", "documents"),
        quality.within(t["orders"], F.col("o_orderstatus"), ("O", "F"), "order status", "orders", "o_orderkey"),
        quality.check(t["customer"], F.col("c_acctbal") < 0, "balance", "customer", "c_custkey", "negative"),
        quality.check(t["lineitem"], F.col("l_discount") > 0.09, "discount", "lineitem", quality._key("l_orderkey", "l_linenumber"), "too large"),
        quality.check(t["documents"], quality.blank(F.col("text")) | (F.length("text") < 25), "text", "documents", "doc_id", "too short"),
        quality.not_empty(t["supplier"].filter("s_acctbal > 1e9"), "rich suppliers", "supplier"),
    ])
    return found.groupBy("rule", "entity").agg(F.count("*").alias("n"), F.count_if(F.col("key").isNull()).alias("no_key"))


def fk_orphans(spark, sf_dir):
    return match.unknown(_read(spark, sf_dir, "customer"), "c_custkey", _read(spark, sf_dir, "orders"), "o_custkey").select("c_custkey")


def missing_numbers(spark, sf_dir):
    return match.missing_numbers(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.max("l_linenumber") + 1)


def whole_orders(spark, sf_dir):
    return quality.whole_papers(_read(spark, sf_dir, "lineitem"), 4, ["l_orderkey"], "l_linenumber").select("l_orderkey", "rows", "whole")


def priority_merge(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return match.by_priority(events, ["user_id"], order, "event_id").select("user_id", "event_type", "event_id")


def side_of_customers(spark, sf_dir):
    found = match.number_sets(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), "k")
    return found.groupBy("side").agg(F.count("*").alias("n"))


def region_gaps(spark, sf_dir):
    rich = _read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("s"))
    return match.gaps(_read(spark, sf_dir, "nation").join(rich, "n_nationkey", "left"), "n_regionkey", "s", "n_name")


def upper_medians(spark, sf_dir):
    return match.upper_medians(_read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


def order_years(spark, sf_dir):
    years = match.years_down(_read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), "o_orderpriority", "y")
    return years.select("o_orderpriority", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


def worst_orders(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("ratio"), F.lit("differ").alias("verdict"))
    return match.worst(rows).select("n", "ratio")


def free_names(spark, sf_dir):
    files = _read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_mktsegment"), F.lit(".pdf")).alias("name"))
    return sinks.free_names(files, seq="c_custkey").select("c_custkey", "free_name")


def slugs(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


def thousands(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", tx.thousands(F.col("o_orderkey") * 1234).alias("shown"))


def daily_urls(spark, sf_dir):
    days = _read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    url = dates.expand_url(F.lit("https://x.org/{yyyy}/{month}/{mm}-{dd}/{d}"), F.col("day"))
    return days.filter(~dates.skipped(F.col("day"), F.array(F.lit(0), F.lit(3)))).select("day", url.alias("url"))


def exam_days(spark, sf_dir):
    years = _read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return years.select("year", dates.last_sunday_of_may(F.col("year")).alias("exam"), dates.sat_on(F.lit("mains"), F.col("year")).alias("mains"), dates.next_exam(F.make_date(F.col("year"), F.lit(6), F.lit(15))).alias("upcoming"))


def rendered(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    values = F.create_map(F.lit("__NAME__"), F.col("n_name"), F.lit("__KEY__"), F.concat(F.lit("__NAME__"), F.col("n_nationkey").cast("string")))
    text = dates.substitute(F.lit("<b>__NAME__</b> __KEY__ __NONE__."), values)
    return n.select("n_nationkey", text.alias("html"), F.array_join(dates.missing_tokens(F.lit("__NAME__ __NONE__"), values), ",").alias("missing"))


def key_blocks(spark, sf_dir):
    """The return flags of each 32 orders, whole, and the same blocks in another order, with one cell changed in every other bucket."""
    flags = _read(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 32").alias("bucket"), F.struct("l_orderkey", "l_linenumber").alias("at"), "l_returnflag")
    keys = flags.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "l_returnflag"))), lambda s: s["l_returnflag"]), "").alias("a"))
    # the largest block that divides the whole sequence; a sequence that has none is one block
    keys = keys.withColumn("size", F.coalesce(F.array_max(sequences.block_sizes(F.length("a"))), F.length("a")))
    b = F.array_join(F.reverse(sequences.blocks(F.col("a"), F.col("size"))), "")
    b = F.when(F.col("bucket") % 2 == 1, F.overlay(b, F.lit("X"), F.least(F.length("a"), F.lit(7)))).otherwise(b)
    found = keys.select("bucket", "a", "size", b.alias("b"))
    return found.select(
        "bucket", sequences.largest_block(F.col("a"), [F.col("b")]).alias("block"), sequences.blocks_agree(F.col("a"), F.col("b"), F.col("size")).alias("ok"),
        F.array_join(F.transform(sequences.permutation(F.col("a"), F.col("b"), F.col("size")), lambda x: x.cast("string")), ",").alias("perm"), sequences.repeated_blocks(F.col("a"), 5).alias("repeats"),
    )


_FUNCTIONS = (
    quality_violations, fk_orphans, missing_numbers, whole_orders, priority_merge, side_of_customers, region_gaps, upper_medians, order_years, worst_orders,
    free_names, slugs, thousands, daily_urls, exam_days, rendered, key_blocks,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_CHUNKS = lambda v, size: f"list_transform(range(0, length({v}) // {size}), lambda i: substr({v}, (i * {size} + 1)::BIGINT, {size}::BIGINT))"
_MAY = "(make_date({y}, 5, 31) - dayofweek(make_date({y}, 5, 31))::INT)"
ORACLE_SQL = {
    "quality_violations": """SELECT rule, entity, count(*) AS n, 0::BIGINT AS no_key FROM (
        SELECT 'line key' AS rule, 'lineitem' AS entity FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
        UNION ALL SELECT 'line order', 'lineitem' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'label document', 'labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'document label', 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 'order status', 'orders' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
        UNION ALL SELECT 'balance', 'customer' FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 'discount', 'lineitem' FROM lineitem WHERE l_discount > 0.09
        UNION ALL SELECT 'text', 'documents' FROM documents WHERE length(text) < 25
        UNION ALL SELECT 'rich suppliers', 'supplier' FROM supplier HAVING count(CASE WHEN s_acctbal > 1e9 THEN 1 END) = 0) GROUP BY ALL""",
    "fk_orphans": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "missing_numbers": """SELECT w.l_orderkey, w.n::INT AS l_linenumber FROM (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 2)) AS n FROM lineitem GROUP BY l_orderkey) w
        LEFT JOIN lineitem x ON w.l_orderkey = x.l_orderkey AND w.n = x.l_linenumber WHERE x.l_orderkey IS NULL""",
    "whole_orders": "SELECT l_orderkey, count(*) AS rows, count(*) = 4 AND count(DISTINCT l_linenumber) = 4 AND max(l_linenumber) = 4 AND min(l_linenumber) = 1 AS whole FROM lineitem GROUP BY l_orderkey",
    "priority_merge": """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
        CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, event_id) AS k FROM events) WHERE k = 1""",
    "side_of_customers": """SELECT CASE WHEN c_custkey IS NULL THEN 'right' WHEN s_suppkey IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n
        FROM customer FULL JOIN supplier ON c_custkey = s_suppkey GROUP BY ALL""",
    "region_gaps": """SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS gaps FROM nation
        WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY n_regionkey""",
    "upper_medians": "SELECT o_orderpriority, list_sort(list(o_totalprice))[(count(*) // 2 + 1)::INT] AS median FROM orders GROUP BY o_orderpriority",
    "order_years": "SELECT o_orderpriority, string_agg(y::VARCHAR, ',' ORDER BY y DESC) AS years FROM (SELECT DISTINCT o_orderpriority, year(o_orderdate) AS y FROM orders) GROUP BY o_orderpriority",
    "worst_orders": "SELECT o_orderkey AS n, o_totalprice AS ratio FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 12",
    "free_names": """SELECT c_custkey, c_mktsegment || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END || '.pdf' AS free_name
        FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer)""",
    "slugs": "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part",
    "thousands": "SELECT o_orderkey, format('{:,}', o_orderkey * 1234) AS shown FROM orders",
    "daily_urls": """SELECT day, 'https://x.org/' || strftime(day, '%Y') || '/' || lower(strftime(day, '%B')) || '/' || strftime(day, '%m') || '-' || strftime(day, '%d') || '/' || day(day) AS url
        FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders) WHERE dayofweek(day) NOT IN (0, 3)""",
    "exam_days": f"""SELECT year, {_MAY.format(y="year")} AS exam, make_date(year, 9, 1) AS mains, {_MAY.format(y="(year + 1)")} AS upcoming
        FROM (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders)""",
    "rendered": "SELECT n_nationkey, '<b>' || n_name || '</b> __NAME__' || n_nationkey || ' .' AS html, '__NONE__' AS missing FROM nation",
    "key_blocks": f"""WITH s AS (SELECT l_orderkey // 32 AS bucket, string_agg(l_returnflag, '' ORDER BY l_orderkey, l_linenumber, l_returnflag) AS a FROM lineitem GROUP BY ALL),
        d AS (SELECT *, list_filter(range(5, length(a) // 2 + 1), lambda k: length(a) % k = 0) AS sizes FROM s),
        e AS (SELECT *, coalesce(list_max(sizes), length(a)) AS size FROM d),
        r AS (SELECT *, array_to_string(list_reverse({_CHUNKS("a", "size")}), '') AS b0, least(length(a), 7) AS x FROM e),
        t AS (SELECT *, CASE WHEN bucket % 2 = 1 THEN substr(b0, 1, x - 1) || 'X' || substr(b0, x + 1) ELSE b0 END AS b FROM r),
        u AS (SELECT bucket, k, list_sort({_CHUNKS("a", "k")}) = list_sort({_CHUNKS("b", "k")}) AS ok FROM (SELECT bucket, a, b, unnest(sizes) AS k FROM t)),
        v AS (SELECT bucket, max(CASE WHEN ok THEN k END) AS block FROM u GROUP BY bucket)
        SELECT bucket, block::INT AS block, list_sort({_CHUNKS("a", "size")}) = list_sort({_CHUNKS("b", "size")}) AS ok,
        array_to_string(list_transform({_CHUNKS("b", "size")}, lambda y: coalesce(list_position({_CHUNKS("a", "size")}, y), 0)), ',') AS perm,
        (length(a) // 5 - len(list_distinct({_CHUNKS("a", "5")})))::INT AS repeats FROM t LEFT JOIN v USING (bucket)""",
}
