"""Rules, ingestion and lookups over a staged question bank.

The tables are staged from the driver's by expressions that Spark and the SQL read alike (plain SQL over keys,
lists as text with "~"), with faults injected by key; what the rules find is then stated in SQL from those texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import ingest, match, quality


def _stage(spark, sf_dir: str, stage: tuple[str, str, dict[str, str]]) -> DataFrame:
    """Rows of a stage: (table, filter, column -> expression)."""
    table, keep, columns = stage
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(keep).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _cte(stage: tuple[str, str, dict[str, str]]) -> str:
    table, keep, columns = stage
    return f"(SELECT {', '.join(f'{e} AS "{c}"' for c, e in columns.items())} FROM {table} WHERE {keep})"


def _list(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.filter(F.split(c, "~", -1), lambda x: F.lit(True)))


def _some(c: str) -> Column:
    """A list that may be empty: no text, no members."""
    return F.when(F.col(c) == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(c, "~", -1))


# --- questions ---------------------------------------------------------------------------------

QUESTIONS = ("part", "p_partkey >= 0", {
    "seq": "p_partkey",
    "id": "concat('q', CAST(CASE WHEN p_partkey % 50 = 7 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR(20)))",
    "topic": "CASE WHEN p_partkey % 40 = 3 THEN 'zz' ELSE concat('t', CAST(p_partkey % 9 AS VARCHAR(20))) END",
    "q": "CASE WHEN p_partkey % 60 = 11 THEN '  ' WHEN p_partkey % 70 = 20 THEN upper(concat('Which  part is called ', p_name, ' here'))"
         " WHEN p_partkey % 90 = 21 THEN 'Short' ELSE concat('Which part is called ', p_name, ' here', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(' as number ', CAST(p_partkey AS VARCHAR(20))) END) END",
    "options": "CASE p_partkey % 30 WHEN 4 THEN 'x' WHEN 5 THEN 'x~ ~y' WHEN 6 THEN 'x~ x ~y' WHEN 7 THEN 'a~b~c~d~e~f~g' ELSE 'w~x~y~z' END",
    "answer": "CASE p_partkey % 45 WHEN 8 THEN 9 WHEN 9 THEN NULL WHEN 10 THEN -1 ELSE CAST(p_partkey % 2 AS INT) END",
    "passage": "CASE WHEN p_partkey % 20 = 1 THEN concat('p', CAST(p_partkey % 3 AS VARCHAR(20))) ELSE NULL END",
    "year": "CASE WHEN p_partkey % 80 = 13 OR p_partkey % 4 = 2 THEN CAST(2000 + p_partkey % 6 AS INT) ELSE NULL END",
    "series": "substr('ABCDE', CAST(p_partkey % 5 AS INT) + 1, 1)",
    "n": "CAST(p_partkey % 9 AS INT)",
    "source": "CASE WHEN p_partkey % 80 = 13 THEN 'Institute' WHEN p_partkey % 4 = 2 THEN NULL WHEN p_partkey % 80 = 16 THEN ' ' ELSE 'Institute' END",
})
TOPICS = ("region", "r_regionkey >= 0", {"id": "concat('t', CAST(r_regionkey AS VARCHAR(20)))"})
PASSAGES = ("region", "r_regionkey < 2 OR r_regionkey = 4", {"id": "concat('p', CAST(r_regionkey AS VARCHAR(20)))", "text": "CASE r_regionkey WHEN 1 THEN '  ' ELSE concat('About ', r_name) END"})
KEYS = ("nation", "n_nationkey < 20", {
    "year": "CAST(2000 + n_nationkey % 5 AS INT)", "code": "'gs1'", "series": "substr('ABCD', CAST(n_nationkey / 5 AS INT) + 1, 1)",
    "cells": "CASE n_nationkey % 4 WHEN 0 THEN 'A~B~X~CD~D' WHEN 1 THEN 'B~A~C~D~X~AB' WHEN 2 THEN 'A~A' ELSE 'D~C~B~A~A~B~C~D' END",
    "dropped": "CASE WHEN n_nationkey % 7 = 6 THEN 2 WHEN n_nationkey % 7 = 5 THEN NULL ELSE CASE WHEN n_nationkey % 4 < 2 THEN 1 ELSE 0 END END",
})
# 25 nations in five regions: the integer part of a fifth, in either dialect
KEYS[2]["series"] = "CASE WHEN n_nationkey < 5 THEN 'A' WHEN n_nationkey < 10 THEN 'B' WHEN n_nationkey < 15 THEN 'C' ELSE 'D' END"


def _questions(spark, sf_dir) -> DataFrame:
    q = _stage(spark, sf_dir, QUESTIONS)
    paper = F.when(F.col("year").isNotNull(), F.struct("year", F.lit("gs1").alias("code"), F.col("series").alias("set"), "n"))
    source = F.when(F.col("source").isNotNull(), F.struct(F.col("source").alias("name")))
    return q.select("seq", "id", "topic", "q", _list("options").alias("options"), "answer", "passage", paper.alias("paper"), source.alias("source"))


def _keys(spark, sf_dir) -> DataFrame:
    return _stage(spark, sf_dir, KEYS).select("year", "code", F.col("series").alias("set"), _list("cells").alias("letters"), F.col("dropped").alias("dropped_count"))


def _found(parts: list[DataFrame]) -> DataFrame:
    return quality.violations(parts).select("rule", "entity", "key", "message")


def question_faults(spark, sf_dir):
    return _found(quality.question_rules(_questions(spark, sf_dir), _stage(spark, sf_dir, TOPICS), _stage(spark, sf_dir, PASSAGES)))


def paper_tag_faults(spark, sf_dir):
    return _found(quality.paper_tag_rules(_questions(spark, sf_dir), _keys(spark, sf_dir)))


MARKING = ("region", "r_regionkey < 2", {
    "code": "CASE r_regionkey WHEN 0 THEN 'gs1' ELSE 'gs2' END", "questions": "CASE r_regionkey WHEN 0 THEN 5 ELSE 80 END",
    "raw": "CASE r_regionkey WHEN 0 THEN '{\"questions\":5,\"correct\":2,\"wrong\":null,\"total\":10}' ELSE '{\"questions\":80}' END",
})
CODED = (KEYS[0], KEYS[1], KEYS[2] | {"code": "CASE WHEN n_nationkey = 19 THEN 'gs9' ELSE 'gs1' END", "cells": "CASE n_nationkey % 4 WHEN 0 THEN 'A~B~X~CD~D' WHEN 1 THEN 'B~A~C~E~X~AB' WHEN 2 THEN 'A~A' ELSE 'ABCD~C~B~A~XX' END"})


def key_faults(spark, sf_dir):
    keys = _stage(spark, sf_dir, CODED).select("year", "code", F.col("series").alias("set"), _list("cells").alias("letters"), F.col("dropped").alias("dropped_count"))
    return _found(quality.key_rules(_stage(spark, sf_dir, MARKING), keys))


# --- subjects, optionals, copies, daily sources ---------------------------------------------------

SUBJECTS = ("nation", "n_nationkey < 12", {
    "id": "concat('s', CAST(CASE WHEN n_nationkey = 5 THEN 4 ELSE n_nationkey END AS VARCHAR(20)))",
    "raw": "CASE WHEN n_nationkey % 4 = 3 THEN concat('{\"id\":1,\"name\":\"', n_name, '\",\"icon\":null}') ELSE '{\"id\":1,\"name\":null,\"short\":1,\"icon\":1,\"topics\":[]}' END",
})
SUBTOPICS = ("supplier", "s_suppkey >= 0", {
    "id": "concat('t', CAST(CASE WHEN s_suppkey % 10 = 5 THEN s_suppkey - 1 ELSE s_suppkey END AS VARCHAR(20)))",
    "weight": "CASE s_suppkey % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'huge' ELSE 'low' END",
    "papers": "CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'gs1~gs9' ELSE 'gs1~essay' END",
    "subtopics": "CASE s_suppkey % 8 WHEN 0 THEN '' ELSE 'a~b' END",
    "raw": "CASE s_suppkey % 9 WHEN 0 THEN '{\"id\":1,\"name\":1,\"weight\":1}' ELSE '{\"id\":1,\"name\":1,\"weight\":1,\"papers\":1,\"subtopics\":1}' END",
})


def topic_faults(spark, sf_dir):
    topics = _stage(spark, sf_dir, SUBTOPICS).withColumns({"papers": _some("papers"), "subtopics": _some("subtopics")})
    return _found(quality.topic_rules(_stage(spark, sf_dir, SUBJECTS), topics))


OPTIONALS = ("nation", "n_nationkey < 9", {"id": "concat('o', CAST(n_nationkey % 8 AS VARCHAR(20)))", "raw": "CASE n_nationkey % 3 WHEN 0 THEN '{\"id\":1,\"name\":1,\"short\":1,\"icon\":1}' ELSE '{\"id\":1,\"name\":1}' END"})
YEARS = ("nation", "n_nationkey >= 0", {"id": "concat('o', CAST(n_nationkey % 6 AS VARCHAR(20)))", "year": "CAST(2010 + n_nationkey % 4 AS INT)", "codes": "CASE n_nationkey % 5 WHEN 0 THEN 'p1' WHEN 1 THEN 'p2~p1' ELSE 'p1~p2' END"})
SYLLABUS = ("nation", "n_nationkey >= 0", {"id": "concat('o', CAST(n_nationkey AS VARCHAR(20)))", "papers": "CASE n_nationkey % 5 WHEN 0 THEN 'Paper I' ELSE 'Paper I~Paper II' END", "topics": "CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a~ ' ELSE 'a~b' END"})


def optional_faults(spark, sf_dir):
    years = _stage(spark, sf_dir, YEARS).withColumn("codes", _list("codes"))
    syllabus = _stage(spark, sf_dir, SYLLABUS).withColumns({"papers": _list("papers"), "topics": _some("topics")})
    return _found(quality.optional_rules(_stage(spark, sf_dir, OPTIONALS), years, syllabus))


COPIES = ("customer", "c_custkey >= 0", {
    "id": "concat('c', CAST(c_custkey AS VARCHAR(20)))", "name": "CASE WHEN c_custkey % 31 = 4 THEN 'नाम' ELSE c_name END",
    "rank": "CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(c_custkey % 400 AS INT) END", "year": "CASE c_custkey % 5 WHEN 0 THEN NULL ELSE 2000 + c_nationkey % 3 END",
    "subject": "concat('o', CAST(c_nationkey AS VARCHAR(20)))", "publisher": "'P'",
    "url": "concat(CASE c_custkey % 23 WHEN 2 THEN 'http' ELSE 'https' END, '://x.org/', CAST(c_custkey AS VARCHAR(20)))",
    "medium": "CASE c_custkey % 29 WHEN 0 THEN 'Hindi' WHEN 1 THEN 'English' ELSE NULL END",
    "f_paper": "CASE c_custkey % 17 WHEN 1 THEN ' ' ELSE 'I' END",
    "f_url": "CASE c_custkey % 13 WHEN 0 THEN NULL WHEN 1 THEN concat('https://x.org/', CAST(c_custkey AS VARCHAR(20))) ELSE concat('https://x.org/f/', CAST(c_custkey AS VARCHAR(20))) END",
    "raw": "CASE c_custkey % 37 WHEN 0 THEN '{\"name\":1,\"rank\":null}' ELSE '{\"name\":1,\"rank\":null,\"year\":null,\"publisher\":1,\"url\":1}' END",
})
PUBLISHERS = ("nation", "n_nationkey >= 0", {"name": "CASE n_nationkey % 6 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE n_name END", "url": "CASE n_nationkey % 8 WHEN 7 THEN ' ' ELSE 'https://x.org' END"})


def _copies(spark, sf_dir) -> DataFrame:
    files = F.when(F.col("f_url").isNotNull(), F.array(F.struct(F.col("f_paper").alias("paper"), F.col("f_url").alias("url"))))
    return _stage(spark, sf_dir, COPIES).withColumn("files", files).drop("f_paper", "f_url")


def topper_faults(spark, sf_dir):
    return _found(quality.copy_rules(_copies(spark, sf_dir), _stage(spark, sf_dir, PUBLISHERS)))


def optional_copy_faults(spark, sf_dir):
    return _found(quality.copy_rules(_copies(spark, sf_dir), _stage(spark, sf_dir, PUBLISHERS), by_subject=True, subjects=_stage(spark, sf_dir, OPTIONALS)))


DAILY = ("nation", "n_nationkey >= 0", {
    "id": "concat('d', CAST(n_nationkey AS VARCHAR(20)))",
    "url": "CASE n_nationkey % 5 WHEN 0 THEN 'https://x/{yyyy}/{month}/{dd}' WHEN 1 THEN 'https://x/{yyyy}/{mm}' WHEN 2 THEN 'https://x/{yyyy}' WHEN 3 THEN 'https://x/{yyyy}/{mm}/{week}' ELSE 'https://x/{month}' END",
    "skips": "CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0~6' ELSE '3~7' END", "questions": "CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 5 END",
})


def daily_faults(spark, sf_dir):
    daily = _stage(spark, sf_dir, DAILY).withColumn("skips", F.transform(_some("skips"), lambda x: x.cast("int")))
    return _found([*quality.daily_rules(daily), *quality.daily_rules(daily.limit(0))[:1]])


def template_faults(spark, sf_dir):
    template = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.format_string("__%s__ and __KEY__ and __key__", F.translate("n_name", "0123456789", "ABCDEFGHIJ")).alias("text"))
    values = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey < 20").select(F.format_string("__%s__", F.translate("n_name", "0123456789", "ABCDEFGHIJ")).alias("token"))
    return _found([quality.template_tokens(template, values)])


def refused_topics(spark, sf_dir):
    return quality.refused_topics(_questions(spark, sf_dir).select("seq", "topic"), _stage(spark, sf_dir, TOPICS)).select("seq", "topic")


def all_or_nothing(spark, sf_dir):
    """Nothing of a batch with a fault, all of one without."""
    q, topics = _questions(spark, sf_dir).select("seq", "topic"), _stage(spark, sf_dir, TOPICS)
    good = q.join(topics.select(F.col("id").alias("topic")), "topic", "left_semi")
    whole = quality.all_or_nothing(good, quality.refused_topics(good, topics)).withColumn("batch", F.lit("good"))
    none = quality.all_or_nothing(q, quality.refused_topics(q, topics)).withColumn("batch", F.lit("bad"))
    return whole.unionByName(none).select("batch", "seq")


# --- ingestion ----------------------------------------------------------------------------------------


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The batch (odd keys) and the bank (even ones)."""
    q = _questions(spark, sf_dir)
    return q.filter("seq % 2 = 1"), q.filter("seq % 2 = 0")


def judged_batch(spark, sf_dir):
    batch, bank = _halves(spark, sf_dir)
    judged = ingest.judged(batch, bank, _stage(spark, sf_dir, TOPICS), _stage(spark, sf_dir, PASSAGES))
    return judged.select("seq", F.array_join("why", "; ").alias("why"))


def dry_run(spark, sf_dir):
    batch, bank = _halves(spark, sf_dir)
    return ingest.dry_run(ingest.judged(batch, bank, _stage(spark, sf_dir, TOPICS), _stage(spark, sf_dir, PASSAGES)))


def passages_taken(spark, sf_dir):
    batch, bank = _halves(spark, sf_dir)
    passages = _stage(spark, sf_dir, PASSAGES)
    return ingest.used_passages(passages, ingest.taken(ingest.judged(batch, bank, _stage(spark, sf_dir, TOPICS), passages))).select("id")


def passage_conflicts(spark, sf_dir):
    old = _stage(spark, sf_dir, PASSAGES)
    new = spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("concat('p', CAST(r_regionkey AS VARCHAR(20))) AS id", "concat('About ', r_name) AS text")
    return ingest.passage_conflicts(old, new).select("id", "text")


def not_staged_yet(spark, sf_dir):
    q = _questions(spark, sf_dir).filter("paper is not null").select("seq", "paper.year", "paper.code", "paper.n")
    return ingest.not_staged_yet(q.filter("seq % 3 = 0"), q.filter("seq % 3 = 1")).select("seq", "year", "n")


def pending_papers(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    url = F.when(F.col("o_orderkey") % 5 != 0, F.format_string("https://x.org/%d.pdf", "o_orderkey"))
    papers = o.select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("code"), url.alias("url"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("ABCD")).alias("keys"))
    landed = o.filter("o_orderkey % 2 = 0").select(F.format_string("https://x.org/%d.pdf", "o_orderkey").alias("url"), F.format_string("/landed/%d", "o_orderkey").alias("path"))
    return ingest.pending(papers, landed).select("url", "path", "action")


def loaded_in_order(spark, sf_dir):
    """Batches up to the first that fails, here the nation with key 17 (a name later in text order than 1 to 16)."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("batch"), F.when(F.col("n_nationkey") % 4 == 0, "unchanged").otherwise("new").alias("state"))
    done = ingest.run_in_order(n, lambda name: name != "NATION_17")
    return spark.createDataFrame([(k, b) for k, b in enumerate(done)], "place int, batch string")


# --- lookups -------------------------------------------------------------------------------------------


def key_letters(spark, sf_dir):
    q = _questions(spark, sf_dir).filter("paper is not null").select("seq", "paper.*")
    return match.key_letters(q, _keys(spark, sf_dir).drop("dropped_count")).select("seq", "cell", F.col("answer").cast("int").alias("letter"))


def first_links(spark, sf_dir):
    papers = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.year("o_orderdate").alias("year")).distinct().withColumn("code", F.lit("gs1"))
    links = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.format_string("key-%d-%s.pdf", F.col("c_nationkey") + 1990, "c_mktsegment").alias("href"))
    return match.first_link(papers, links, F.contains(F.col("href"), F.col("year").cast("string"))).select("year", "href")


def reviewed_draft(spark, sf_dir):
    q = _stage(spark, sf_dir, QUESTIONS)
    draft = q.filter("seq % 4 <> 3").select(F.col("seq").alias("n"), "topic", "q")
    review = q.filter("seq % 3 = 0").select(F.col("seq").alias("n"), F.when(F.col("seq") % 9 == 0, True).alias("skip"), F.lit("read").alias("topic"), F.lit(None).cast("string").alias("q"))
    return match.reviewed(draft, review, columns=("topic", "q")).select("n", "status", "topic", "q")


def start_pages(spark, sf_dir):
    q = _stage(spark, sf_dir, QUESTIONS).filter("seq between 1 and 99").select(F.col("seq").alias("n"), "q")
    lines = _stage(spark, sf_dir, QUESTIONS).filter("seq between 1 and 99").select(F.concat(F.lit("  "), F.col("seq").cast("string"), F.lit(". "), F.substring("q", 1, 20)).alias("line"), F.col("seq").alias("idx"), F.floor(F.col("seq") / 10).cast("int").alias("page"))
    return match.start_pages(q, lines.unionByName(lines.withColumns({"idx": F.col("idx") + 500, "page": F.col("page") + 50})))


def merged_answers(spark, sf_dir):
    q = _stage(spark, sf_dir, QUESTIONS).select(F.col("seq").alias("n"))
    said = q.filter("n % 3 <> 0").select("n", F.substring(F.lit("abcd"), (F.col("n") % 4 + 1).cast("int"), F.lit(1)).alias("answer"), F.array(F.lit("a")).alias("also"))
    table = q.filter("n % 2 = 0").select("n", F.lit("b").alias("answer"))
    return match.merged_answers(said, table).select("n", "answer", F.array_join("also", ",").alias("also"))


def merged_maps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", (F.col("event_id") % 5).cast("int"))
    of = lambda keep: F.map_from_entries(F.array_sort(F.collect_set(F.when(keep, F.struct("k", F.concat(F.lit("x"), F.col("k").cast("string")).alias("v"))))))
    m = e.groupBy("user_id").agg(of(F.col("event_type") == "view").alias("l"), F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("event_type") == "click", F.struct("k", F.lit("right").alias("v")))))).alias("r"))
    both = F.array_sort(F.map_entries(match.merged_maps(F.col("l"), F.col("r"))))
    return m.select("user_id", F.array_join(F.transform(both, lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"])), ",").alias("merged"))


def ranked_in_subject(spark, sf_dir):
    """The best topics among those of a hinted subject, their lead and whether they are weak."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.format_string("s%d-%06d", F.col("item_id") % 3, F.col("item_id")).alias("id"), F.col("text").alias("name"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("hint", F.when(F.col("doc_id") % 4 < 3, F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string"))))
    bags = match.term_bags(items, weighted=(("name", 3),))
    best = match.rank_topics(docs, bags, items, key="doc_id", subject="hint").filter("rank = 1")
    return best.select("doc_id", "topic", F.round("score", 5).alias("score"), F.round("lead", 5).alias("lead"), "weak")


def listed_last(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit(True)).when(F.col("c_custkey") % 3 == 1, F.lit(False)).alias("login"))
    place = F.monotonically_increasing_id()
    rows = match.listed_last(c, F.col("login"), "c_custkey").withColumn("place", place)
    # the order itself, as how many rows with a smaller key and no sign-in stand after a row: none
    return rows.groupBy("login").agg(F.count("*").alias("n"), F.min_by("c_custkey", "place").alias("first"), F.max_by("c_custkey", "place").alias("last"))


_FUNCTIONS = (
    question_faults, paper_tag_faults, key_faults, topic_faults, optional_faults, topper_faults, optional_copy_faults, daily_faults, template_faults, refused_topics, all_or_nothing,
    judged_batch, dry_run, passages_taken, passage_conflicts, not_staged_yet, pending_papers, loaded_in_order,
    key_letters, reviewed_draft, start_pages, merged_answers, merged_maps, ranked_in_subject, listed_last,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {"rule_links": first_links}

# --- the same in SQL -----------------------------------------------------------------------------------

_FOLD = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_NONE = "[]::VARCHAR[]"


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def _v(rule: str, entity: str, key: str, message: str, rest: str) -> str:
    return f"SELECT '{rule}' AS rule, '{entity}' AS entity, {key} AS key, {message} AS message {rest}"


def _unique(rule: str, entity: str, keys: tuple[str, ...], table: str, where: str = "true") -> str:
    key = " || '|' || ".join(f"coalesce({k}::VARCHAR, 'null')" for k in keys)
    return _v(rule, entity, key, "'occurs ' || count(*) || ' times'", f"FROM {table} WHERE {where} GROUP BY {', '.join(keys)} HAVING count(*) > 1")


def _required(rule: str, entity: str, fields: tuple[str, ...], table: str, key: str = "id") -> str:
    lost = f"list_filter([{', '.join(repr(f) for f in fields)}], lambda f: NOT list_contains(json_keys(raw), f))"
    return _v(rule, entity, key, f"'lacks ' || array_to_string({lost}, ', ')", f"FROM {table} WHERE len({lost}) > 0")


_Q = f"""q AS (SELECT *, string_split(options, '~') AS o, list_transform(string_split(options, '~'), lambda x: trim(x)) AS t FROM {_cte(QUESTIONS)}),
    topics AS {_cte(TOPICS)}, passages AS {_cte(PASSAGES)}"""
_STEM = f"{_FOLD.format('q.q')} || CASE WHEN passage IS NOT NULL THEN ' | ' || coalesce({_FOLD.format('p.text')}, '') ELSE '' END"
_TAG = f"""k AS (SELECT year, code, series, string_split(cells, '~') AS letters, dropped FROM {_cte(KEYS)}),
    j AS (SELECT q.*, k.letters, CASE WHEN q.year NOT IN (SELECT year FROM k) THEN 'no such year' WHEN k.letters IS NULL THEN 'no such set'
        WHEN q.n < 1 THEN 'no such number' WHEN q.n > len(k.letters) THEN 'V16' END AS first, k.letters[q.n] AS cell
      FROM q LEFT JOIN k ON q.year = k.year AND q.series = k.series WHERE q.year IS NOT NULL)"""
_FAULTS = {
    "id already in the bank": "s.id IN (SELECT id FROM b)", "unknown topic": "topic NOT IN (SELECT id FROM topics)", "7 options": "len(o) = 7", "1 options": "len(o) = 1",
    "an option is empty": "len(o) BETWEEN 2 AND 6 AND list_contains(t, '')", "two options are equal": "len(o) BETWEEN 2 AND 6 AND len(list_distinct(t)) < len(o)",
    "answer outside the options": "answer IS NULL OR answer < 0 OR answer >= len(o)", "no text": "trim(q) = ''", "unknown passage": "passage IS NOT NULL AND trim(coalesce(text, '')) = ''",
}
_JUDGED = f"""{_Q},
    n AS (SELECT q.*, p.text, nullif({_STEM.replace("q.q", "q.q").replace("coalesce(" + _FOLD.format("p.text") + ", '')", _FOLD.format("p.text"))}, '') AS stem FROM q LEFT JOIN passages p ON p.id = q.passage),
    m AS (SELECT * REPLACE (coalesce(stem, nullif({_FOLD.format("q")}, '')) AS stem) FROM n),
    b AS (SELECT * FROM m WHERE seq % 2 = 0), s AS (SELECT * FROM m WHERE seq % 2 = 1), a AS (SELECT stem, min(id) AS known FROM b GROUP BY stem),
    w AS (SELECT s.*, list_filter([{", ".join(f"CASE WHEN {c} THEN '{m}' END" for m, c in _FAULTS.items())},
        'already asked as ' || a.known, CASE WHEN year IS NOT NULL AND source IS NOT NULL THEN 'cites a paper and a test series' END,
        CASE WHEN year IS NULL AND trim(coalesce(source, '')) = '' THEN 'no provenance' END], lambda x: x IS NOT NULL) AS own FROM s LEFT JOIN a ON a.stem = s.stem),
    e AS (SELECT *, len(own) = 0 AND EXISTS (SELECT 1 FROM w x WHERE x.id = w.id AND x.seq < w.seq AND len(x.own) = 0) AS again,
        len(own) = 0 AND EXISTS (SELECT 1 FROM w x WHERE x.stem = w.stem AND x.seq < w.seq AND len(x.own) = 0) AS asked FROM w),
    r AS (SELECT *, list_concat(own, list_filter([CASE WHEN again THEN 'id already in the batch' END, CASE WHEN asked THEN 'already asked in the batch' END], lambda x: x IS NOT NULL)) AS why FROM e)"""
_COPY = f"""c AS (SELECT *, list_filter([url, f_url], lambda u: u IS NOT NULL) AS urls FROM {_cte(COPIES)}), p AS {_cte(PUBLISHERS)}"""
_COPY_RULES = _union(
    _required("V25", "copy", ("name", "rank", "year", "publisher", "url"), "c"), _v("V25", "copy", "id", "'not in English'", "FROM c WHERE medium <> 'English'"),
    _v("V25", "copy", "id", "'name in Devanagari'", "FROM c WHERE name = 'नाम'"), _v("V26", "copy", "id", "'a booklet without paper or url'", "FROM c WHERE f_url IS NOT NULL AND trim(f_paper) = ''"),
    _v("V26", "copy", "id", "'the same url twice'", "FROM c WHERE f_url = url"), _v("V26", "copy", "id", "'a url that isn''t https'", "FROM c WHERE url LIKE 'http:%'"),
    _v("V29", "publisher", "coalesce(name, '?')", "'no name or url'", "FROM p WHERE trim(coalesce(name, '')) = '' OR trim(url) = ''"),
)
_RANKED = "rank IS NOT NULL AND rank <> 0"
_IN_TOPICS = "topic IN (SELECT id FROM topics)"

ORACLE_SQL = {
    "question_faults": f"WITH {_Q}, st AS (SELECT seq, q.id, {_STEM} AS stem FROM q LEFT JOIN passages p ON p.id = q.passage WHERE length({_FOLD.format('q.q')}) >= 25) " + _union(
        _unique("V5", "question", ("id",), "q"), _v("V6", "question", "id", "'passage is missing or blank'", "FROM q WHERE passage IS NOT NULL AND passage NOT IN (SELECT id FROM passages WHERE trim(text) <> '')"),
        _v("V7", "question", "id", "'unknown topic ' || topic", "FROM q WHERE topic NOT IN (SELECT id FROM topics)"), _v("V8", "question", "id", "'under two options'", "FROM q WHERE len(o) < 2"),
        _v("V8", "question", "id", "'a blank option'", "FROM q WHERE list_contains(t, '')"), _v("V8", "question", "id", "'two equal options'", "FROM q WHERE len(list_distinct(t)) < len(t)"),
        _v("V9", "question", "id", "'answer outside the options'", "FROM q WHERE answer IS NULL OR answer < 0 OR answer >= len(o)"), _v("V10", "question", "id", "'no text'", "FROM q WHERE trim(q) = ''"),
        _v("V11", "question", "id", "'both paper and source'", "FROM q WHERE year IS NOT NULL AND source IS NOT NULL"), _v("V11", "question", "id", "'source without a name'", "FROM q WHERE trim(source) = ''"),
        _v("V12", "passage", "id", "'no question uses it'", "FROM passages WHERE id NOT IN (SELECT passage FROM q WHERE passage IS NOT NULL)"),
        "SELECT 'V13', 'question', id, 'asked already as ' || b FROM (SELECT id, lag(id) OVER (PARTITION BY stem ORDER BY seq) AS b FROM st) WHERE b IS NOT NULL",
    ),
    "paper_tag_faults": f"WITH {_Q}, {_TAG} " + _union(
        _v("V14", "question", "id", "first", "FROM j WHERE first <> 'V16'"), _unique("V15", "question", ("year", "'gs1'", "series", "n"), "q", "year IS NOT NULL").replace("GROUP BY year, 'gs1', series, n", "GROUP BY year, series, n"),
        _v("V16", "question", "id", "'number ' || n || ' is past the end of the key'", "FROM j WHERE first = 'V16'"), _v("V17", "question", "id", "'the question was dropped'", "FROM j WHERE first IS NULL AND cell = 'X'"),
        _v("V17", "question", "id", "'the key says ' || cell", "FROM j WHERE first IS NULL AND cell <> 'X' AND answer IS NOT NULL AND NOT contains(cell, substr('ABCD', answer + 1, 1))"),
    ),
    "key_faults": f"WITH m AS {_cte(MARKING)}, k AS (SELECT *, string_split(cells, '~') AS l, year || '|' || code || '|' || series AS key FROM {_cte(CODED)}) " + _union(
        _required("V18", "marking", ("questions", "correct", "wrong", "total"), "m", "code"), _v("V18", "key", "code", "'unknown code ' || code", "FROM k WHERE code NOT IN (SELECT code FROM m)"),
        _v("V19", "key", "key", "'length differs from the paper''s'", "FROM k JOIN m USING (code) WHERE len(l) <> questions"),
        _v("V20", "key", "key", "'a cell outside the alphabet'", "FROM k WHERE len(list_filter(l, lambda c: NOT regexp_full_match(c, '[ABCDX]|[ABCD]{2,4}'))) > 0"),
        _v("V21", "key", "key", "'count of dropped questions differs'", "FROM k WHERE dropped <> len(list_filter(l, lambda c: c = 'X'))"),
    ),
    "topic_faults": f"WITH s AS {_cte(SUBJECTS)}, t AS {_cte(SUBTOPICS)} " + _union(
        _required("V1", "subject", ("id", "name", "short", "icon", "topics"), "s"), _required("V1", "topic", ("id", "name", "weight", "papers", "subtopics"), "t"), _unique("V2", "subject", ("id",), "s"), _unique("V2", "topic", ("id",), "t"),
        _v("V3", "topic", "id", "'outside the domain: huge'", "FROM t WHERE weight = 'huge'"), _v("V3", "topic", "id", "'outside the domain: gs9'", "FROM t WHERE papers = 'gs1~gs9'"),
        _v("V4", "topic", "id", "'no papers'", "FROM t WHERE papers = ''"), _v("V4", "topic", "id", "'no subtopics'", "FROM t WHERE subtopics = ''"),
    ),
    "optional_faults": f"WITH o AS {_cte(OPTIONALS)}, y AS {_cte(YEARS)}, s AS {_cte(SYLLABUS)} " + _union(
        _required("V22", "optional", ("id", "name", "short", "icon"), "o"), _unique("V22", "optional", ("id",), "o"), _unique("V22", "optional year", ("id", "year"), "y"),
        _v("V22", "optional year", "id || '|' || year", "'papers aren''t p1 and p2'", "FROM y WHERE codes <> 'p1~p2'"), _v("V23", "syllabus", "id", "'papers aren''t I and II'", "FROM s WHERE papers <> 'Paper I~Paper II'"),
        _v("V23", "syllabus", "id", "'no topics'", "FROM s WHERE topics = ''"), _v("V23", "syllabus", "id", "'a topic without a name'", "FROM s WHERE topics = 'a~ '"),
    ),
    "topper_faults": f"WITH {_COPY} {_COPY_RULES} UNION ALL {_unique('V27', 'copy', ('year', 'rank'), 'c', _RANKED)}",
    "optional_copy_faults": f"WITH {_COPY}, o AS {_cte(OPTIONALS)} {_COPY_RULES} UNION ALL {_unique('V28', 'copy', ('year', 'rank', 'subject'), 'c', _RANKED + ' AND year IS NOT NULL')} UNION ALL "
        + _v("V28", "copy", "id", "'unknown subject ' || subject", "FROM c WHERE subject NOT IN (SELECT id FROM o)"),
    "daily_faults": f"WITH d AS {_cte(DAILY)} " + _union(
        _v("V24", "daily", "'daily'", "'no rows'", ""), _v("V30", "daily", "id", "'no year or no month in the url'", "FROM d WHERE NOT contains(url, '{yyyy}') OR NOT (contains(url, '{month}') OR contains(url, '{mm}'))"),
        _v("V30", "daily", "id", "'an unknown placeholder'", "FROM d WHERE contains(url, '{week}')"), _v("V31", "daily", "id", "'a skip outside 0 to 6'", "FROM d WHERE skips = '3~7'"),
        _v("V31", "daily", "id", "'no questions'", "FROM d WHERE coalesce(questions, 0) < 1"),
    ),
    "template_faults": "WITH t AS (SELECT n_nationkey AS k, '__' || translate(n_name, '0123456789', 'ABCDEFGHIJ') || '__' AS token FROM nation) "
        + _union(_v("V32", "template", "token", "'nothing fills it'", "FROM t WHERE token NOT IN (SELECT token FROM t WHERE k < 20)"), _v("V32", "template", "'__KEY__'", "'nothing fills it'", "")),
    "refused_topics": f"WITH {_Q} SELECT seq, topic FROM q WHERE NOT {_IN_TOPICS}",
    "all_or_nothing": f"WITH {_Q} SELECT 'good' AS batch, seq FROM q WHERE {_IN_TOPICS}",
    "judged_batch": f"WITH {_JUDGED} SELECT seq, array_to_string(why, '; ') AS why FROM r",
    "dry_run": f"WITH {_JUDGED} SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(why) = 0 THEN ['taken'] ELSE list_transform(why, lambda x: CASE WHEN starts_with(x, 'already asked as') THEN 'already asked' ELSE x END) END) AS reason FROM r) GROUP BY reason",
    "passages_taken": f"WITH {_JUDGED} SELECT id FROM passages WHERE id IN (SELECT passage FROM r WHERE len(why) = 0)",
    "passage_conflicts": f"WITH p AS {_cte(PASSAGES)} SELECT id, 'About ' || r_name AS text FROM p JOIN region ON id = 'p' || r_regionkey WHERE text <> 'About ' || r_name",
    "not_staged_yet": f"WITH {_Q} SELECT seq, year, n FROM q WHERE year IS NOT NULL AND seq % 3 = 0 AND (year, n) NOT IN (SELECT (year, n) FROM q WHERE year IS NOT NULL AND seq % 3 = 1)",
    "pending_papers": """SELECT 'https://x.org/' || o_orderkey || '.pdf' AS url, CASE WHEN o_orderkey % 2 = 0 THEN '/landed/' || o_orderkey END AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'parse' ELSE 'fetch' END AS action
        FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0""",
    "loaded_in_order": "SELECT (row_number() OVER (ORDER BY n_name) - 1)::INT AS place, n_name AS batch FROM nation WHERE n_nationkey % 4 <> 0 AND n_name < 'NATION_17'",
    "key_letters": f"WITH {_Q}, {_TAG} SELECT seq, cell, CASE WHEN length(cell) = 1 AND cell <> 'X' THEN ascii(cell) - 65 END::INT AS letter FROM j",
    "rule_links": "SELECT year, min(href) AS href FROM (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders) JOIN (SELECT 'key-' || (c_nationkey + 1990) || '-' || c_mktsegment || '.pdf' AS href FROM customer) ON contains(href, year::VARCHAR) GROUP BY year",
    "reviewed_draft": f"""WITH {_Q} SELECT seq AS n, CASE WHEN seq % 3 <> 0 THEN 'unread' WHEN seq % 9 = 0 THEN 'skipped' WHEN seq % 4 = 3 THEN 'added' ELSE 'kept' END AS status,
        CASE WHEN seq % 3 = 0 THEN 'read' ELSE topic END AS topic, CASE WHEN seq % 4 <> 3 THEN q END AS q FROM q WHERE seq % 4 <> 3 OR seq % 3 = 0""",
    "start_pages": f"WITH {_Q} SELECT seq AS n, (seq // 10)::INT AS page FROM q WHERE seq BETWEEN 1 AND 99 AND trim(q) <> ''",
    "merged_answers": f"""WITH {_Q} SELECT seq AS n, CASE WHEN seq % 3 <> 0 THEN substr('abcd', seq % 4 + 1, 1) ELSE 'b' END AS answer,
        array_to_string(list_filter([CASE WHEN seq % 3 <> 0 THEN 'a' END, CASE WHEN seq % 2 = 0 THEN 'b' END], lambda x: x IS NOT NULL), ',') AS also FROM q WHERE seq % 3 <> 0 OR seq % 2 = 0""",
    "merged_maps": """SELECT user_id, coalesce(string_agg(k || ':' || v, ',' ORDER BY k), '') AS merged FROM (SELECT user_id, k, CASE WHEN bool_or(event_type = 'click') THEN 'right' ELSE 'x' || any_value(k) END AS v
        FROM (SELECT user_id, event_type, (event_id % 5)::INT AS k FROM events WHERE event_type IN ('view', 'click')) GROUP BY user_id, k) RIGHT JOIN (SELECT DISTINCT user_id FROM events) USING (user_id) GROUP BY user_id""",
    "listed_last": """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS login FROM customer) SELECT login, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM c GROUP BY login""",
}


def _ranked_sql() -> str:
    from quern.functions import text as tx

    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    terms = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]{{2,}}'), lambda w: w NOT IN ({stop}))"
    return f"""WITH b AS (SELECT item_id, term, 3 * count(*) AS tf FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark) GROUP BY ALL),
        i AS (SELECT term, greatest(0.0, ln((SELECT count(*) FROM benchmark) / (1 + count(*))::DOUBLE)) AS idf FROM b GROUP BY term),
        q AS (SELECT doc_id, term, least(count(*), 3) AS c FROM (SELECT doc_id, unnest({terms}) AS term FROM documents) GROUP BY ALL),
        s AS (SELECT doc_id, item_id, printf('s%d-%06d', item_id % 3, item_id) AS topic, sum(c * ln(1 + tf) * idf) AS score FROM q JOIN b USING (term) JOIN i USING (term)
          WHERE doc_id % 4 = 3 OR item_id % 3 = doc_id % 4 GROUP BY ALL HAVING sum(c * ln(1 + tf) * idf) > 0),
        k AS (SELECT *, row_number() OVER o AS place, lead(score) OVER o AS second FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY round(score, 9) DESC, topic))
        SELECT doc_id, topic, round(score, 5) AS score, round(coalesce(score / second, 9.9), 5) AS lead, score < 8 OR coalesce(score / second, 9.9) < 1.25 AS weak FROM k WHERE place = 1"""


ORACLE_SQL["ranked_in_subject"] = _ranked_sql()
