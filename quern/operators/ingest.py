"""Idempotent ingestion: what changed, what is new, what is refused and why."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators.quality import blank, reasons


def digest(content: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def batch_id(source: Column, stem: Column) -> Column:
    """A batch's name from its source's fields, else from its file's stem."""
    given = F.concat_ws(" · ", *[F.when(~blank(source[f].cast("string")), source[f].cast("string")) for f in ("name", "test", "year")])
    return F.coalesce(F.nullif(given, F.lit("")), stem)


def changes(batches: DataFrame, log: DataFrame, *, key: str = "batch", force: bool = False) -> DataFrame:
    """Batches (key, digest) against a log: new, changed, unchanged or forced."""
    j = batches.join(log.select(key, F.col("digest").alias("_was")), key, "left")
    same = F.lit("forced" if force else "unchanged")
    return j.withColumn("state", F.when(F.col("_was").isNull(), "new").when(F.col("_was") != F.col("digest"), "changed").otherwise(same)).drop("_was")


def run_in_order(todo: DataFrame, load: Callable[[str], bool], *, key: str = "batch") -> list[str]:
    """I4: batches loaded one by one in order of their names; stops at the first that fails. Returns those done.

    Inserts are idempotent, so a batch done before a failure may be run again.
    """
    done = []
    for row in todo.filter("state <> 'unchanged'").select(key).orderBy(key).toLocalIterator():
        if not load(row[0]):
            break
        done.append(row[0])
    return done


def question_id(id: Column, paper: Column, prefix: Column, n: Column) -> Column:
    """An explicit id, else the paper's cell, else the batch's prefix and the number."""
    cell = F.when(paper.isNotNull(), F.format_string("csp%s-%s-%s-%d", F.substring(paper["year"].cast("string"), 3, 2), paper["code"], F.lower(paper["set"]), paper["n"]))
    named = F.when(~blank(prefix), F.concat(prefix, F.lit("-"), n.cast("string")))
    return F.coalesce(F.nullif(id, F.lit("")), cell, named, F.concat(F.lit("q-"), n.cast("string")))


def prefix(source: Column) -> Column:
    return F.array_join(F.filter(F.array(tx.slug(source["name"]), tx.slug(source["test"]), F.coalesce(source["year"].cast("string"), F.lit(""))), lambda x: x != ""), "-")


def identity(q: Column, passage_text: Column) -> Column:
    """A question is its folded text, and its passage's where it has one."""
    return F.concat(tx.fold(F.coalesce(q, F.lit(""))), F.when(passage_text.isNotNull(), F.concat(F.lit(" | "), tx.fold(passage_text))).otherwise(F.lit("")))


def judged(batch: DataFrame, bank: DataFrame, topics: DataFrame, passages: DataFrame) -> DataFrame:
    """The batch (seq, id, topic, q, options, answer, passage, paper, source) with ``why``, all reasons against each row.

    A row is taken if it has no reason. Ids and identities of earlier rows of the batch count
    as taken only if those rows have no reason of their own. Insert only: a known id is never updated.
    """
    named = batch.join(passages.select(F.col("id").alias("passage"), F.col("text").alias("_text")), "passage", "left")
    named = named.join(topics.select(F.col("id").alias("topic"), F.lit(True).alias("_topic")), "topic", "left")
    named = named.withColumn("_identity", F.nullif(identity(F.col("q"), F.col("_text")), F.lit("")))
    bank = bank.join(passages.select(F.col("id").alias("passage"), F.col("text").alias("_text")), "passage", "left")
    named = named.join(bank.select("id", F.lit(True).alias("_id_known")).distinct(), "id", "left")
    stems = bank.select(identity(F.col("q"), F.col("_text")).alias("_identity"), F.col("id").alias("_as")).groupBy("_identity").agg(F.min("_as").alias("_as"))
    named = named.join(stems, "_identity", "left")
    n, trimmed = F.coalesce(F.size("options"), F.lit(0)), F.transform("options", lambda o: F.trim(o))
    own = reasons(
        (F.col("_id_known"), "id already in the bank"),
        (F.col("_topic").isNull(), "unknown topic"),
        (~n.between(2, 6), F.format_string("%d options", n)),
        (n.between(2, 6) & F.exists("options", lambda o: blank(o)), "an option is empty"),
        (n.between(2, 6) & (F.size(F.array_distinct(trimmed)) < n), "two options are equal"),
        (F.col("answer").isNull() | (F.col("answer") < 0) | (F.col("answer") >= n), "answer outside the options"),
        (blank(F.col("q")), "no text"),
        (F.col("passage").isNotNull() & blank(F.col("_text")), "unknown passage"),
        (F.col("_as").isNotNull(), F.concat(F.lit("already asked as "), F.col("_as"))),
        (F.col("paper").isNotNull() & F.col("source.name").isNotNull(), "cites a paper and a test series"),
        (F.col("paper").isNull() & blank(F.col("source.name")), "no provenance"),
    )
    named = named.withColumn("_own", own)
    good = F.size("_own") == 0
    earlier = lambda key: F.max(F.when(good, F.lit(True))).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    named = named.withColumns({"_id_before": earlier("id"), "_stem_before": F.when(F.col("_identity").isNotNull(), earlier("_identity"))})
    repeat = reasons((good & F.col("_id_before"), "id already in the batch"), (good & F.col("_stem_before"), "already asked in the batch"))
    return named.withColumn("why", F.concat("_own", repeat)).select(*batch.columns, "why")


def dry_run(judgement: DataFrame) -> DataFrame:
    """What an import would do, and nothing written: rows by reason, a row counting once for each; "taken" for those without."""
    why = F.when(F.size("why") == 0, F.array(F.lit("taken"))).otherwise(F.transform("why", lambda x: F.when(x.startswith("already asked as"), F.lit("already asked")).otherwise(x)))
    return judgement.select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def taken(judgement: DataFrame) -> DataFrame:
    return judgement.filter(F.size("why") == 0).drop("why")


def passage_conflicts(bank: DataFrame, new: DataFrame) -> DataFrame:
    """I8: passages (id, text) whose id is known with another text; any row here stops the batch."""
    return new.join(bank.select("id", F.col("text").alias("_was")), "id").filter("text <> _was").drop("_was")


def used_passages(new: DataFrame, rows: DataFrame) -> DataFrame:
    """New passages that a taken row points at."""
    return new.join(rows.select(F.col("passage").alias("id")), "id", "left_semi")


def merged(bank: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert only: the bank, and rows whose id it lacks."""
    return bank.unionByName(rows.join(bank.select("id"), "id", "left_anti"), allowMissingColumns=True)


def not_staged_yet(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Rows whose (year, code, n) isn't in the bank."""
    return rows.join(bank.select("year", "code", "n").distinct(), ["year", "code", "n"], "left_anti")


def pending(papers: DataFrame, landed: DataFrame) -> DataFrame:
    """Papers (year, code, url, keys) with a url and no keys, with the landed file's path if there is one."""
    todo = papers.filter(F.col("url").isNotNull() & F.col("keys").isNull())
    return todo.join(landed.select("url", "path"), "url", "left").withColumn("action", F.when(F.col("path").isNotNull(), "parse").otherwise("fetch"))
