"""Repeated lines ("furniture"): found by counting, removed by an anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    parts = F.posexplode(F.split(F.col(text), "\n"))
    return df.select(F.col(key).alias("k"), parts.alias("pos", "raw")).withColumn("line", F.trim("raw"))


#: Lines that stand for themselves however often they occur: options, and the beginnings of questions.
GUARD = r"\([a-d]\)|^[0-9]{1,3}[.,] "


def repeated_lines(df: DataFrame, key: str, text: str, *, min_share: float = 0.5, max_len: int = 40, guard: str | None = GUARD) -> DataFrame:
    """Lines of at most ``max_len`` characters that stand in more than ``min_share`` of the documents.

    Null texts have no lines; blank lines never count, nor do those that ``guard`` finds. Two-step count: distinct
    (line, document) first, so a line repeated inside one document counts once.
    """
    short = _lines(df, key, text).filter(F.length("line").between(1, max_len))
    short = short.filter(~F.col("line").rlike(guard)) if guard else short
    total = df.agg(F.countDistinct(F.col(key)).alias("total"))
    counted = short.select("k", "line").distinct().groupBy("line").agg(F.count("k").alias("n_docs"))
    return counted.join(F.broadcast(total), F.col("n_docs") > F.lit(min_share) * F.col("total")).select("line", "n_docs")


def without_lines(df: DataFrame, key: str, text: str, lines: DataFrame) -> DataFrame:
    """(key, pos, line) of the non-blank lines that aren't among ``lines`` (line)."""
    kept = _lines(df, key, text).filter("line <> ''")
    return kept.join(lines.select("line"), "line", "left_anti").select(F.col("k").alias(key), "pos", "line")
