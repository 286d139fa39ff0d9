"""Readers: JSON documents, HTML, page texts, embedded payloads, folders.

Paths are Spark paths, so any store that Spark reads will do. Files that can't be parsed
are kept as rows with ``_corrupt_record`` set, never dropped silently.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import classify
from quern.functions import text as tx


def _schema(schema: str | T.StructType) -> T.StructType:
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files of one JSON document each, with an explicit schema."""
    return spark.read.schema(_schema(schema)).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def json_batches(spark: SparkSession, pattern: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(readable batches, unreadable ones), each with its file's name."""
    whole = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    read = whole.select("file", F.from_json("value", _schema(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d")).select("file", "d.*")
    return read.filter("_corrupt_record is null").drop("_corrupt_record"), read.filter("_corrupt_record is not null").select("file", "_corrupt_record")


def raw_elements(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """Elements of an array inside a document as raw JSON, so that an absent key and a null can be told apart."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"))
    at = F.get_json_object("value", "$." + ".".join(fields)) if fields else F.col("value")
    return whole.select(F.posexplode(F.from_json(at, "array<string>")).alias("seq", "raw"))


def pages(spark: SparkSession, pattern: str) -> DataFrame:
    """Landed files as one text each: path and text."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def unescaped_markdown(c: Column) -> Column:
    """Back-slashes before punctuation removed, as text exports put them."""
    return F.regexp_replace(c, r"\\([\[\]\.\-_*()#|])", "$1")


def split_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, page, text) of a text with "=== page 3 ===" lines; a number may be missing, and is then read off the footer."""
    mark = r"\n*=== page(?: [0-9]+)? ===\n*"
    numbers = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(r"=== page(?: ([0-9]+))? ==="), F.lit(1)))
    parts = F.arrays_zip(numbers.alias("n"), F.split(text, mark, -1).alias("t"))
    out = docs.select(key, F.posexplode(parts).alias("pos", "p")).select(key, "pos", F.col("p.n").alias("n"), F.col("p.t").alias("text")).filter((F.col("pos") > 0) | (F.trim("text") != ""))
    code = F.nullif(F.regexp_extract("text", r"[A-Z]{2,5}\s*[-–—]\s*[A-Z]\s*[-–—]\s*[A-Z]{2,5}\s*/\s*[0-9]{1,3}\s*[A-D]\s+([0-9]{1,2})\b", 1), F.lit(""))
    foot = F.nullif(F.regexp_extract("text", r"\(\s*([0-9]{1,2})\s*[-–—]\s*[A-D]\s*\)", 1), F.lit(""))
    return out.withColumn("page", F.coalesce(F.nullif("n", F.lit("")), code, foot).cast("int")).drop("n")


def links(docs: DataFrame, key: str, html: str, *, base: str = "", ending: str = ".pdf") -> DataFrame:
    """Distinct links of each page that end so, made absolute."""
    found = F.explode(F.regexp_extract_all(html, F.lit(rf'(?i)href="([^"]+{re.escape(ending)})"'), F.lit(1)))
    return docs.select(key, found.alias("href")).select(key, F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href"))).alias("href")).distinct()


def _items(docs: DataFrame, html: str, base: str) -> DataFrame:
    """(pos, kind, year, label, url) of list items with a link in tables whose caption names an exam."""
    tables = docs.select(F.posexplode(F.regexp_extract_all(html, F.lit("(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("t", "table"))
    exam = classify.exam_of(tx.visible_text(F.regexp_extract("table", "(?is)<caption[^>]*>(.*?)</caption>", 1)))
    rows = tables.withColumn("exam", exam).filter("exam is not null").select("t", "exam.kind", "exam.year", F.posexplode(F.regexp_extract_all("table", F.lit("(?is)<li>(.*?)</li>"), F.lit(1))).alias("i", "li"))
    url = F.regexp_extract("li", r'(?i)href="([^"]+\.pdf)"', 1)
    rows = rows.withColumns({"url": url, "label": tx.visible_text(F.regexp_replace("li", "(?s)<a.*", ""))}).filter("url <> ''")
    return rows.select(F.struct("t", "i").alias("pos"), "kind", "year", "label", F.when(F.col("url").startswith("/"), F.concat(F.lit(base), "url")).otherwise(F.col("url")).alias("url"))


def exam_papers(docs: DataFrame, html: str, *, base: str = "") -> DataFrame:
    """(kind, year, code, url) of general papers and the essay; the first link of a code counts."""
    return _items(docs, html, base).withColumn("code", classify.paper_code(F.col("label"))).filter("code is not null").groupBy("kind", "year", "code").agg(F.min_by("url", "pos").alias("url"))


def optional_papers(docs: DataFrame, html: str, subjects: dict[str, str], *, base: str = "") -> DataFrame:
    """(subject, year, code, url) of optional subjects in mains tables. ``subjects``: id to a pattern of its name's spellings."""
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("subject"), classify.optional_paper(F.col("label"), p).alias("code")) for s, p in subjects.items()]))
    rows = _items(docs, html, base).filter("kind = 'mains'").withColumn("n", named).select("pos", "year", "n.subject", "n.code", "url").filter("code is not null")
    return rows.groupBy("subject", "year", "code").agg(F.min_by("url", "pos").alias("url"))


def embedded_payload(c: Column, name: str, schema: str) -> Column:
    """The value of ``const NAME = <json>;`` that stands on one line."""
    return F.from_json(F.regexp_extract(c, rf"(?m)^\s*const {re.escape(name)}\s*=\s*(.*);\s*$", 1), schema)


def listing(spark: SparkSession, folder: str, *, without: tuple[str, ...] = ()) -> DataFrame:
    """Files of a folder, newest first: name, size, modified. Contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.filter(~F.col("name").isin(*without) if without else F.lit(True)).orderBy(F.col("modified").desc(), "name")


def pdf_texts(spark: SparkSession, pattern: str, *, least: int = 5000) -> DataFrame:
    """(path, text) of PDF files; null where the text layer is under ``least`` characters. Needs pypdf on the workers."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs pypdf") from e
        for f in frames:
            got = ["\n".join((p.extract_text() or "") for p in PdfReader(io.BytesIO(c)).pages) for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], "text": [t if len(t.strip()) >= least else None for t in got]})

    return files.mapInPandas(run, "path string, text string")


def recognised(pages: DataFrame, command: list[str], *, key: str = "page", image: str = "content") -> DataFrame:
    """(page, text) by an external program that reads an image on standard input and writes text; its path is a parameter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess

        for f in frames:
            out = [subprocess.run(command, input=bytes(c), capture_output=True, check=False).stdout.decode("utf-8", "replace") for c in f[image]]
            yield pd.DataFrame({key: f[key], "text": out})

    return pages.select(key, image).mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, text string")
