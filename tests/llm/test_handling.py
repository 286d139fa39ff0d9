"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for the query of every corpus operator."""

import json

import pytest
from pyspark.sql import functions as F

from quern.llm import queries

#: Names that operators use inside, as further columns of the tables.
CLASHING = ("k", "t", "l", "u", "w", "c", "row", "row_key", "fp", "root", "band", "same", "sign", "score", "held_out", "held", "size", "src", "order", "range", "finish", "n_words", "failures", "verdict", "near_row", "mix_row", "part", "unit", "url_", "n_chars_", "h", "chunk", "dest")
LONG = "a long text of words that goes on " * 9_000
ROWS = [(1, "plain words make up this sentence, mail me@example.com", "en", "s", 1), (1, "plain words make up this sentence, mail me@example.com", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "null id, apache license", "en", None, 7), (None, None, None, None, None), (4, " \n\t ", "en", "s", 4), (5, LONG, "en", "t", len(LONG)), (6, "des mots d'une phrase", "fr", "u", 2), (7, "bad!! ### ***", "en", "s", 2), (8, "plain words make up this sentence, mail me@example.org", "en", "s", 1)]
PAGES = [(1, "u", "<article><p>Some words of the text.</p></article>"), (1, "u", "<article><p>Some words of the text.</p></article>"), (2, None, None), (None, "u", ""), (3, "u", f"<article><p>{LONG}</p></article>")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same tables plain, with clashing columns, and empty."""
    tables = {
        "documents": spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long"),
        "pages": spark.createDataFrame(PAGES, "page_id long, url string, html string"),
        "labels": spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (5, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "plain words make up this sentence"), (2, None), (None, ""), (3, "des mots d'une phrase")], "item_id long, text string"),
    }
    out = {}
    for kind in ("plain", "clashing", "empty"):
        out[kind] = str(tmp_path_factory.mktemp(kind))
        for name, df in tables.items():
            df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING if c not in df.columns}) if kind == "clashing" else df.limit(0) if kind == "empty" else df
            df.write.parquet(f"{out[kind]}/{name}.parquet")
    return out


def rows(df):
    return sorted(json.dumps({c: round(v, 9) if isinstance(v, float) else str(v) for c, v in r.asDict().items()}, sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, folders, name):
    query = queries.QUERIES[name]
    plain = rows(query(spark, folders["plain"]))
    assert rows(query(spark, folders["clashing"])) == plain
    assert query(spark, folders["empty"]).count() == 0
    if name != "op7_benchmark_decontamination":
        assert len(plain) == len(PAGES if name == "op8_html_extraction" else ROWS)


def test_pipeline_over_odd_tables(spark, folders):
    import corpus_pipeline

    for kind in ("plain", "clashing", "empty"):
        df = spark.read.parquet(f"{folders[kind]}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, df, folders[kind])
            assert made.columns == df.columns
            df = spark.createDataFrame(made.collect(), made.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, df, folders[kind]).columns == [*df.columns, "mix_copies"]
