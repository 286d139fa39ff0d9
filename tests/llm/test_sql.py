"""The corpus queries that SQL can express, against that SQL."""

import math
from pathlib import Path

import pytest

from quern.llm import queries
from quern.llm.license_texts import TEXTS

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def same(got, rel):
    at = {c: k for k, c in enumerate(rel.columns)}
    want = [tuple(r[at[c]] for c in got.columns) for r in rel.fetchall()]
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)
    got = plain(map(tuple, got.collect()))
    assert got == plain(want) and got


def staged(tmp_path, spark):
    """Texts that the driver's tables lack: ties, nulls, whole licences, poor vocabularies of every length."""
    rows = [(7, "one two three", "en", "s", 1), (7, "three two one", "en", "s", 1), (7, "one two three", "en", "s", 1), (None, None, None, None, None), (3, "", "fr", "", 0), (None, "", "en", None, 0)]
    rows += [(100 + k, f"head {k} {text} tail", "en", f"s{k % 4}", 1) for k, (_, text, _) in enumerate(TEXTS)]
    rows += [(200 + k, " ".join(f"w{j % v}" for j in range(n)), "en", "long", 1) for k, (n, v) in enumerate(((4_998, 390), (5_000, 390), (5_001, 500), (9_999, 300), (12_000, 12_000)))]
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, tmp_path, name):
    import duckdb

    for path in [staged(tmp_path, spark), *([DATA] if Path(DATA).exists() else [])]:
        con = duckdb.connect()
        folder = Path(f"{path}/documents.parquet")
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}{'/*.parquet' if folder.is_dir() else ''}'")
        same(queries.QUERIES[name](spark, path), con.sql(queries.ORACLE_SQL[name]))
