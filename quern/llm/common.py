"""What the corpus operators share: columns, shared tables and byte-level words.

Every operator treats a null text as empty, carries a row's other columns along
untouched only where its docstring says so, and names its inputs by parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.sinks import shared_folder

#: A word of most contracts: a run of bytes outside these, which ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that later reads survive lost executors."""
    path = shared_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and ``most`` bytes, one row at least, to bound what a worker holds."""
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while todo:
            piece = todo.pop()
            if piece.num_rows > 1 and piece.nbytes > most:
                half = piece.num_rows // 2
                todo += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def row_identity(*columns: str) -> Column:
    """16 bytes that tell rows apart by these columns: an MD5 of their texts, each marked as null or not and by its length."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def hashable(df: DataFrame) -> list[str]:
    """Columns of ``df`` that a hash takes: no maps."""
    return [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]


def ascii_lower_sql(text: str = "text") -> Column:
    """The text with A-Z lowered and nothing else changed."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it if a column of ``df`` is called so, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
