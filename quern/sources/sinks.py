"""Writers and the names they use."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.match import numbered


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names (one of our own only where it is unset), deleted when the application ends. Without one, only a local session may go on."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quern-')}"  # one process: its own folder is shared with itself
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def to_json_text(*columns: str) -> Column:
    """A row as minified JSON, non-ASCII characters kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8."""
    df.write.mode("overwrite").json(path)


def export_document(df: DataFrame, path: str, *, indent: int = 2) -> None:
    """One indented JSON array in one file for people to read. Rows go through the driver one at a time, never all at once."""
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        out.write("[")
        for k, row in enumerate(df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
            out.write(("," if k else "") + "\n" + json.dumps(json.loads(row.j), ensure_ascii=False, indent=indent))
        out.write("\n]\n")


def write_pages(df: DataFrame, path: str, *, text: str = "html") -> None:
    """Rendered pages, one row a record."""
    df.select(text).write.mode("overwrite").text(path)


def snapshot(df: DataFrame, path: str) -> None:
    """A whole state written over the last one."""
    df.write.mode("overwrite").parquet(path)


def restored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The last state that ``snapshot`` wrote; columns that it lacks are null, others are left out."""
    return spark.read.schema(schema).parquet(path)


def free_names(files: DataFrame, *, name: str = "name", seq: str = "seq") -> DataFrame:
    """Copies of a name become "name (2).ext" and so on, in order of arrival (a number)."""
    files, k = numbered(files, name, seq, to="_copy"), F.col("_copy")
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("free_name", F.when(k == 1, F.col(name)).otherwise(F.concat(stem, F.format_string(" (%d)", k), ext))).drop("_copy")


def download_name(url: Column) -> Column:
    """A url's last segment, or a name from its hash if it has none."""
    last = F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1)
    return F.when((last != "") & F.contains(last, F.lit(".")), last).otherwise(F.concat(F.lit("file-"), F.abs(F.hash(url)).cast("string")))
