"""Readers, writers and page images over files and pages that are staged from the driver's tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.operators import images
from quern.sources import landing, readers, sinks


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _land(spark, rows, what: str) -> str:
    """A folder with one text file for each row (k, value)."""
    path = sinks.shared_folder(spark, what)
    rows.select("k", "value").write.partitionBy("k").text(path)
    return path


def _documents(spark, sf_dir) -> str:
    r = _read(spark, sf_dir, "region").withColumn("k", F.col("r_regionkey"))
    whole = F.concat(F.lit('{\n "name": "'), F.col("r_name"), F.lit('",\n "key": '), F.col("k").cast("string"), F.lit("\n}"))
    return _land(spark, r.select("k", F.when(F.col("k") == 3, F.lit('{"name": "broken')).otherwise(whole).alias("value")), "documents")


def json_documents(spark, sf_dir):
    return readers.json_document(spark, f"{_documents(spark, sf_dir)}/*", "name string, key int").select("name", "key", F.col("_corrupt_record").isNotNull().alias("broken"))


def json_batches(spark, sf_dir):
    good, bad = readers.json_batches(spark, f"{_documents(spark, sf_dir)}/*", "name string, key int")
    return good.select("name", F.lit("read").alias("state")).unionByName(bad.select(F.trim(F.regexp_replace("_corrupt_record", r"\s+", " ")).alias("name"), F.lit("unreadable").alias("state")))


def raw_members(spark, sf_dir):
    """Members of an array inside a document, as they stand: an absent key and a null differ."""
    rows = _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.concat(F.lit('{"a": {"list": [{"n": null}, {"m": "'), F.col("r_name"), F.lit('"}]}}')).alias("value"))
    raw = readers.raw_elements(spark, f"{_land(spark, rows, 'raw')}/*", "a", "list")
    return raw.select("seq", "raw", F.array_join(F.json_object_keys("raw"), ",").alias("keys"))


def landed_pages(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("<html>\n"), F.col("n_name"), F.lit("\n</html>")).alias("value"))
    got = readers.pages(spark, f"{_land(spark, rows, 'pages')}/*")
    return got.select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("int").alias("k"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def split_pages(spark, sf_dir):
    n = F.col("n_nationkey")
    text = F.concat(F.lit("=== page "), (n + 1).cast("string"), F.lit(" ===\nfirst "), F.col("n_name"), F.lit("\n=== page ===\nsecond ( "), (n + 2).cast("string"), F.lit(" - B )\n=== page ===\nthird"))
    docs = _read(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"))
    return readers.split_pages(docs, "n_nationkey", "text").select("n_nationkey", "pos", "page", F.trim("text").alias("text"))


def recognised(spark, sf_dir):
    """An external program over each image; here one that writes what it reads."""
    pages = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page"), F.encode(F.col("n_name"), "UTF-8").alias("content"))
    return readers.recognised(pages, ["cat"])


def _years(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()


_TABLE = (
    "<table><caption>Civil Services (Main) Examination, {y}</caption><ul><li>General Studies Paper &ndash; II <a href=\"/m/{y}-2.pdf\">pdf</a></li>"
    "<li>General Studies Paper II <a href=\"/later.pdf\">pdf</a></li><li>Essay<a href=\"https://x.org/{y}-e.pdf\">pdf</a></li><li>No link</li>"
    "<li>Law Paper - I <a href=\"/m/law-{y}.pdf\">pdf</a></li><li>Public  Administration Paper 2<a href=\"/m/pa-{y}.pdf\">pdf</a></li></ul></table><table><caption>Else {y}</caption><li>Essay<a href=\"/no.pdf\">x</a></li></table>"
)


def _scraped(spark, sf_dir):
    return _years(spark, sf_dir).select(F.replace(F.lit(_TABLE), F.lit("{y}"), F.col("y").cast("string")).alias("html"))


def exam_papers(spark, sf_dir):
    return readers.exam_papers(_scraped(spark, sf_dir), "html", base="https://base")


def optional_papers(spark, sf_dir):
    return readers.optional_papers(_scraped(spark, sf_dir), "html", {"law": "law", "pubad": r"public\s+administration"}, base="https://base")


def written_json(spark, sf_dir):
    path = sinks.shared_folder(spark, "json")
    sinks.write_json(_read(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" – é")).alias("name")), path)
    return spark.read.schema("n_nationkey int, name string").json(path)


def written_pages(spark, sf_dir):
    path = sinks.shared_folder(spark, "html")
    sinks.write_pages(_read(spark, sf_dir, "nation").select(F.concat(F.lit("<p>"), "n_name", F.lit("</p>")).alias("html")), path)
    return spark.read.text(path).select(F.col("value").alias("html"))


def restored_state(spark, sf_dir):
    """The second of two snapshots, read back with a column that it lacks."""
    path, n = sinks.shared_folder(spark, "snapshot"), _read(spark, sf_dir, "nation")
    sinks.snapshot(n.select("n_nationkey", "n_name"), path)
    sinks.snapshot(n.filter("n_nationkey % 2 = 0").select("n_nationkey", "n_name"), path)
    return sinks.restored(spark, path, "n_nationkey int, n_name string, note string")


def folder_listing(spark, sf_dir):
    """Names and sizes of files, the backup left out."""
    folder = sinks.shared_folder(spark, "folder")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in _read(spark, sf_dir, "region").orderBy("r_regionkey").collect():  # one for each region
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.r_name.replace(' ', '-')}.txt")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(b"x" * (10 + r.r_regionkey)))
        out.close()
    found = readers.listing(spark, folder, without=("AFRICA.txt",))
    return found.select("name", "size", (F.col("modified") > F.lit("2020-01-01").cast("timestamp")).alias("dated"))


# --- images of pages -----------------------------------------------------------------------------------


def _drawn(spark, sf_dir, draw):
    """(page, pixels, width): a page that ``draw`` makes for each nation's key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [draw(int(k)) for k in f["page"]]
            yield pd.DataFrame({"page": f["page"], "pixels": [m.tobytes() for m in made], "width": [m.shape[1] for m in made]})

    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("page")).mapInPandas(run, "page int, pixels binary, width int")


def _two_columns(k: int) -> np.ndarray:
    """Lines of text in two columns, the gap 10 wide around 44 + k / 2; on even pages a rule in its middle."""
    gray, mid = np.full((200, 100), 255, np.uint8), 44 + k // 2
    gray[20:180:4, 5 : mid - 5] = 0
    gray[20:180:4, mid + 5 : 95] = 0
    if k % 2 == 0:
        gray[10:190, mid] = 0
    return gray


def page_splits(spark, sf_dir):
    found = images.page_splits(_drawn(spark, sf_dir, _two_columns))
    gutter = F.when(F.col("page") % 2 == 1, F.col("gutter"))
    return found.select("page", "rule", gutter.alias("gutter"), F.round(images.split_at(F.col("rule"), gutter, F.col("width"), F.lit(0.5)), 6).alias("split"))


def _skewed(k: int) -> np.ndarray:
    gray = np.full((300, 120), 255, np.uint8)
    gray[10:290, 60] = 0
    return images.rotated(gray, -(k % 5)) if k % 5 < 3 else np.full_like(gray, 255)


def straightened_pages(spark, sf_dir):
    found = images.straightened(_drawn(spark, sf_dir, _skewed))
    return found.select("page", (F.abs(F.col("angle") - F.when(F.col("page") % 5 < 3, F.col("page") % 5).otherwise(0)) <= 0.5).alias("found"))


def page_columns(spark, sf_dir):
    return images.page_columns(_drawn(spark, sf_dir, lambda k: np.full((200 + k, 100 + k), k, np.uint8))).select("page", "part", "width", "height", F.length("pixels").alias("bytes"))


def stitched_pages(spark, sf_dir):
    drawn = _drawn(spark, sf_dir, lambda k: np.full((4 + k, 20 - k % 2), k, np.uint8))
    strips = drawn.select((F.col("page") % 5).alias("page"), F.col("page").alias("pos"), "pixels", "width")
    return images.stitched_pages(strips).select("page", "width", "height", F.length("pixels").alias("bytes"))


def cropped_pages(spark, sf_dir):
    """The middle of each page as a PNG file, whose header says its size."""
    found = images.cropped(_drawn(spark, sf_dir, lambda k: np.full((200 + 4 * k, 100), k, np.uint8)), (0.25, 0.5, 0.75, 1.0))
    size = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("int")
    return found.select("page", "width", "height", size(17).alias("said_width"), size(21).alias("said_height"), F.hex(F.substring("png", 1, 4)).alias("magic"))


def fetched_files(spark, sf_dir):
    """Files that are landed one at a time, some twice, some that can't be got; then read by Spark."""
    names = [r.n_name for r in _read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # a small list of urls

    def get(url: str) -> bytes:
        if url.endswith("3"):
            raise OSError("no answer")
        return f"content of {url}".encode()

    folder = landing.Folder(spark, sinks.shared_folder(spark, "landing"))
    ask = landing.throttled(get, apart=0)
    list(landing.read_through(names[:10], ask, folder))
    states = list(landing.read_through(names, ask, folder))
    kept = [landing.network_first(n, lambda _: None, folder) for n in names]
    rows = [(n, s, None if c is None else c.decode()) for (n, s), c in zip(states, kept)]
    files = readers.pages(spark, f"{folder.path}/*").select("text")
    return spark.createDataFrame(rows, "url string, state string, kept string").join(files.withColumnRenamed("text", "kept").distinct(), "kept", "left").select("url", "state", "kept")


_FUNCTIONS = (
    cropped_pages, fetched_files, json_documents, json_batches, raw_members, landed_pages, split_pages, recognised, exam_papers, optional_papers, written_json, written_pages, restored_state, folder_listing,
    page_splits, straightened_pages, page_columns, stitched_pages,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_YEARS = "(SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders)"
ORACLE_SQL = {
    "cropped_pages": "SELECT n_nationkey AS page, 50 AS width, 100 + 2 * n_nationkey AS height, 50 AS said_width, 100 + 2 * n_nationkey AS said_height, '89504E47' AS magic FROM nation",
    "fetched_files": """SELECT n_name AS url, CASE WHEN n_name LIKE '%3' THEN 'failed' WHEN n_nationkey < 10 THEN 'landed' ELSE 'fetched' END AS state,
        CASE WHEN n_name NOT LIKE '%3' THEN 'content of ' || n_name END AS kept FROM nation""",
    "json_documents": "SELECT CASE WHEN r_regionkey <> 3 THEN r_name END AS name, CASE WHEN r_regionkey <> 3 THEN r_regionkey END AS key, r_regionkey = 3 AS broken FROM region",
    "json_batches": """SELECT CASE WHEN r_regionkey = 3 THEN '{"name": "broken' ELSE r_name END AS name, CASE WHEN r_regionkey = 3 THEN 'unreadable' ELSE 'read' END AS state FROM region""",
    "raw_members": """SELECT 0 AS seq, '{"n":null}' AS raw, 'n' AS keys FROM region UNION ALL SELECT 1, '{"m":"' || r_name || '"}', 'm' FROM region""",
    "landed_pages": "SELECT n_nationkey AS k, '<html> ' || n_name || ' </html>' AS text FROM nation",
    "split_pages": """SELECT n_nationkey, pos, CASE pos WHEN 1 THEN n_nationkey + 1 WHEN 2 THEN n_nationkey + 2 END AS page,
        CASE pos WHEN 1 THEN 'first ' || n_name WHEN 2 THEN 'second ( ' || (n_nationkey + 2) || ' - B )' ELSE 'third' END AS text FROM nation, (VALUES (1), (2), (3)) q(pos)""",
    "recognised": "SELECT n_nationkey AS page, n_name AS text FROM nation",
    "exam_papers": f"""SELECT 'mains' AS kind, year, 'gs2' AS code, 'https://base/m/' || year || '-2.pdf' AS url FROM {_YEARS} UNION ALL SELECT 'mains', year, 'essay', 'https://x.org/' || year || '-e.pdf' FROM {_YEARS}""",
    "optional_papers": f"SELECT 'law' AS subject, year, 'p1' AS code, 'https://base/m/law-' || year || '.pdf' AS url FROM {_YEARS} UNION ALL SELECT 'pubad', year, 'p2', 'https://base/m/pa-' || year || '.pdf' FROM {_YEARS}",
    "written_json": "SELECT n_nationkey, n_name || ' – é' AS name FROM nation",
    "written_pages": "SELECT '<p>' || n_name || '</p>' AS html FROM nation",
    "restored_state": "SELECT n_nationkey, n_name, NULL::VARCHAR AS note FROM nation WHERE n_nationkey % 2 = 0",
    "folder_listing": "SELECT replace(r_name, ' ', '-') || '.txt' AS name, 10 + r_regionkey AS size, true AS dated FROM region WHERE r_name <> 'AFRICA'",
    "page_splits": """SELECT n_nationkey AS page, CASE WHEN n_nationkey % 2 = 0 THEN 44 + n_nationkey // 2 ELSE -1 END AS rule, CASE WHEN n_nationkey % 2 = 1 THEN 44 + n_nationkey // 2 END AS gutter,
        CASE WHEN n_nationkey % 2 = 0 AND abs((44 + n_nationkey // 2) / 100.0 - 0.5) <= 0.05 THEN (44 + n_nationkey // 2) / 100.0
          WHEN n_nationkey % 2 = 1 AND abs((44 + n_nationkey // 2) / 100.0 - 0.5) <= 0.02 THEN (44 + n_nationkey // 2) / 100.0 ELSE 0.5 END AS split FROM nation""",
    "straightened_pages": "SELECT n_nationkey AS page, true AS found FROM nation",
    "page_columns": """SELECT *, width * height AS bytes FROM (SELECT n_nationkey AS page, part, CASE part WHEN 0 THEN floor((100 + n_nationkey) * 0.52)::INT ELSE 100 + n_nationkey - floor((100 + n_nationkey) * 0.48)::INT END AS width,
        floor((200 + n_nationkey) * 0.955)::INT AS height FROM nation, (VALUES (0), (1)) q(part))""",
    "stitched_pages": """SELECT n_nationkey % 5 AS page, 20 AS width, sum(4 + n_nationkey)::INT AS height, (20 * sum(4 + n_nationkey))::INT AS bytes FROM nation GROUP BY n_nationkey % 5""",
}
