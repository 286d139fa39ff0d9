"""Queries over web pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import match, progress
from quern.sources import readers, sinks


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_titles(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    title = tx.visible_text(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return pages.select("page_id", title.alias("title"), F.regexp_count("html", F.lit("<a href=")).alias("n_links"))


def link_harvest(spark, sf_dir):
    return readers.links(_read(spark, sf_dir, "pages"), "page_id", "html", base="https://example.com", ending="")


def first_links(spark, sf_dir):
    found = readers.links(_read(spark, sf_dir, "pages"), "page_id", "html", ending="")
    return found.groupBy("page_id").agg(F.min("href").alias("href"), F.count("*").alias("n"))


def list_items(spark, sf_dir):
    li = F.explode(F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), F.lit(1)))
    return _read(spark, sf_dir, "pages").select("page_id", li.alias("li")).groupBy("page_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(tx.visible_text(F.col("li")))), "|").cast("binary")).alias("hash"))


def page_payload(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"track\(([0-9]+)\)", 1).cast("long").alias("track"))


def turn_states(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").withColumn("cell", F.when(F.length("text") < 40, "X").otherwise("A"))
    said = turns.filter("role = 'assistant'")
    opened = turns.filter("turn = 0")
    return progress.states(turns, said, opened, ["conv_id", "turn"]).groupBy("state").agg(F.count("*").alias("n"))


def latest_turns(spark, sf_dir):
    return match.by_priority(_read(spark, sf_dir, "conversations"), ["conv_id"], F.col("turn").desc()).select("conv_id", "turn", "role")


def prompts(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations")
    text = progress.prompt(F.col("role"), F.col("text"), F.array("role", "text"), F.lit("a"), F.col("turn").cast("string"))
    return turns.select("conv_id", "turn", F.md5(text.cast("binary")).alias("hash"))


def json_rows(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(sinks.to_json_text("conv_id", "turn", "role").cast("binary")).alias("hash"))


def carried_passages(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.concat(F.lit("p"), F.col("turn").cast("string"))).alias("pid"), F.lit(2).alias("items"))
    return match.carried_passage(turns, group="conv_id", number="turn").select("conv_id", "turn", "passage")


_FUNCTIONS = (page_titles, link_harvest, first_links, list_items, page_payload, turn_states, latest_turns, prompts, json_rows, carried_passages)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _visible(c: str) -> str:
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for name, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'")):
        c = f"replace({c}, '{name}', {char})"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


_HREF = """SELECT DISTINCT page_id, h FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href="([^"]+)"', 1)) AS h FROM pages)"""
ORACLE_SQL = {
    "page_titles": f"""SELECT page_id, {_visible("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, len(regexp_extract_all(html, '<a href='))::INT AS n_links FROM pages""",
    "link_harvest": f"SELECT DISTINCT page_id, CASE WHEN starts_with(h, 'http') THEN h ELSE 'https://example.com' || h END AS href FROM ({_HREF})",
    "first_links": f"SELECT page_id, min(h) AS href, count(*) AS n FROM ({_HREF}) GROUP BY page_id",
    "list_items": f"""SELECT page_id, count(*) AS n, md5(string_agg({_visible("li")}, '|' ORDER BY {_visible("li")})) AS hash
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS li FROM pages) GROUP BY page_id""",
    "page_payload": r"SELECT page_id, regexp_extract(html, 'track\(([0-9]+)\)', 1)::BIGINT AS track FROM pages",
    "turn_states": """SELECT CASE WHEN length(text) < 40 THEN 'dropped' WHEN role = 'assistant' THEN 'answered' WHEN turn = 0 THEN 'seen' ELSE 'untouched' END AS state, count(*) AS n FROM conversations GROUP BY ALL""",
    "latest_turns": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1",
    "prompts": """SELECT conv_id, turn, md5(role || chr(10) || chr(10) || text || chr(10) || chr(10) || '(a) ' || role || chr(10) || '(b) ' || text || chr(10) || chr(10) || 'Key: a; chosen: ' || turn) AS hash FROM conversations""",
    "json_rows": """SELECT conv_id, turn, md5(to_json({'conv_id': conv_id, 'turn': turn, 'role': role})::VARCHAR) AS hash FROM conversations""",
    "carried_passages": """SELECT conv_id, turn, CASE WHEN turn < h + 2 THEN 'p' || h END AS passage FROM
        (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations)""",
}
