"""Queries over documents, benchmark and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import furniture, ingest, match, quality


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def furniture_lines(spark, sf_dir):
    return furniture.repeated_lines(_docs(spark, sf_dir), "doc_id", "text", min_share=0.01, max_len=40)


def strip_furniture(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    lines = furniture.repeated_lines(docs, "doc_id", "text", min_share=0.01, max_len=40)
    return furniture.without_lines(docs, "doc_id", "text", lines).groupBy("doc_id").agg(F.count("*").alias("kept_lines"))


def exact_dup_stems(spark, sf_dir):
    return match.duplicates_of(_docs(spark, sf_dir), tx.fold(F.col("text")), "doc_id", "doc_id").select("doc_id", F.col("first_of").alias("first_doc_id"))


def first_wins_dedupe(spark, sf_dir):
    return match.by_priority(_docs(spark, sf_dir).select("doc_id", F.md5(tx.fold(F.col("text")).cast("binary")).alias("identity")), ["identity"], "doc_id")


def norm_alnum(spark, sf_dir):
    n = tx.fold_alnum(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(n).alias("n"), F.md5(n.cast("binary")).alias("hash"))


def ocr_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.alnum_key(F.col("text")).cast("binary")).alias("k1"), F.md5(tx.confusable_key(F.col("text")).cast("binary")).alias("k2"))


def english_share(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(tx.english_share(F.col("text")), 6).alias("share"), (tx.english_share(F.col("text")) >= 0.45).alias("english"))


def latin_share(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(tx.latin_share(F.col("text")), 6).alias("share"))


def best_copies(spark, sf_dir):
    return match.best_copies(_docs(spark, sf_dir), "source", "text", "doc_id").select("source", F.md5(F.col("text").cast("binary")).alias("hash"))


def term_counts(spark, sf_dir):
    t = tx.terms(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


def html_escaped(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.escape_html(F.col("text")).cast("binary")).alias("hash"))


def line_modes(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return match.modes(lines.withColumn("at", F.struct("doc_id", "pos")), ["source"], "line", "at").select("source", "line", "n")


def idf_topk(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    topics = items.select(F.format_string("%06d", "item_id").alias("id"), F.col("text").alias("name"))
    bags = match.term_bags(topics, weighted=(("name", 3),))
    ranked = match.rank_topics(_docs(spark, sf_dir), bags, topics, key="doc_id")
    return ranked.select("doc_id", "rank", F.col("topic").cast("long").alias("item_id"), F.round("score", 6).alias("score"))


def change_detect(spark, sf_dir):
    now = _docs(spark, sf_dir).select(F.col("doc_id").alias("batch"), ingest.digest(F.col("text")).alias("digest"))
    log = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality")).join(_docs(spark, sf_dir), "doc_id")
    log = log.select(F.col("doc_id").alias("batch"), F.when(F.col("quality") == 1, ingest.digest(F.col("text"))).otherwise("changed since").alias("digest"))
    return ingest.changes(now, log).select(F.col("batch").alias("doc_id"), "digest", "state")


def insert_only_merge(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("identity", F.md5(tx.fold(F.col("text")).cast("binary")))
    bank = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_semi")
    new = match.by_priority(docs.join(bank, "identity", "left_anti"), ["identity"], "doc_id")
    return ingest.merged(bank.select(F.col("doc_id").alias("id")), new.select(F.col("doc_id").alias("id")))


def rejection_reasons(spark, sf_dir):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    reason = F.when(words < 20, "too short").when(F.contains("text", F.lit("***")), "junk").when(F.col("lang") != "en", "not English")
    return quality.by_reason(_docs(spark, sf_dir), reason)


def fill_rates(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return match.fill_rates(match.fill_missing(_docs(spark, sf_dir).withColumn("quality", F.lit(None).cast("int")), labels, ["doc_id"], "quality"), "source", "quality")


def word_totals(spark, sf_dir):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return match.nested_counts(_docs(spark, sf_dir).select("source", words.alias("words")), "source", "words")


def overrides(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return match.overridden(_docs(spark, sf_dir).select("doc_id", F.lit(-1).alias("quality")), labels, "doc_id", "quality")


def byte_sizes(spark, sf_dir):
    from quern.functions import dates

    return _docs(spark, sf_dir).select("doc_id", dates.byte_size(F.col("n_chars") * 100).alias("size"))


def aligned_readings(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("n"), F.col("text").alias("q"))
    return match.aligned_readings(_docs(spark, sf_dir).select(F.col("doc_id").alias("n"), F.col("text").alias("q")), items)


_FUNCTIONS = (
    furniture_lines, strip_furniture, exact_dup_stems, first_wins_dedupe, norm_alnum, ocr_keys, english_share, latin_share, best_copies, term_counts, html_escaped,
    line_modes, idf_topk, change_detect, insert_only_merge, rejection_reasons, fill_rates, word_totals, overrides, byte_sizes, aligned_readings,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_FOLD = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_LINES = "SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents"
_FURNITURE = f"""SELECT line, count(DISTINCT doc_id) AS n_docs FROM ({_LINES}) WHERE length(line) BETWEEN 1 AND 40 AND NOT regexp_matches(line, '\\([a-d]\\)|^[0-9]{{1,3}}[.,] ')
    GROUP BY line HAVING count(DISTINCT doc_id) > 0.01 * (SELECT count(DISTINCT doc_id) FROM documents)"""
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]{{2,}}'), lambda w: w NOT IN ({_STOP}))"

ORACLE_SQL = {
    "furniture_lines": _FURNITURE,
    "strip_furniture": f"SELECT doc_id, count(*) AS kept_lines FROM ({_LINES}) WHERE line <> '' AND line NOT IN (SELECT line FROM ({_FURNITURE})) GROUP BY doc_id",
    "exact_dup_stems": f"""SELECT doc_id, first_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_FOLD}) AS first_doc_id FROM documents) WHERE doc_id <> first_doc_id""",
    "first_wins_dedupe": f"SELECT min(doc_id) AS doc_id, md5({_FOLD}) AS identity FROM documents GROUP BY md5({_FOLD})",
    "norm_alnum": """SELECT doc_id, length(n)::INT AS n, md5(n) AS hash FROM
        (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS n FROM documents)""",
    "ocr_keys": """SELECT doc_id, md5(translate(k, 'li', '11')) AS k1, md5(translate(k, 'lioszb', '110528')) AS k2 FROM
        (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM documents)""",
    "english_share": """SELECT doc_id, round(s, 6) AS share, s >= 0.45 AS english FROM (SELECT doc_id,
        CASE WHEN len(w) < 20 THEN 0.0::DOUBLE ELSE len(list_filter(w, lambda x: length(x) >= 4))::DOUBLE / len(w) END AS s
        FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents))""",
    "latin_share": r"""SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / greatest(len(regexp_extract_all(text, '\p{L}')), 1), 6) AS share FROM documents""",
    "best_copies": r"""SELECT source, md5(text) AS hash FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY
        len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / greatest(len(regexp_extract_all(text, '\p{L}')), 1) DESC, doc_id) AS k FROM documents) WHERE k = 1""",
    "term_counts": f"SELECT doc_id, len(t)::INT AS n_terms, len(list_distinct(t))::INT AS n_distinct FROM (SELECT doc_id, {_TERMS} AS t FROM documents)",
    "html_escaped": """SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')) AS hash FROM documents""",
    "line_modes": """SELECT source, line, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM
        (SELECT source, line, count(*) AS n, min({'d': doc_id, 'p': p}) AS f FROM
          (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM documents) GROUP BY source, line)) WHERE k = 1""",
    "idf_topk": f"""WITH b AS (SELECT item_id, term, 3 * count(*) AS tf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
        i AS (SELECT term, greatest(0.0, ln((SELECT count(*) FROM benchmark) / (1 + count(*))::DOUBLE)) AS idf FROM b GROUP BY term),
        q AS (SELECT doc_id, term, least(count(*), 3) AS c FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
        s AS (SELECT doc_id, item_id, sum(c * ln(1 + tf) * idf) AS score FROM q JOIN b USING (term) JOIN i USING (term) GROUP BY ALL HAVING sum(c * ln(1 + tf) * idf) > 0)
        SELECT doc_id, rank::INT AS rank, item_id, round(score, 6) AS score FROM
        (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s) WHERE rank <= 3""",
    "change_detect": """WITH d AS (SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents),
        l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
        SELECT doc_id, digest, CASE WHEN quality IS NULL THEN 'new' WHEN quality = 1 THEN 'unchanged' ELSE 'changed' END AS state FROM d LEFT JOIN l USING (doc_id)""",
    "insert_only_merge": f"""WITH d AS (SELECT doc_id, md5({_FOLD}) AS k FROM documents),
        bank AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM labels))
        SELECT doc_id AS id FROM bank UNION ALL SELECT min(doc_id) FROM d WHERE k NOT IN (SELECT k FROM bank) GROUP BY k""",
    "rejection_reasons": r"""SELECT CASE WHEN len(regexp_extract_all(text, '\S+')) < 20 THEN 'too short' WHEN contains(text, '***') THEN 'junk' WHEN lang <> 'en' THEN 'not English' ELSE 'accepted' END AS reason,
        count(*) AS n FROM documents GROUP BY ALL""",
    "fill_rates": "SELECT source, count(quality) AS got, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "word_totals": r"SELECT source, count(*) AS n, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS members FROM documents GROUP BY source",
    "overrides": "SELECT doc_id, coalesce(quality, -1)::INT AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "byte_sizes": """SELECT doc_id, CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b / 1024.0 < 1024 THEN printf('%.0f KB', round(b::DOUBLE / 1024)) ELSE printf('%.1f MB', b::DOUBLE / 1024 / 1024) END AS size
        FROM (SELECT doc_id, n_chars * 100 AS b FROM documents)""",
}
