"""Parsers, keys and study progress over papers staged from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import match, parse, progress, repair, sequences
from quern.plans.bank import QUESTIONS, _cte, _stage
from quern.plans.cases import parts


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark, sf_dir, shape: str):
    """(doc, text): a shape for each part, its name for {w} and key for {k}."""
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("doc"), F.replace(F.replace(F.lit(shape), F.lit("{w}"), F.col("p_name")), F.lit("{k}"), F.col("p_partkey").cast("string")).alias("text"))


PAPER = """GENERAL STUDIES
1. Which of these is a {w}?
1. One thing
2. Another thing
(a) 1 only (b) 2 only
(c) Both 1 and 2 (d) Neither 1 nor 2
advert line
( 3 - A )
17
2. A second {w}
(a) w
(b) x c) y (d) z {k}
advert line
84. A third, its number misread
(a) a (b) b (c) c (d) d"""


def parsed_papers(spark, sf_dir):
    found = parse.parsed(_texts(spark, sf_dir, PAPER), 100, pages=2)
    return found.select("doc", "n", "read", "q", F.array_join("options", "|").alias("options"))


def parsed_in_trust(spark, sf_dir):
    found = parse.parsed(_texts(spark, sf_dir, PAPER), 100, pages=2, trust_sequence=True)
    return found.select("doc", "n", "read", "q", F.array_join("options", "|").alias("options"))


def parsed_in_any_order(spark, sf_dir):
    text = "1. A {w} (a) w (b) x (c) y (d) z 3. It says 7. {k} here, (a) mark? (a) w (b) {w} (c) y (d) z 2. B (a) w (b) x (c) y"
    return parse.parsed_numbered(_texts(spark, sf_dir, text)).select("doc", "n", F.trim("q").alias("q"), F.array_join("options", "|").alias("options"))


def labelled_copies(spark, sf_dir):
    """Of several copies of a number, the one with the larger share of Latin letters."""
    found = parse.parsed_labelled(_texts(spark, sf_dir, "Q.1) एक {w} Q.2) two {k} Q.1) all of {w}")).withColumn("id", F.concat_ws("-", "doc", "n"))
    return match.best_copies(found, "id", "body", "seq").select("id", F.trim("body").alias("body"))


def labelled_solutions(spark, sf_dir):
    text = "Q.1) Ans) b Exp) Because {w}. Option (b) is correct. Subject:) Polity Topic:) {w} Subtopic:) x Q.2) Ans) C Plain {k}"
    return _solutions(parse.parsed_solutions(_texts(spark, sf_dir, text), "labelled"))


def plain_solutions(spark, sf_dir):
    return _solutions(parse.parsed_solutions(_texts(spark, sf_dir, "Q 5. A text {w}; option d is the correct Q 6. B more Q 5. C again"), "plain"))


def tabled_solutions(spark, sf_dir):
    return _solutions(parse.parsed_solutions(_texts(spark, sf_dir, "1.(a) 2.(c) Q 1. Answer: (b) Explanation: so {w}"), "tabled", subject="Geography"))


def _solutions(found):
    return found.select("doc", "n", "answer", F.array_join("also", ",").alias("also"), F.trim("body").alias("body"), "hint")


def passages_of_groups(spark, sf_dir):
    """Each nation is a paper of eight numbers; its second and sixth are under directions."""
    n = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n")
    block = (
        F.when(F.col("n") == 2, F.concat(F.lit("Directions for the following 3 (three) items: Read this. Passage - 1 About "), F.col("name")))
        .when(F.col("n") == 4, F.lit("Passage - 2 More")).when(F.col("n") == 6, F.lit("Directions for the following 2 (two) items: shared facts"))
    )
    blocks = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("paper"), F.col("n_name").alias("name"), n).select("paper", "n", block.alias("block"))
    return parse.parsed_passages(blocks)


OPTIONS = {
    "I only~Il only~I and Il only~I, II and Ill": "I only~II only~I and II only~I, II and III", "prose~I only~more {w}~x": "prose~I only~more {w}~x",
    "1 and 2 only~2 and 8 only~1 only~1, 2 and 38 only": "1 and 2 only~2 and 3 only~1 only~1, 2 and 3 only", "3-1-2~8-1-2~1-2-3~2 - 1 - 3": "3-1-2~3-1-2~1-2-3~2-1-3",
    "{w}~b~c~d": "{w}~b~c~d", "I and II~II and II~I, II and III~III only": "I and II~II and III~I, II and III~III only",
}


def tidied_options(spark, sf_dir):
    staged = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.lit("Consider: 1. a 2. b 3. c").alias("q"), F.split(F.replace(
        F.element_at(F.array(*[F.lit(x) for x in OPTIONS]), (F.col("p_partkey") % len(OPTIONS) + 1).cast("int")), F.lit("{w}"), F.col("p_name")), "~", -1).alias("options"))
    return repair.tidied_questions(staged).select("id", F.array_join("options", "~").alias("options"))


# --- keys -------------------------------------------------------------------------------------------------

#: Four series of a key. By nation: blocks of five, blocks of different lengths, blocks that are too short, no permutation at all.
SERIES = {
    0: ("ABCDAABCDBDDCBA", "DDCBAABCDAABCDB", "ABCDBDDCBAABCDA", "ABCDAABCDBDDCBA"), 1: ("ABCDACCBBDDADABC", "DABCABCDACCBBDDA", "CCBBDDADABCABCDA", "CCBBDDAABCDADABC"),
    2: ("ABCDXXXABBA", "XXXABBAABCD", "ABCDXXXABBA", "ABBAXXXABCD"), 3: ("AAAABBBBCCCC", "AAAABBBBCCCC", "AAAABBBBCCCC", "AAAABBBBCCCX"),
}


def _papers(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    cells = lambda s: F.element_at(F.array(*[F.lit(SERIES[k][s]) for k in SERIES]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return n.select(F.col("n_nationkey").alias("paper"), *[cells(s).alias(x) for s, x in enumerate("ABCD")])


def verified_keys(spark, sf_dir):
    return sequences.verified_keys(_papers(spark, sf_dir)).select("paper", F.col("block").cast("int").alias("block"), F.array_join(F.transform("lengths", lambda x: x.cast("string")), ",").alias("lengths"), "ok", "why")


def surviving_mutations(spark, sf_dir):
    return sequences.surviving_mutations(_papers(spark, sf_dir).filter("paper % 4 = 0"), 5, id="paper").select("paper", "tried", "survived")


def grid_keys(spark, sf_dir):
    """Lines of a key: a header, rows in any order, one row twice, and a paper with a gap."""
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"))
    shapes = ("Answers", "SET B A", "2 C D", "1 A B", "2 X X", "3 B  A")
    lines = n.select("doc", F.posexplode(F.array(*[F.lit(x) for x in shapes])).alias("seq", "line")).filter("doc % 3 <> 0 or seq <> 5")
    return sequences.parsed_grid(lines, 3).select("doc", "set", F.array_join("letters", "").alias("letters"))


def keys_to_write(spark, sf_dir):
    n = _read(spark, sf_dir, "nation")
    keys = n.select((F.col("n_nationkey") % 20).alias("year"), F.lit("gs1").alias("code"), F.lit("A").alias("set"), F.col("n_name").alias("letters"))
    written = n.filter("n_nationkey between 10 and 14").select(F.col("n_nationkey").alias("year"), F.lit("gs1").alias("code"), F.lit("A").alias("set"))
    return sequences.keys_to_write(keys, written).select("year", "letters", "refused")


# --- progress ---------------------------------------------------------------------------------------------


def _answers(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select("user_id", (F.col("event_id") % 3).alias("paper"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "error", "B").alias("choice"), F.when(F.col("event_id") % 5 == 0, "X").otherwise("AC").alias("cell"), "ts", F.floor("value").alias("v"))


def retakes(spark, sf_dir):
    a = _answers(spark, sf_dir)
    kept = progress.retaken(a, "mistakes").withColumn("how", F.lit("mistakes")).unionByName(progress.retaken(a, "all").withColumn("how", F.lit("all")))
    return kept.groupBy("how", "user_id").agg(F.count("*").alias("kept"))


def submitted_mistakes(spark, sf_dir):
    """The ladder of attempts on submitted sheets: of users and papers with a right answer of value five or more."""
    a = _answers(spark, sf_dir)
    submissions = a.filter("choice = 'A' and v >= 5").select("user_id", "paper").distinct()
    attempts = a.filter("choice is not null").select("user_id", "paper", (F.col("v").cast("int") % 5).alias("item"), "seq", (F.col("choice") == "A").alias("right"), F.col("ts").cast("date").alias("on"))
    return progress.ladder(progress.from_submitted(attempts, submissions, ["user_id", "paper"]), ["user_id", "paper", "item"])


def searched_parts(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", F.initcap("p_name").alias("name"))
    return progress.searched(p, "name", " RING ").select("p_partkey", "marked")


def several_papers(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", F.slice(F.array(F.lit("gs1"), F.lit("gs2"), F.lit("essay")), F.lit(1), (F.col("p_partkey") % 4).cast("int")).alias("papers"))
    return progress.in_several_papers(p).select("p_partkey", F.size("papers").alias("n"))


def offered_series(spark, sf_dir):
    q = _stage(spark, sf_dir, QUESTIONS).filter("year is not null").select("year", F.when(F.col("year") != 2003, F.col("series")).alias("set"))
    return progress.offered_series(q, ["year"]).select("year", F.array_join("series", "").alias("series"))


def offered_papers(spark, sf_dir):
    years = _read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return progress.papers_with_questions(years, _stage(spark, sf_dir, QUESTIONS).filter("year is not null"), ["year"])


def customers_of_facet(spark, sf_dir):
    return progress.facet(_read(spark, sf_dir, "customer"), c_mktsegment="HOUSEHOLD", c_nationkey=None).select("c_custkey")


_FUNCTIONS = (
    parsed_papers, parsed_in_trust, parsed_in_any_order, labelled_copies, labelled_solutions, plain_solutions, tabled_solutions, passages_of_groups, tidied_options,
    verified_keys, surviving_mutations, grid_keys, keys_to_write, retakes, submitted_mistakes, searched_parts, several_papers, offered_series, offered_papers, customers_of_facet,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _values(*rows: tuple) -> str:
    """A table of constant rows; texts with {w} and {k} are filled in where they are used."""
    said = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({', '.join(map(said, r))})" for r in rows) + ")"


def _filled(c: str) -> str:
    return f"replace(replace({c}, '{{w}}', p_name), '{{k}}', p_partkey::VARCHAR)"


_FIRST = ("Which of these is a {w}? 1. One thing 2. Another thing", "1 only|2 only|Both 1 and 2|Neither 1 nor 2")
_THIRD = "84. A third, its number misread"


def _parsed_sql(*rows: tuple) -> str:
    return f"SELECT p_partkey AS doc, n, read, {_filled('q')} AS q, {_filled('o')} AS options FROM part, {_values(*rows)} v(n, read, q, o)"


def _solution_sql(*rows: tuple) -> str:
    return f"SELECT p_partkey AS doc, n, a AS answer, l AS also, {_filled('b')} AS body, {_filled('h')} AS hint FROM part, {_values(*rows)} v(n, a, l, b, h)"


_VERDICTS = {0: (5, "5,5,5", True, None), 1: (None, "5,7,4", True, None), 2: (None, "4,3,4", False, "blocks too short"), 3: (None, "", False, "no permutation")}
ORACLE_SQL = {
    "parsed_papers": _parsed_sql((1, True, *_FIRST), (2, True, "A second {w}", f"w|x|y|z {{k}} {_THIRD}|a|b|c|d")),
    "parsed_in_trust": _parsed_sql((1, True, *_FIRST), (2, True, "A second {w}", "w|x|y|z {k}"), (3, False, "A third, its number misread", "a|b|c|d")),
    "parsed_in_any_order": f"""SELECT p_partkey AS doc, n, {_filled('q')} AS q, {_filled('o')} AS options FROM part, {_values((1, 'A {w}', 'w|x|y|z'), (3, 'It says 7. {k} here, (a) mark?', 'w|{w}|y|z'), (2, 'B (a) w (b) x (c) y', None))} v(n, q, o)""",
    "labelled_copies": f"SELECT p_partkey || '-' || n AS id, {_filled('b')} AS body FROM part, {_values((1, 'all of {w}'), (2, 'two {k}'))} v(n, b)",
    "labelled_solutions": _solution_sql((1, "b", "b", "Because {w}. Option (b) is correct. Subject:) Polity Topic:) {w} Subtopic:) x", "Polity / {w}"), (2, "c", "", "Plain {k}", "")),
    "plain_solutions": _solution_sql((5, "a", "d", "text {w}; option d is the correct", ""), (6, "b", "", "more", "")),
    "tabled_solutions": _solution_sql((1, "b", "a", "so {w}", "Geography"), (2, "c", "", "", "Geography")),
    "passages_of_groups": """SELECT n_nationkey AS paper, n, n BETWEEN 2 AND 4 OR n BETWEEN 6 AND 7 AS in_group,
        CASE WHEN n BETWEEN 2 AND 3 THEN n_nationkey || '-p2' WHEN n = 4 THEN n_nationkey || '-p4' WHEN n BETWEEN 6 AND 7 THEN n_nationkey || '-p6' END AS passage,
        CASE WHEN n BETWEEN 2 AND 3 THEN 'About ' || n_name WHEN n = 4 THEN 'More' WHEN n BETWEEN 6 AND 7 THEN 'shared facts' END AS shared FROM nation, (SELECT unnest(range(1, 9))::INT AS n)""",
    "tidied_options": "SELECT p_partkey AS id, CASE p_partkey % " + f"{len(OPTIONS)} " + " ".join(f"WHEN {k} THEN replace('{v}', '{{w}}', p_name)" for k, v in enumerate(OPTIONS.values())) + " END AS options FROM part",
    "verified_keys": f"SELECT n_nationkey AS paper, b AS block, l AS lengths, ok, why FROM nation JOIN {_values(*((k, *v) for k, v in _VERDICTS.items()))} v(k, b, l, ok, why) ON n_nationkey % 4 = k",
    "surviving_mutations": "SELECT n_nationkey AS paper, 60 AS tried, 0 AS survived FROM nation WHERE n_nationkey % 4 = 0",
    "grid_keys": """SELECT n_nationkey AS doc, s AS "set", l AS letters FROM nation, (VALUES ('B', 'ACB'), ('A', 'BDA')) q(s, l) WHERE n_nationkey % 3 <> 0""",
    "keys_to_write": """SELECT n_nationkey % 20 AS year, n_name AS letters, CASE WHEN n_nationkey BETWEEN 10 AND 14 THEN 'written already' WHEN n_nationkey % 20 < (SELECT count(*) FROM nation) - 20 THEN 'given twice' END AS refused FROM nation""",
    "retakes": "SELECT 'mistakes' AS how, user_id, count(*) AS kept FROM events WHERE event_type = 'purchase' AND event_id % 5 <> 0 GROUP BY user_id",
    "searched_parts": """SELECT p_partkey, replace(n, 'Ring', '<mark>Ring</mark>') AS marked FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS n FROM part) WHERE contains(lower(n), 'ring')""",
    "several_papers": "SELECT p_partkey, (p_partkey % 4)::INT AS n FROM part WHERE p_partkey % 4 > 1",
    "offered_series": f"SELECT year, CASE WHEN year = 2003 THEN 'ABCD' ELSE string_agg(DISTINCT series, '' ORDER BY series) END AS series FROM {_cte(QUESTIONS)} WHERE year IS NOT NULL GROUP BY year",
    "offered_papers": f"SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) IN (SELECT year FROM {_cte(QUESTIONS)})",
    "customers_of_facet": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD'",
}


def _submitted_sql() -> str:
    from quern.plans.events import _LADDER

    inner = _LADDER.replace("user_id, item,", "user_id, paper, item,").replace("SELECT user_id, (floor", "SELECT user_id, event_id % 3 AS paper, (floor").replace(
        "WHERE event_type IN ('purchase', 'error')", "WHERE event_type IN ('purchase', 'error') AND (user_id, event_id % 3) IN (SELECT (user_id, event_id % 3) FROM events WHERE event_type = 'purchase' AND floor(value) >= 5)")
    return f"SELECT user_id, paper, item, s.step AS step, s.due AS due, s.done AS done FROM ({inner}) WHERE s.step IS NOT NULL"


ORACLE_SQL["submitted_mistakes"] = _submitted_sql()
