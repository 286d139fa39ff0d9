"""Scores, schedules, streaks and sittings over the event log.

The log stands for answers and study runs: a purchase is a right answer or a finished
run, an error a wrong answer or a voided run, a signup a start.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import progress

TODAY = "2024-01-31"


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumns({"day": F.col("ts").cast("date"), "kind": F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "void")})


def score_sheet(spark, sf_dir):
    e = _events(spark, sf_dir)
    choice = F.when(F.col("event_type") == "purchase", "A").when(F.col("event_type") == "error", "B")
    cell = F.when(F.col("event_type") == "signup", "X").otherwise("AC")
    code = F.when(F.col("user_id") < 50, "gs1").otherwise("gs2")
    return progress.scored(e.select("user_id", choice.alias("choice"), cell.alias("cell"), code.alias("code")), group=["user_id"])


def dense_daily(spark, sf_dir):
    runs = _events(spark, sf_dir).filter("kind is not null").withColumn("mins", F.floor("value").cast("long"))
    first, last = F.date_sub(F.to_date(F.lit(TODAY)), progress.HISTORY_DAYS - 1), F.to_date(F.lit(TODAY))
    return progress.dense_days(runs, "user_id", first, last)


def goal_streak(spark, sf_dir):
    runs = _events(spark, sf_dir).filter("kind is not null").withColumn("mins", F.floor("value").cast("long"))
    days = progress.dense_days(runs, "user_id", F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-30")))
    return progress.goal_streaks(days, "user_id", F.to_date(F.lit("2024-01-30")), 15)


def spaced_due(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("event_type") == "signup", F.col("ts")))).alias("revised"), F.collect_set(F.hour("ts")).alias("ticked"))
    return e.select("user_id", progress.due_in(F.col("ticked"), F.lit(20), F.col("revised"), F.to_date(F.lit(TODAY))).alias("due_in"))


def mistake_ladder(spark, sf_dir):
    e = _events(spark, sf_dir).filter("kind is not null").select("user_id", (F.floor("value").cast("int") % 5).alias("item"), F.col("event_id").alias("seq"), (F.col("kind") == "done").alias("right"), F.col("day").alias("on"))
    return progress.ladder(e, ["user_id", "item"])


def due_queue(spark, sf_dir):
    return progress.due_queue(mistake_ladder(spark, sf_dir), F.to_date(F.lit("2024-02-10")), "user_id")


def run_streaks(spark, sf_dir):
    return progress.run_streaks(_events(spark, sf_dir).filter("kind is not null"), "user_id", "event_id").select("event_id", "streak")


def sittings(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return progress.sittings(e, "user_id", "ts", F.col("event_type") == "signup", F.col("event_type") == "purchase", minutes=7200)


def merged_stamps(spark, sf_dir):
    e = _events(spark, sf_dir)
    of = lambda kind: F.collect_list(F.when(F.col("event_type").isin(*kind), F.col("event_id")))
    both = e.groupBy("user_id").agg(of(("view", "click")).alias("a"), of(("click", "error")).alias("b"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return both.select("user_id", text(progress.merged_stamps(F.col("a"), F.col("b"))).alias("stamps"), F.size(progress.merged_ticks(F.col("a"), F.col("b"))).alias("ticks"))


def merged_picks(spark, sf_dir):
    e = _events(spark, sf_dir)
    days = F.dayofmonth("ts") % 7
    picks = lambda kind: F.map_from_entries(F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct(days.alias("k"), F.lit(kind).alias("v")))))))
    both = e.groupBy("user_id").agg(picks("view").alias("local"), picks("click").alias("backup")).withColumn("m", progress.merged_picks(F.col("local"), F.col("backup")))
    entries = F.array_sort(F.map_entries("m"))
    return both.select("user_id", F.array_join(F.transform(entries, lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"])), ",").alias("picks"))


def recent_runs(spark, sf_dir):
    return progress.recent_runs(_events(spark, sf_dir), "user_id", F.col("event_id").desc(), keep=60).groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("oldest"))


def dials(spark, sf_dir):
    minutes = progress.dial(F.col("value"))
    return _events(spark, sf_dir).select("event_id", minutes.alias("minutes"), F.round(progress.dial_point(minutes)["x"], 6).alias("x"), F.round(progress.dial_point(minutes)["y"], 6).alias("y"))


def answer_sheets(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", (F.col("event_id") % 2).alias("set"), (F.floor("value").cast("int") % 10).alias("n"), F.col("event_id").alias("seq"), F.col("event_type").alias("choice"))
    sheets = progress.sheet(e, "user_id", "set")
    return sheets.select("user_id", "set", F.size("sheet").alias("n"), F.array_join(F.map_values("sheet"), ",").alias("choices"))


_FUNCTIONS = (score_sheet, dense_daily, goal_streak, spaced_due, mistake_ladder, due_queue, run_streaks, sittings, merged_stamps, merged_picks, recent_runs, dials, answer_sheets)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_DAYS = """SELECT user_id, ts::DATE AS day, sum(CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT ELSE 0 END)::BIGINT AS minutes,
    count(CASE WHEN event_type = 'error' THEN 1 END) AS voided FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL"""
_USERS = "SELECT DISTINCT user_id FROM events WHERE event_type IN ('purchase', 'error')"
_STAMPS = "SELECT user_id, list_sort(list_distinct(list(event_id))) AS u FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id"
_IN = "a.step IS NOT NULL AND NOT a.done"
#: The ladder as a fold over an item's attempts: state and attempt are one kind of struct.
_LADDER = f"""SELECT user_id, item, list_reduce(log, lambda a, x: {{'r': x.r, 'd': x.d,
      'step': CASE WHEN NOT x.r THEN 0 WHEN {_IN} AND a.step < 4 THEN a.step + 1 ELSE a.step END,
      'due': CASE WHEN NOT x.r THEN x.d + 1 WHEN {_IN} THEN CASE WHEN a.step >= 4 THEN NULL ELSE x.d + [1, 3, 7, 21, 60][a.step + 2] END ELSE a.due END,
      'done': CASE WHEN NOT x.r THEN false WHEN {_IN} AND a.step >= 4 THEN true ELSE a.done END}}, {{'r': true, 'd': NULL::DATE, 'step': NULL::INT, 'due': NULL::DATE, 'done': false}}) AS s
    FROM (SELECT user_id, (floor(value)::INT % 5)::INT AS item, list({{'r': event_type = 'purchase', 'd': ts::DATE, 'step': NULL::INT, 'due': NULL::DATE, 'done': false}} ORDER BY event_id) AS log
      FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL)"""
ORACLE_SQL = {
    "score_sheet": """SELECT user_id, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS "right", count(CASE WHEN event_type = 'error' THEN 1 END) AS wrong,
        count(CASE WHEN event_type IN ('view', 'click') THEN 1 END) AS blank, count(CASE WHEN event_type = 'signup' THEN 1 END) AS dropped,
        sum(CASE event_type WHEN 'purchase' THEN CASE WHEN user_id < 50 THEN 2.00 ELSE 2.50 END WHEN 'error' THEN CASE WHEN user_id < 50 THEN -0.66 ELSE -0.83 END ELSE 0.00 END)::DECIMAL(17,2) AS marks,
        3 * sum(CASE event_type WHEN 'purchase' THEN CASE WHEN user_id < 50 THEN 2.00 ELSE 2.50 END WHEN 'error' THEN CASE WHEN user_id < 50 THEN -0.66 ELSE -0.83 END ELSE 0.00 END)
          >= sum(CASE WHEN event_type = 'signup' THEN 0 WHEN user_id < 50 THEN 2.00 ELSE 2.50 END) AS qualifies FROM events GROUP BY user_id""",
    "dense_daily": f"""SELECT user_id, day::DATE AS day, coalesce(minutes, 0) AS minutes, coalesce(voided, 0) AS voided
        FROM ({_USERS}) CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-18', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) LEFT JOIN ({_DAYS}) USING (user_id, day)""",
    "goal_streak": f"""WITH met AS (SELECT user_id, day FROM ({_DAYS}) WHERE minutes >= 15),
        past AS (SELECT user_id, count(*) AS n FROM (SELECT user_id, day + row_number() OVER (PARTITION BY user_id ORDER BY day DESC)::INT AS e FROM met WHERE day < DATE '2024-01-30') WHERE e = DATE '2024-01-30' GROUP BY user_id)
        SELECT user_id, coalesce(n, 0) + CASE WHEN (user_id, DATE '2024-01-30') IN (SELECT (user_id, day) FROM met) THEN 1 ELSE 0 END AS streak FROM ({_USERS}) LEFT JOIN past USING (user_id)""",
    "spaced_due": """SELECT user_id, CASE WHEN t < 20 THEN NULL WHEN coalesce(len(r), 0) = 0 THEN 0 ELSE date_diff('day', DATE '2024-01-31', list_max(r)::DATE + [3, 7, 21, 60, 120][least(len(r), 5)]::INT) END::INT AS due_in
        FROM (SELECT user_id, count(DISTINCT hour(ts)) AS t, list(DISTINCT ts) FILTER (event_type = 'signup') AS r FROM events GROUP BY user_id)""",
    "mistake_ladder": f"SELECT user_id, item, s.step AS step, s.due AS due, s.done AS done FROM ({_LADDER}) WHERE s.step IS NOT NULL",
    "due_queue": f"""SELECT user_id, count(*) AS n_due, arg_min(item, {{'d': s.due, 'i': item}}) AS first_item FROM ({_LADDER})
        WHERE s.step IS NOT NULL AND NOT s.done AND s.due <= DATE '2024-02-10' GROUP BY user_id""",
    "run_streaks": """WITH s AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events WHERE event_type IN ('purchase', 'error'))
        SELECT event_id, (sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id))::BIGINT AS streak FROM s""",
    "sittings": """WITH n AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
        b AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id, k) AS start FROM n WHERE k > 0),
        e AS (SELECT *, least(coalesce(min(CASE WHEN event_type = 'purchase' AND ts <= start + INTERVAL 7200 MINUTES THEN ts END) OVER (PARTITION BY user_id, k), start + INTERVAL 7200 MINUTES), start + INTERVAL 7200 MINUTES) AS submitted FROM b)
        SELECT user_id, start, submitted, count(CASE WHEN ts <= submitted AND event_type NOT IN ('signup', 'purchase') THEN 1 END) AS answers, count(CASE WHEN ts > submitted THEN 1 END) AS ignored FROM e GROUP BY user_id, start, submitted""",
    "merged_stamps": f"SELECT user_id, array_to_string(u[-12:], ',') AS stamps, len(u)::INT AS ticks FROM ({_STAMPS})",
    "merged_picks": """SELECT user_id, string_agg(k || ':' || v, ',' ORDER BY k) AS picks FROM (SELECT user_id, day(ts) % 7 AS k,
        CASE WHEN count(CASE WHEN event_type = 'view' THEN 1 END) > 0 THEN 'view' ELSE 'click' END AS v FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL) GROUP BY user_id""",
    "recent_runs": """SELECT user_id, count(*) AS n, min(event_id) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 60 GROUP BY user_id""",
    "dials": """SELECT event_id, m AS minutes, round(100 + 84 * sin(m / 60.0::DOUBLE * 2 * pi()), 6) AS x, round(100 - 84 * cos(m / 60.0::DOUBLE * 2 * pi()), 6) AS y FROM
        (SELECT event_id, least(60, greatest(1, floor(value + 0.5)::INT)) AS m FROM events)""",
    "answer_sheets": """SELECT user_id, "set", count(*)::INT AS n, string_agg(c, ',' ORDER BY n0) AS choices FROM
        (SELECT user_id, event_id % 2 AS "set", floor(value)::INT % 10 AS n0, arg_max(event_type, event_id) AS c FROM events GROUP BY ALL) GROUP BY user_id, "set" """,
}
