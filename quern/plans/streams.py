"""Streams over the event log, run to the end of what is there; their results equal the batch queries'."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans import events
from quern.sources import sinks
from quern.streaming import sittings as st


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; timestamps without zone are taken as UTC, as watermarks need an instant."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "kind": F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "void")})


def _finished(stream: DataFrame, mode: str, what: str) -> DataFrame:
    """All rows that the stream has emitted, with their epoch, from a table in the shared folder."""
    spark = stream.sparkSession
    out, checkpoint = sinks.shared_folder(spark, f"{what}-rows"), sinks.shared_folder(spark, f"{what}-state")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("int")).write.mode("overwrite").parquet(f"{out}/{epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def _latest(rows: DataFrame, *keys: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "epoch").alias("s")).select(*keys, "s.*")


def stream_day_totals(spark, sf_dir):
    rows = _finished(st.daily_totals(_stream(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)"))), "update", "days")
    return _latest(rows, "day").select(F.col("day").cast("date").alias("day"), "n", F.col("total").cast("double").alias("total"))


def stream_run_streaks(spark, sf_dir):
    return _latest(_finished(st.run_streaks(_stream(spark, sf_dir).filter("kind is not null")), "update", "streaks"), "user_id")


def stream_ladder(spark, sf_dir):
    attempts = _stream(spark, sf_dir).filter("kind is not null").select("user_id", (F.floor("value").cast("int") % 5).alias("item"), "ts", (F.col("kind") == "done").alias("right"))
    return _latest(_finished(st.mistake_ladder(attempts), "update", "ladder"), "user_id", "item")


def stream_cleared(spark, sf_dir):
    """The ladder with items that are cleared by hand: a signup clears the item of its value."""
    rows = _stream(spark, sf_dir).filter("event_type in ('purchase', 'error', 'signup')")
    right = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    attempts = rows.select("user_id", (F.floor("value").cast("int") % 5).alias("item"), "ts", "event_id", right.alias("right"))
    return _latest(_finished(st.mistake_ladder(attempts, seq="event_id"), "update", "cleared"), "user_id", "item")


def stream_sittings(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "submit").otherwise("answer")
    rows = _stream(spark, sf_dir).select("user_id", "ts", kind.alias("kind"))
    return _finished(st.sittings(rows, minutes=7200), "append", "sittings").drop("epoch")


def stream_mirror(spark, sf_dir):
    """The latest totals by kind, read from the snapshot that the stream writes."""
    path, checkpoint = sinks.shared_folder(spark, "mirror"), sinks.shared_folder(spark, "mirror-state")
    totals = _stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    st.mirrored(totals, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sinks.restored(spark, path, "event_type string, n long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (stream_day_totals, stream_run_streaks, stream_ladder, stream_cleared, stream_sittings, stream_mirror)}

_CLEARED = (
    events._LADDER.replace("'step': CASE WHEN NOT x.r", "'step': CASE WHEN x.r IS NULL THEN a.step WHEN NOT x.r").replace("'due': CASE WHEN NOT x.r", "'due': CASE WHEN x.r IS NULL THEN CASE WHEN a.step IS NULL THEN a.due END WHEN NOT x.r")
    .replace("'done': CASE WHEN NOT x.r", "'done': CASE WHEN x.r IS NULL THEN a.step IS NOT NULL OR a.done WHEN NOT x.r").replace("{'r': event_type = 'purchase',", "{'r': CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END,")
    .replace("IN ('purchase', 'error')", "IN ('purchase', 'error', 'signup')")
)
_LIMIT = "a.start + INTERVAL 7200 MINUTES"
_CLOSED = "list_append(a.out, {{'start': a.start, 'submitted': {}, 'answers': a.answers}})"
#: Sittings as a fold: before each event an open sitting is held against the limit. One that is open at the end is out once the watermark has passed its limit.
_SITTINGS = f"""WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'submit' ELSE 'answer' END AS kind FROM events),
    two AS (SELECT user_id, ts, kind AS b, part, CASE part WHEN 0 THEN 'tick' ELSE kind END AS kind FROM e, (VALUES (0), (1)) q(part)),
    log AS (SELECT user_id, list({{'t': ts, 'k': kind, 'start': NULL::TIMESTAMP, 'answers': 0, 'out': []::STRUCT("start" TIMESTAMP, submitted TIMESTAMP, answers INTEGER)[]}} ORDER BY ts, b DESC, part) AS log FROM two GROUP BY user_id),
    f AS (SELECT user_id, list_reduce(log, lambda a, x: {{'t': x.t, 'k': x.k,
        'start': CASE WHEN x.k = 'tick' THEN CASE WHEN x.t > {_LIMIT} THEN NULL ELSE a.start END WHEN x.k = 'start' THEN coalesce(a.start, x.t) WHEN x.k = 'submit' THEN NULL ELSE a.start END,
        'answers': CASE WHEN x.k = 'tick' THEN CASE WHEN x.t > {_LIMIT} THEN 0 ELSE a.answers END WHEN x.k = 'answer' AND a.start IS NOT NULL THEN a.answers + 1 WHEN x.k = 'submit' THEN 0 WHEN x.k = 'start' AND a.start IS NULL THEN 0 ELSE a.answers END,
        'out': CASE WHEN x.k = 'tick' AND x.t > {_LIMIT} THEN {_CLOSED.format(_LIMIT)} WHEN x.k = 'submit' AND a.start IS NOT NULL THEN {_CLOSED.format("x.t")} ELSE a.out END}},
        {{'t': NULL::TIMESTAMP, 'k': NULL::VARCHAR, 'start': NULL::TIMESTAMP, 'answers': 0, 'out': []::STRUCT("start" TIMESTAMP, submitted TIMESTAMP, answers INTEGER)[]}}) AS a FROM log),
    o AS (SELECT user_id, unnest(a.out) AS s FROM f UNION ALL
      SELECT user_id, {{'start': a.start, 'submitted': {_LIMIT}, 'answers': a.answers}} FROM f WHERE {_LIMIT} <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events))
    SELECT user_id, s.start AS start, s.submitted AS submitted, s.answers AS answers FROM o"""
ORACLE_SQL = {
    "stream_cleared": f"SELECT user_id, item, s.step AS step, s.due AS due, s.done AS done FROM ({_CLEARED}) WHERE s.step IS NOT NULL",
    "stream_sittings": _SITTINGS,
    "stream_mirror": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_ladder": events.ORACLE_SQL["mistake_ladder"],
    "stream_day_totals": "SELECT ts::DATE AS day, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL",
    "stream_run_streaks": """SELECT user_id, count(CASE WHEN event_type = 'purchase' AND ts > last THEN 1 END)::INT AS streak, count(CASE WHEN event_type = 'purchase' THEN 1 END)::INT AS done,
        count(CASE WHEN event_type = 'error' THEN 1 END)::INT AS voided FROM (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id), TIMESTAMP '1970-01-01') AS last
        FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY user_id""",
}
