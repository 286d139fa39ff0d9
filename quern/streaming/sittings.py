"""Per-key state machines over event streams: sittings with a time limit, mistake ladders, study runs.

Each takes a streaming (or batch-tested) DataFrame and returns one. State is small and
bounded per key; timeouts run on event time, so results don't depend on when a
micro-batch happens to run.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.progress import LADDER_DAYS, PAPER_MINUTES

_FIRST_DAY = dt.date(1970, 1, 1).toordinal()


def sittings(events: DataFrame, *, user: str = "user_id", ts: str = "ts", kind: str = "kind", minutes: int = PAPER_MINUTES, late: str = "10 minutes") -> DataFrame:
    """(user, start, submitted, answers) once a sitting is over.

    Kinds: start, answer, submit. A sitting ends by submit, or ``minutes`` after its start: what is
    emitted is start plus the limit, not the time it was noticed. Later answers are ignored.
    """
    limit = dt.timedelta(minutes=minutes)
    kind_of = events.schema[user].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, answers = state.get if state.exists else (None, 0)
        out = []

        def close(at: dt.datetime) -> None:
            nonlocal start, answers
            out.append((key[0], start, at, answers))
            start, answers = None, 0

        if state.hasTimedOut:
            close(start + limit)
        else:
            rows = pd.concat(list(frames)).sort_values([ts, kind], ascending=[True, False])  # of one instant: submit, start, answer
            for t, k in zip(rows[ts], rows[kind]):
                t = t.to_pydatetime()
                if start is not None and t > start + limit:
                    close(start + limit)
                if k == "start" and start is None:
                    start, answers = t, 0
                elif k == "answer" and start is not None:
                    answers += 1
                elif k == "submit" and start is not None:
                    close(t)
        if start is None:
            if state.exists:
                state.remove()
        else:
            state.update((start, answers))
            due = int((start + limit).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[user, "start", "submitted", "answers"])

    return events.withWatermark(ts, late).groupBy(user).applyInPandasWithState(
        step, f"`{user}` {kind_of}, start timestamp, submitted timestamp, answers int", "start timestamp, answers int", "append", GroupStateTimeout.EventTimeTimeout
    )


def _in_order(frames: Iterator[pd.DataFrame], ts: str, seq: str | None) -> pd.DataFrame:
    """A batch's rows by time; of one instant by ``seq``, or else by their other values, so that the order is the same in any run."""
    rows = pd.concat(list(frames))
    return rows.sort_values([ts, *([seq] if seq else [c for c in rows.columns if c != ts])], kind="stable")


def mistake_ladder(attempts: DataFrame, *, user: str = "user_id", item: str = "item", ts: str = "ts", right: str = "right", seq: str | None = None, buckets: int = 1024) -> DataFrame:
    """(user, item, step, due, done) after each batch in which an item's state changed.

    Rows are attempts of submitted papers. A null ``right`` clears the item by hand. State is three values for each item that
    was ever wrong and is kept; a row that comes after a later one of its item is taken as it comes.
    Items are kept by ``buckets`` of their hash, as a call and a stored row for each item would cost far more than its attempts do.
    A bucket's state is the states of its items.
    """
    types = [attempts.schema[c].dataType.simpleString() for c in (user, item)]
    order = [ts, *([seq] if seq else [c for c in attempts.columns if c not in (user, item, ts)])]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        before: dict[tuple, tuple] = {}
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        days = rows[ts].to_numpy().astype("datetime64[D]").astype("int64")  # since 1970, as an item's due day
        for who, what, day, ok in zip(rows[user].tolist(), rows[item].tolist(), days.tolist(), rows[right].tolist()):
            of = (who, what)
            old = now, due, done = held.get(of, (-1, None, False))
            if ok is None or pd.isna(ok):
                now, due, done = (now, None, True) if now >= 0 else old
            elif not ok:
                now, due, done = 0, day + LADDER_DAYS[0], False
            elif now >= 0 and not done:
                if now == len(LADDER_DAYS) - 1:
                    due, done = None, True
                else:
                    now += 1
                    due = day + LADDER_DAYS[now]
            if (now, due, done) != old:
                before.setdefault(of, old)
                held[of] = now, due, done
        changed = [(*of, *held[of]) for of, old in before.items() if held[of] != old]
        if changed:
            state.update((pickle.dumps(held),))
            out = pd.DataFrame(changed, columns=[user, item, "step", "due", "done"])
            out["due"] = [None if d is None else dt.date.fromordinal(_FIRST_DAY + d) for *_, d, _ in changed]
            yield out

    # keys travel as text, which no null turns into floats
    text = attempts.withColumns({user: F.col(user).cast("string"), item: F.col(item).cast("string"), "_bucket": F.pmod(F.xxhash64(user, item), F.lit(buckets)).cast("int")})
    found = text.groupBy("_bucket").applyInPandasWithState(step, f"`{user}` string, `{item}` string, step int, due date, done boolean", "held binary", "update", GroupStateTimeout.NoTimeout)
    return found.withColumns({user: F.col(user).cast(types[0]), item: F.col(item).cast(types[1])})


def run_streaks(runs: DataFrame, *, user: str = "user_id", ts: str = "ts", kind: str = "kind", seq: str | None = None) -> DataFrame:
    """(user, streak, done, voided) after each batch: done runs add to the streak, others zero it."""
    kind_of = runs.schema[user].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, done, voided = state.get if state.exists else (0, 0, 0)
        for k in _in_order(frames, ts, seq)[kind]:
            streak, done, voided = (streak + 1, done + 1, voided) if k == "done" else (0, done, voided + 1)
        state.update((streak, done, voided))
        yield pd.DataFrame([(key[0], streak, done, voided)], columns=[user, "streak", "done", "voided"])

    return runs.groupBy(user).applyInPandasWithState(step, f"`{user}` {kind_of}, streak int, done int, voided int", "streak int, done int, voided int", "update", GroupStateTimeout.NoTimeout)


def daily_totals(events: DataFrame, *, ts: str = "ts", value: str = "value", late: str = "1 day") -> DataFrame:
    """C13 as a stream: totals of each day, emitted once the watermark has passed it."""
    w = F.window(ts, "1 day")
    return events.withWatermark(ts, late).groupBy(w).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("day"), "n", "total")


def mirrored(stream: DataFrame, path: str, checkpoint: str):
    """The latest state written over a snapshot whenever it changes; ``path`` holds the last complete one."""

    def write(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
