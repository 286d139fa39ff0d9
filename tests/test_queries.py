"""Every query against its SQL on the small tables."""

import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quern.plans import bank, cases, landed, papers, registry

DATA = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
#: Plans over staged tables: their shapes repeat, so the smallest tables hold them all.
STAGED = (bank, cases, landed, papers)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def ducks():
    import duckdb

    out = {}
    for data in (DATA, SMALL):
        out[data] = duckdb.connect()
        for t in TABLES:
            out[data].sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return out


def plain(x):
    if isinstance(x, (Decimal, float)):
        return round(float(x), 6)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, ducks, name):
    data = SMALL if any(name in m.QUERIES for m in STAGED) else DATA
    df = registry.QUERIES[name](spark, data)
    rel = ducks[data].sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert table(df.columns, df.collect()) == table(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ladder_queries_by_brute_force(spark):
    from quern.operators.progress import LADDER_DAYS
    from quern.plans import events

    state = {}
    for e in sorted(spark.read.parquet(f"{DATA}/events.parquet").collect(), key=lambda r: r.event_id):
        if e.event_type not in ("purchase", "error"):
            continue
        key, day, old = (e.user_id, int(e.value) % 5), e.ts.date(), state.get((e.user_id, int(e.value) % 5))
        if e.event_type == "error":
            state[key] = (0, day + dt.timedelta(days=1), False)
        elif old and not old[2]:
            state[key] = (old[0], None, True) if old[0] == 4 else (old[0] + 1, day + dt.timedelta(days=LADDER_DAYS[old[0] + 1]), False)
    got = {(r.user_id, r.item): (r.step, r.due, r.done) for r in events.mistake_ladder(spark, DATA).collect()}
    assert got == state
    due = {r.user_id: r.n_due for r in events.due_queue(spark, DATA).collect()}
    want = {}
    for (u, _), (_, d, done) in state.items():
        if d and not done and d <= dt.date(2024, 2, 10):
            want[u] = want.get(u, 0) + 1
    assert due == want


def test_stream_ladder_equals_the_batch(spark):
    from quern.plans import events, streams

    rows = lambda df: sorted(tuple(r) for r in df.select("user_id", "item", "step", "done").collect())
    assert rows(streams.stream_ladder(spark, DATA)) == rows(events.mistake_ladder(spark, DATA))


def test_due_dates_count_every_revision(spark):
    from quern.operators.progress import REVISION_DAYS
    from quern.plans import events

    rows, want = {}, {}
    for e in spark.read.parquet(f"{DATA}/events.parquet").collect():
        rows.setdefault(e.user_id, []).append(e)
    for user, mine in rows.items():
        revised = {e.ts for e in mine if e.event_type == "signup"}
        if len({e.ts.hour for e in mine}) < 20:
            want[user] = None
        else:
            want[user] = (max(revised).date() + dt.timedelta(days=REVISION_DAYS[min(len(revised), 5) - 1]) - dt.date(2024, 1, 31)).days if revised else 0
    assert {r.user_id: r.due_in for r in events.spaced_due(spark, DATA).collect()} == want


def brute_key(bucket, a):
    n = len(a)
    cut = lambda v, k: [v[i : i + k] for i in range(0, n - n % k, k)]
    sizes = [k for k in range(5, n // 2 + 1) if n % k == 0]
    size = max(sizes, default=n)
    b = "".join(reversed(cut(a, size)))
    if bucket % 2:
        at = min(n, 7)
        b = b[: at - 1] + "X" + b[at:]
    agree = [k for k in sizes if sorted(cut(a, k)) == sorted(cut(b, k))]
    places = [cut(a, size).index(x) + 1 if x in cut(a, size) else 0 for x in cut(b, size)]
    five = cut(a, 5)
    return max(agree, default=None), sorted(cut(a, size)) == sorted(cut(b, size)), ",".join(map(str, places)), len(five) - len(set(five))


def test_key_blocks_of_whole_sequences(spark, tmp_path):
    import random

    from quern.plans import tables

    rnd = random.Random(4)
    lines = [(32 * s + o % 32, o // 32, rnd.choice("ANR")) for s, n in enumerate((1, 4, 5, 9, 10, 11, 39, 40, 41, 60, 97, 120, 121, 300, 301, 600, 601, 25)) for o in range(n)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for path in (DATA, str(tmp_path)):
        by = {}
        for r in sorted(spark.read.parquet(f"{path}/lineitem.parquet").collect(), key=lambda r: (r.l_orderkey, r.l_linenumber, r.l_returnflag)):
            by[r.l_orderkey // 32] = by.get(r.l_orderkey // 32, "") + r.l_returnflag
        want = {s: brute_key(s, a) for s, a in by.items()}
        assert {r.bucket: (r.block, r.ok, r.perm, r.repeats) for r in tables.key_blocks(spark, path).collect()} == want
    assert len(want) == 18


def test_ladder_states_are_kept_by_bucket(spark, tmp_path):
    """Over two batches: no state row for each item, states found again, null keys and clearing by hand."""
    from quern.streaming.sittings import mistake_ladder

    day = lambda d: dt.datetime(2024, 1, d)
    schema = "user_id long, item int, ts timestamp, right boolean"
    first = [(2**53 + u, u % 3, day(1), False) for u in range(1500)] + [(None, 1, day(1), False), (None, 2, day(1), True)]
    second = [(2**53 + u, u % 3, day(2), (True, False, None)[u % 3]) for u in range(0, 1500, 5)] + [(None, 1, day(3), True)]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = []
    q = mistake_ladder(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda b, _: got.append([tuple(r) for r in b.collect()])).start()
    q.awaitTermination()
    assert max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) <= 1024
    assert len(got[0]) == 1501 and set(got[0]) == {(*r[:2], 0, dt.date(2024, 1, 2), False) for r in first[:-1]}
    after = {0: (1, dt.date(2024, 1, 5), False), 1: (0, dt.date(2024, 1, 3), False), 2: (0, None, True)}
    assert sorted(got[1], key=repr) == sorted([(*r[:2], *after[r[1]]) for r in second[:-1]] + [(None, 1, 1, dt.date(2024, 1, 6), False)], key=repr)


@pytest.mark.parametrize("name", ("tidied_options", "option_faults", "parsed_in_trust", "parsed_papers"))
def test_parts_of_one_file_are_worked_on_by_all_cores(spark, name):
    assert registry.QUERIES[name](spark, DATA).rdd.getNumPartitions() >= 4
