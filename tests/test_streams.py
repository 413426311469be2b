import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import folds
from lectern.operators import ledger as lg
from lectern.streaming import budgets

SCHEMA = "session string, ts timestamp, event_id long, op string, n double"


def at(seconds):
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=seconds)


def plain(events, cap, room):
    """Outcomes by event, session by session, over all events in order."""
    out, state = {}, {}
    for s, ts, k, op, n in sorted(events, key=lambda e: (str(e[0]), e[1], e[2])):
        spent, limit, left, ends = state.get(s, (0.0, cap, room, None))
        if n is None:
            what = "invalid"
        elif op == "spend":
            what = "late" if ends and ts >= ends else "accepted" if limit - spent >= n else "refused"
            spent += n if what == "accepted" else 0
        elif op == "extend":
            what = "granted" if n <= left else "waiting"
            left, limit = (left - n, limit + n) if what == "granted" else (left, limit)
        elif op == "limit":
            what = "changed" if n >= 0 else "invalid"
            limit = n if n >= 0 else limit
        elif op == "turn":
            what, ends = "begun", ts + dt.timedelta(seconds=n)
        else:
            what = "invalid"
        state[s] = spent, limit, left, ends
        out[k] = (s, op, what, spent, limit, left)
    return out


def test_a_stream_of_files_equals_one_pass(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.choice(["a", "b", "c", None]), at(10 * i), i, rng.choice(["spend"] * 6 + ["extend", "limit", "turn", "odd"]), rng.choice([None, -1.0, 3.0, 20.0, 45.0])) for i in range(120)]
    folder = str(tmp_path / "in")
    stream = lambda: budgets.live_budgets(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), 100.0, 30.0)
    for part in range(3):  # later files come after the stream has been stopped and goes on from its checkpoint
        spark.createDataFrame(events[part * 40 : part * 40 + 40], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        out = budgets.drain(stream(), str(tmp_path / "q"))
    got = {r.event_id: (r.session, r.op, r.outcome, r.spent, r.cap, r.room) for r in out.filter("event_id >= 0").collect()}
    assert out.filter("event_id >= 0").count() == 120
    assert got == plain(events, 100.0, 30.0)


def test_timers_say_when_a_turn_is_over(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("a", at(0), 1, "turn", 60.0), ("a", at(30), 2, "spend", 1.0), ("a", at(61), 3, "spend", 1.0), ("b", at(0), 4, "turn", 5000.0), ("c", at(100), 5, "spend", 1.0), ("d", at(0), 6, "turn", 5.0), ("d", at(1), 7, "turn", 5000.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    out = budgets.drain(budgets.live_budgets(spark.readStream.schema(SCHEMA).parquet(folder), 100.0), str(tmp_path / "q"))
    assert sorted((r.session, r.event_id, r.outcome) for r in out.collect()) == [("a", -1, "over"), ("a", 1, "begun"), ("a", 2, "accepted"), ("a", 3, "late"), ("b", 4, "begun"), ("c", 5, "accepted"), ("d", 6, "begun"), ("d", 7, "begun")]


@pytest.fixture(scope="module")
def hot(spark):
    """One user with most of the events."""
    n = 60_000
    return spark.range(n).select(F.when(F.col("id") % 20 == 0, F.col("id") % 300).otherwise(-1).alias("u"), F.col("id").alias("i"), (F.xxhash64("id") % 50 + 49).cast("double").alias("n"))


def test_long_groups_are_folded_in_their_order(hot):
    want, room = {}, {}
    for r in sorted(hot.collect()):
        accepted, spent = want.get(r.u, (0, 0.0))
        want[r.u] = (accepted + 1, spent + r.n) if 5000 - spent >= r.n else (accepted, spent)
        granted, waiting, left = room.get(r.u, (0, 0, 900.0))
        room[r.u] = (granted + 1, waiting, left - r.n) if r.n <= left else (granted, waiting + 1, left)
    assert {r.u: (r.accepted, r.spent) for r in lg.spend(hot, ["u"], ["i"], "n", 5000.0).collect()} == want
    assert {r.u: (r.granted, r.waiting, r.room_left) for r in lg.extensions(hot, ["u"], ["i"], "n", 900.0).collect()} == room


def test_updates_of_a_long_group_are_composed(spark, monkeypatch):
    x = F.array(F.lit(1.0), *((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0) for k in range(8)))
    rows = spark.range(9000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(99).alias("u"), F.col("id").alias("i"), F.when(F.col("id") % 9 == 0, "odd").otherwise("ocr").alias("action"), F.when(F.col("id") % 31 != 0, x).alias("x"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0).alias("reward"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {(r.u, r.action): r.theta for r in lg.learn_router(rows, ["u"], ["i"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.i):
        w = want.setdefault((r.u, r.action), np.array(lg.PRIOR["ocr"]) if r.action == "ocr" else None)
        if w is not None and r.x is not None:
            v = np.array(r.x)
            want[r.u, r.action] = lg.DECAY * w + lg.RATE_FEEDBACK * (r.reward - v @ w) * v
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] is None if w is None else np.allclose(got[k], w, atol=1e-9)


def test_folds_of_nothing_and_of_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, None), (1, 1, 7.0), (1, 1, 7.0)], "u int, i int, n double")
    assert sorted(map(tuple, lg.spend(df, ["u"], ["i"], "n", 10.0).collect()), key=str) == [(1, 1, 7.0), (None, 1, 5.0)]
    assert lg.spend(df.limit(0), ["u"], ["i"], "n", 10.0).collect() == []
    assert folds.fold_groups(df, ["u"], ["i"], lambda key: 0, lambda s, rows: s + rows.num_rows, "n long", lambda s: (s,)).count() == 2
