"""Budgets of live sessions: spends, requests for more and changes of limits as one stream, with a state for each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A session's state: what is spent, its limit, what may be granted without asking, and when its turn ends (0: no turn).
STATE = "spent double, cap double, room double, ends long"
OUT = "session string, event_id long, op string, outcome string, spent double, cap double, room double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """spend: accepted, or refused if less is left. extend: granted while the room lasts, else waiting. limit: the new limit,
    invalid if below 0, not a number or without end; what is spent stays. turn: a turn begins, whose time ends after so many
    seconds of event time; a timer says so when the watermark has passed it, and spends after that are late."""

    def __init__(self, cap: float, room: float):
        self.cap, self.room = float(cap), float(room)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("budget", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spent, cap, room, ends = self.held.get() if self.held.exists() else (0.0, self.cap, self.room, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            n, now = r.n, int(pd.Timestamp(r.ts).value // 1_000_000)
            if n is None or n != n:
                outcome = "invalid"
            elif r.op == "spend":
                outcome = "late" if ends and now >= ends else "accepted" if max(0.0, cap - spent) >= n else "refused"
                spent += n if outcome == "accepted" else 0.0
            elif r.op == "extend":
                outcome = "granted" if n <= room else "waiting"
                if outcome == "granted":
                    room, cap = room - n, cap + n
            elif r.op == "limit":
                outcome = "changed" if 0 <= n < float("inf") else "invalid"
                cap = float(n) if outcome == "changed" else cap
            elif r.op == "turn":
                outcome, ends = "begun", now + int(n * 1000)
                self.handle.registerTimer(ends)
            else:
                outcome = "invalid"
            out.append((key[0], r.event_id, r.op, outcome, spent, cap, room))
        self.held.update((spent, cap, room, ends))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spent, cap, room, ends = self.held.get()
        if ends == expiredTimerInfo.getExpiryTimeInMs():  # not a turn that a later one has replaced
            yield pd.DataFrame([(key[0], -1, "turn", "over", spent, cap, room)], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def budget_events(events: DataFrame, session: Column, op: Column, amount: Column, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """(session, ts, event_id, op, n) of a stream or a table of events."""
    return events.select(session.cast("string").alias("session"), F.col(ts).cast("timestamp").alias("ts"), F.col(event_id).cast("long").alias("event_id"), op.alias("op"), amount.cast("double").alias("n"))


def live_budgets(events: DataFrame, cap: float, room: float = 0.0, late: str = "0 seconds") -> DataFrame:
    """What becomes of each event of a stream (session, ts, event_id, op, n): OUT, and a row of event -1 where a turn's time is over.

    State is kept by session in the state store, which checkpoints to the query's folder; a session's rows of one
    micro-batch are taken in order of time and id, so batches should come in order of time. A row without session is
    a session of its own name, null.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = events.withWatermark("ts", late)
    return marked.groupBy("session").transformWithStateInPandas(Sessions(cap, room), OUT, "append", "eventTime")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there now, from where its checkpoint in folder ended, and returns what it has written."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
