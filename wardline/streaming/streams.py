"""Streams of files that arrive one after the other: counts of weeks, repeats, sessions, control limits, a replay clock.

Rows are late, repeated or without a time. Every stream has a watermark, so that its state is what may still change:
weeks, sessions and ids that are older leave it. State and results live in the shared folder; a stream that is started
again goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.functions.stats import count_quantile
from wardline.sources.scratch import Store

Step = Callable[[DataFrame], DataFrame]
#: How late rows may come; rows that are later are left out.
LATE = "3 days"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def clicks(rows: DataFrame) -> DataFrame:
    """click_id, ts, client_id, kind, arrived_at: clicks that have a time and a kind."""
    return rows.select("click_id", F.col("ts").cast("timestamp").alias("ts"), "client_id", "kind", F.col("arrived_at").cast("timestamp").alias("arrived_at")).filter("ts IS NOT NULL AND kind IS NOT NULL")


def arrive(rows: DataFrame, part: Column, step: Step, store: Store, name: str, idle: bool = True) -> DataFrame:
    """What a stream says of rows that arrive in parts (a few whole numbers), one after the other, each in a start of its own.

    After the last part two rows without a kind, far ahead in time, close what is still open; they say nothing themselves.
    The result has `state_rows`, how many rows the stream's state held at most. idle: whether batches without rows run,
    as event time asks for; a step by the clock's time would have them for ever.
    """
    spark = rows.sparkSession
    at = store.path(name)
    last = rows.agg(F.max("ts").alias("t"))
    ahead = lambda days: [F.when(F.lit(c == "ts"), last.scalar() + F.expr(f"INTERVAL {days} DAYS")).cast(t).alias(c) if c == "ts" else (F.lit("") if c == "kind" else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes]
    batches = [rows.filter(part == p) for (p,) in sorted(rows.select(part).distinct().collect())]
    batches += [spark.range(1).select(*ahead(days)) for days in (400, 401)]
    held, before = 0, {k: spark.conf.get(k, None) for k in (_PROVIDER, _IDLE)}
    spark.conf.set(_PROVIDER, _ROCKS)
    spark.conf.set(_IDLE, str(idle).lower())
    try:
        for batch in batches:
            batch.write.mode("append").parquet(f"{at}/in")
            said = step(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
            query = said.writeStream.option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").format("parquet").trigger(availableNow=True).start()
            query.awaitTermination()
            held = max([held, *(s.numRowsTotal for p in query.recentProgress for s in p.stateOperators)])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(said.schema).parquet(f"{at}/out")
    out.at, out.state_rows = at, held
    return out


def once(rows: DataFrame, late: str = LATE) -> DataFrame:
    """Clicks without those that repeat an id while the watermark still knows it."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["click_id"])


def week_of(ts: Column) -> Column:
    """The Monday of a time's week."""
    return F.to_date(F.date_trunc("week", ts))


def weekly(rows: DataFrame, late: str = LATE) -> DataFrame:
    """kind, week, n: counts of weeks from Monday on, said once a week is over for the watermark."""
    week = F.window("ts", "7 days", "7 days", "4 days")
    return once(rows, late).filter("kind <> ''").groupBy("kind", week.alias("w")).agg(F.count("*").alias("n")).select("kind", F.to_date("w.start").alias("week"), "n")


def sessions(rows: DataFrame, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    """client_id, began, n: sessions of each client, rows less than the gap apart, said once none can join them."""
    rows = once(rows, late).filter("kind <> ''")
    # Windows that touch are merged, so they end a microsecond before the gap does.
    return rows.groupBy("client_id", F.session_window("ts", f"{gap} -1 microseconds").alias("s")).agg(F.count("*").alias("n")).select("client_id", F.col("s.start").alias("began"), "n")


_WEEK_MS, _MONDAY_MS = 7 * 86_400_000, 4 * 86_400_000  # the epoch's first Monday


class Monitor(StatefulProcessor):
    """The weeks of a series: counts while they are open; when one is over for the watermark, its expected count and control limit by the weeks before it.

    State: counts of open weeks, and of closed ones the EWMA, the last 52 counts and the next week to be closed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "week long", "n long")
        self.model = handle.getValueState("model", "ewma double, next long, past array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            weeks = (batch["ms"] - _MONDAY_MS) // _WEEK_MS
            for week, n in weeks.value_counts().items():
                if self.open.containsKey((int(week),)):
                    n += self.open.getValue((int(week),))[0]
                else:
                    self.handle.registerTimer((int(week) + 1) * _WEEK_MS + _MONDAY_MS)
                self.open.updateValue((int(week),), (int(n),))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        over = (expiredTimerInfo.getExpiryTimeInMs() - _MONDAY_MS) // _WEEK_MS
        ewma, next_, past = self.model.get() if self.model.exists() else (None, None, [])
        due = sorted(w for (w,), _ in self.open.iterator() if w < over)
        out = []
        for week in range(due[0] if next_ is None else next_, over) if due else ():
            n = self.open.getValue((week,))[0] if self.open.containsKey((week,)) else 0
            k, total = len(past), sum(past)
            spread = k * sum(x * x for x in past) - total * total
            r = total * total / (spread - k * total) if total > 0 and spread > k * total else float("inf")
            expected = ewma or 0.0
            out.append((key[0], week, n, expected, count_quantile(expected, r, 0.99)))
            ewma, past = (float(n) if ewma is None else 0.25 * n + 0.75 * ewma), [*past, n][-52:]
            if self.open.containsKey((week,)):
                self.open.removeKey((week,))
            next_ = week + 1
        if out:
            self.model.update((ewma, next_, past))
            yield pd.DataFrame(out, columns=["kind", "number", "n", "expected", "ucl_99"])

    def close(self) -> None:
        pass


def monitored(rows: DataFrame, late: str = LATE) -> DataFrame:
    """kind, week, n, expected, ucl_99: each series' weeks as they close, with those that have no click in between."""
    rows = once(rows, late).filter("kind <> ''").select("kind", "ts", F.unix_millis("ts").alias("ms"))
    said = rows.groupBy("kind").transformWithStateInPandas(Monitor(), "kind string, number long, n long, expected double, ucl_99 long", "Append", "EventTime")
    week = F.date_add(F.lit("1970-01-05").cast("date"), (F.col("number") * 7).cast("int"))
    return said.select("kind", week.alias("week"), "n", "expected", "ucl_99")


class FirstSeen(StatefulProcessor):
    """The first row of each key, and again once `ttl` has passed since the last first."""

    def __init__(self, ttl: timedelta):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long", int(self.ttl.total_seconds() * 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = sum(len(batch) for batch in rows)
        fresh = not self.seen.exists()
        if fresh:
            self.seen.update((n,))
        return iter([pd.DataFrame({"key": [key[0]]})] if fresh else [])

    def close(self) -> None:
        pass


def first_seen(rows: DataFrame, ttl: timedelta) -> DataFrame:
    """key of rows (key, kind), when it is seen and not within ttl after; keys leave the state by themselves."""
    return rows.filter("kind <> ''").groupBy("key").transformWithStateInPandas(FirstSeen(ttl), "key string", "Append", "ProcessingTime")


def visible(rows: DataFrame, elapsed_ms: int) -> DataFrame:
    """The replay clock: rows whose offset has passed."""
    return rows.filter(F.col("replay_offset_ms") <= elapsed_ms)


def replayed(ticks: DataFrame, rows: DataFrame, step_ms: int) -> DataFrame:
    """A stream of ticks (number, one every step_ms) -> what becomes visible at each: rows whose offset lies in the step that ends there."""
    at = F.greatest(F.ceil(F.col("replay_offset_ms") / step_ms), F.lit(0)).cast("long")
    return ticks.join(rows.withColumn("_tick", at), F.col("number") == F.col("_tick")).drop("_tick")
