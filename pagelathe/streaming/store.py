"""State by key with an expiry, and hosts that are asked at a polite pace, as stateful streams.

Both need a state store with timers: spark.sql.streaming.stateStore.providerClass must be Spark's RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "key string, id long, ts timestamp, op string, value string, found boolean"


class Keyed(StatefulProcessor):
    """set, get, delete and exists of one key, in order of time and id; a value is there until its expiry, in event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string, until long")  # until: milliseconds, 0 for ever

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.held.get() if self.held.exists() else None
        value, until = now if now else (None, None)
        for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
            at = int(r["ts"].timestamp() * 1000)
            live = until is not None and (until == 0 or until > at)
            if r["op"] == "set":
                value, until = r["value"], at + 1000 * r["ex"] if r["ex"] else 0
            elif r["op"] == "delete":
                value, until = None, None
            else:
                yield Row(key=key[0], id=r["id"], ts=r["ts"], op=r["op"], value=value if live and r["op"] == "get" else None, found=live)
        if until is None:
            self.held.clear()
        else:
            self.held.update((value, until))
            if until:
                self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a timer of an earlier value may come while a later one still holds
        if self.held.exists() and 0 < self.held.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_store(ops: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of (key, id, ts, op, value, found): the answer to each get and exists of a stream of ops (key, id, ts, op, value, ex).

    op is set (value, for ex seconds, or for ever if ex is null or 0), get, exists or delete; several keys at once are several rows. Time is event time: a value is found
    by reads before its expiry. Rows may come `late` at most; later ones are dropped by the watermark. A key's state goes by a timer once the watermark passes its expiry.
    """
    rows = ops.select("key", "id", F.col("ts").cast("timestamp").alias("ts"), "op", "value", F.coalesce(F.col("ex").cast("long"), F.lit(0)).alias("ex")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithState(statefulProcessor=Keyed(), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime")


def replayed(ops: DataFrame) -> DataFrame:
    """What keyed_store() answers, of a table of all ops."""
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    writes = F.when(F.col("op").isin("set", "delete"), F.struct("op", "value", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("ex").cast("long"), F.lit(0)).alias("ex")))
    rows = ops.withColumn("w", F.last(writes, ignorenulls=True).over(w)).where("op in ('get', 'exists')")
    live = F.coalesce((F.col("w.op") == "set") & ((F.col("w.ex") == 0) | (F.unix_millis(F.col("w.ts")) + 1000 * F.col("w.ex") > F.unix_millis(F.col("ts").cast("timestamp")))), F.lit(False))
    return rows.select("key", "id", F.col("ts").cast("timestamp").alias("ts"), "op", F.when(live & (F.col("op") == "get"), F.col("w.value")).alias("value"), live.alias("found"))


RELEASED = "host string, id long, url string, release timestamp"


class Polite(StatefulProcessor):
    """URLs of one host, let go one by one: each its gap after the one before, twice the gap while the host refuses."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.host = handle.getValueState("host", "last long, streak int")  # last: milliseconds
        self.queue = handle.getMapState("queue", "release long, id long", "url string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, streak = self.host.get() if self.host.exists() else (None, 0)
        for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
            if r["url"] is None:  # what became of a request
                streak = streak + 1 if r["status"] in (429, 503) else 0 if r["status"] is not None and 200 <= r["status"] < 400 else streak
                continue
            at = int(r["ts"].timestamp() * 1000)
            last = at if last is None else max(at, last + self.gap_ms * (2 if streak >= 2 else 1))
            self.queue.updateValue((last, r["id"]), (r["url"],))
            self.handle.registerTimer(last)
        self.host.update((last, streak))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        import datetime

        due = [k for k in self.queue.keys() if k[0] <= expiredTimerInfo.getExpiryTimeInMs()]  # noqa: SIM118  a state, no dict
        for k in sorted(tuple(k) for k in due):
            url = self.queue.getValue(k)[0]
            self.queue.removeKey(k)
            yield Row(host=key[0], id=k[1], url=url, release=datetime.datetime.fromtimestamp(k[0] / 1000))

    def close(self) -> None:
        pass


def released(requests: DataFrame, gap_ms: int = 500, late: str = "0 seconds") -> DataFrame:
    """A stream of (host, id, url, release): each URL of a stream of requests (host, id, ts, url, status) when its host may be asked.

    A row without url is what became of a request (status): from two refusals (429 or 503) in a row on gaps are twice as long, until an answer from
    200 to 399. A URL is let go once the watermark (event time, less `late`) has reached its release: its ts, or its gap after the release before.
    """
    rows = requests.select("host", "id", F.col("ts").cast("timestamp").alias("ts"), "url", F.col("status").cast("int").alias("status")).withWatermark("ts", late)
    return rows.groupBy("host").transformWithState(statefulProcessor=Polite(gap_ms), outputStructType=RELEASED, outputMode="Append", timeMode="EventTime")


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of runs of a key's events that are no more than `gap` apart; on a stream, once the watermark has passed a session's end."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rendered(pages: DataFrame, snapshots: DataFrame, within: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """pages (page_id, ts, html) with `rendered`, of a snapshot (page_id, ts, html) that comes within a time of the page; null if none did.

    On streams both sides keep rows only as long as a match can still come; a page without one comes out once that is over. Of several snapshots each gives a row.
    """
    a = pages.select("page_id", F.col("ts").alias("ts"), "html").withWatermark("ts", late)
    b = snapshots.select(F.col("page_id").alias("__page"), F.col("ts").alias("__ts"), F.col("html").alias("rendered")).withWatermark("__ts", late)
    near = (F.col("page_id") == F.col("__page")) & (F.col("__ts") >= F.col("ts")) & (F.col("__ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return a.join(b, near, "leftOuter").select("page_id", "ts", "html", "rendered")
