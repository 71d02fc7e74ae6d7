"""Streams that work by event time: arrivals wait for the watermark, are judged in time order, and
what is due later comes back by a timer.

A key's waiting arrivals and its timers live in the state store. Whatever the order of arrival within the
watermark's delay, the answers are those of the sorted events, so each rule has a plain SQL
twin. State of an idle key is cleared by a timer of its own.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.streaming.streams import ROCKSDB, micros

SECOND = 1_000_000


class InOrder(StatefulProcessor):
    """Hands a key's arrivals to ``judge`` in time order, up to the watermark. Subclasses say what an arrival is (``arrival``, its
    first field is the time in microseconds), keep their own state and name when they want to be called again."""

    arrival: str
    output: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.arrival)
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def judge(self, key, arrivals: list[tuple], now: int) -> tuple[list[tuple], int | None]:
        """Output rows, and the next time at which the key is due without an arrival, if any."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in self.arrival.split(", ")]
        for part in rows:
            self.waiting.appendList([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in part[names].itertuples(index=False, name=None)])
        yield from self._advance(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues)

    def _advance(self, key, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get())
        ready = [a for a in held if a[0] <= now]
        later = held[len(ready):]
        made, due = self.judge(key, ready, now)
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        wanted = min((-(-t // 1000) for t in (due, later[0][0] if later else None) if t is not None), default=None)
        for t in list(self.handle.listTimers()):
            if t != wanted:
                self.handle.deleteTimer(t)
        if wanted is not None:
            self.handle.registerTimer(wanted)
        if made:
            yield pd.DataFrame(made, columns=self.output)

    def close(self) -> None:
        pass


class SlidingCap(InOrder):
    """At most ``limit`` accepted events in the window before and with each one. With ``mark`` the first refusal counts, too, later
    ones don't; the window's far end belongs to it if ``closed``. The log of a key goes when its window has passed."""

    arrival, output = "us bigint, event_id bigint", ["key", "event_id", "accepted"]

    def __init__(self, limit: int, seconds: int, mark: bool, closed: bool):
        self.limit, self.width, self.mark, self.closed = limit, seconds * SECOND, mark, closed

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "us bigint")

    def judge(self, key, arrivals, now):
        log, made = [r[0] for r in self.log.get()], []
        for us, event in arrivals:
            log = self._within(log, us)
            accepted = len(log) < self.limit
            if accepted or self.mark and len(log) == self.limit:
                log.append(us)
            made.append((key[0], event, accepted))
        log = self._within(log, now)
        self.log.put([(u,) for u in log]) if log else self.log.clear()
        return made, log[-1] + self.width + 1 if log else None

    def _within(self, log: list[int], us: int) -> list[int]:
        return [u for u in log if us - u < self.width + self.closed]


class CooledDigest(InOrder):
    """A digest goes out at once when the cooldown since the last one is over, else when it ends: by a timer, without a further
    event. The queue is cleared by the send that carries it."""

    arrival, output = "us bigint, event_id bigint, success boolean", ["key", "us", "succeeded", "failed", "kind"]

    def __init__(self, seconds: int):
        self.cooldown = seconds * SECOND

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last bigint, ok bigint, bad bigint")

    def judge(self, key, arrivals, now):
        last, ok, bad = self.state.get() if self.state.exists() else (None, 0, 0)
        made = []

        def send(us: int) -> None:
            nonlocal last, ok, bad
            made.append((key[0], us, ok, bad, "PARTIAL" if ok and bad else "FAILURE" if bad else "SUCCESS"))
            last, ok, bad = us, 0, 0

        for us, _event, success in arrivals:
            if ok + bad and last + self.cooldown <= us:
                send(last + self.cooldown)
            ok, bad = ok + success, bad + (not success)
            if last is None or us >= last + self.cooldown:
                send(us)
        if ok + bad and last + self.cooldown <= now:
            send(last + self.cooldown)
        if last is None or not ok + bad and last + self.cooldown <= now:
            self.state.clear()          # idle: the next event is sent at once, as the first one was
            return made, None
        self.state.update((last, ok, bad))
        return made, last + self.cooldown


class Landing(StatefulProcessor):
    """Messages by identifier, each handled once however often it is delivered. ``attempt(body, number)`` gives ok, failed or
    transient; a transient failure is tried again after a pause that doubles, until the attempts are used up. The mark that a
    message is done goes after ``keep`` seconds without a delivery. One without a time is tried at once.

    Most messages come once, and calls to the state store cost more than handling them. So the key is a bucket of identifiers:
    its waiting deliveries and the messages not yet forgotten are tables in a few values, with one timer."""

    def __init__(self, attempt: Callable[[str, int], str], most: int, pause: int, keep: int):
        self.attempt, self.most, self.pause, self.keep = attempt, most, pause * SECOND, keep * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "deliveries binary")
        self.known = handle.getValueState("known", "messages binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendValue((_packed(DELIVERY, [part[n] for n in DELIVERY.names]),))
        yield from self._advance(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues)

    def _advance(self, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        held = [r for (packed,) in self.waiting.get() for r in _rows(DELIVERY, packed)]
        later = [r for r in held if r[1] is not None and r[1] > now]
        ready: dict[str | None, list[tuple]] = {}
        for msg, us, body in held if len(later) < len(held) else ():
            if us is None or us <= now:
                ready.setdefault(msg, []).append((us, body))
        known = {r[0]: r[1:] for r in _rows(MESSAGE, self.known.get()[0])} if self.known.exists() else {}
        called = [m for m in known.keys() | ready.keys() if m in ready or known[m][1] <= now]
        made = [x for m in called for x in self.judge(m, known, sorted(ready.get(m, ()), key=lambda a: (a[0] is not None, a[0] or 0, a[1] or "")), now)]
        if ready:
            self.waiting.put([(_packed(DELIVERY, zip(*later)),)]) if later else self.waiting.clear()
        if known and called:
            self.known.update((_packed(MESSAGE, zip(*[(m, *x) for m, x in known.items()])),))
        elif called:
            self.known.clear()
        times = [x[1] for x in known.values()] + [r[1] for r in later]
        wanted = -(-min(times) // 1000) if times else None
        set_ = list(self.handle.listTimers())
        for t in set_:
            if t != wanted:
                self.handle.deleteTimer(t)
        if wanted is not None and wanted not in set_:
            self.handle.registerTimer(wanted)
        if made:
            yield pd.DataFrame(made, columns=["msg_id", "status", "attempts", "us"]).astype({"us": "Int64"})

    def judge(self, msg: str | None, known: dict, arrivals: list[tuple], now: int) -> list[tuple]:
        """What becomes of a message up to now; its state in ``known`` is brought up to date."""
        made = []
        timeless = msg not in known and arrivals[0][0] is None
        attempts, due, done, body = known.get(msg) or (0, now if timeless else arrivals[0][0], False, arrivals[0][1])
        while not done and due <= now:
            attempts += 1
            status = self.attempt(body, attempts)
            if status == "transient" and attempts < self.most:
                due += 0 if timeless else self.pause << (attempts - 1)
                continue
            made.append((msg, "ok" if status == "ok" else "failed", attempts, None if timeless else due))
            done, due, body = True, due + self.keep, None
        if done and arrivals and arrivals[-1][0] is not None:
            due = max(due, arrivals[-1][0] + self.keep)
        if done and due <= now:
            known.pop(msg, None)
        else:
            known[msg] = (attempts, due, done, body)
        return made

    def close(self) -> None:
        pass


#: The tables that a bucket of messages keeps.
DELIVERY = pa.schema({"msg": pa.string(), "us": pa.int64(), "body": pa.string()})
MESSAGE = pa.schema({"msg": pa.string(), "attempts": pa.int64(), "due": pa.int64(), "done": pa.bool_(), "body": pa.string()})


def _packed(schema: pa.Schema, columns) -> bytes:
    table = pa.record_batch([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema, strict=True)], schema=schema)
    return table.serialize().to_pybytes()


def _rows(schema: pa.Schema, packed: bytes) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in pa.ipc.read_record_batch(pa.py_buffer(packed), schema).columns])


def _run(events: DataFrame, processor: StatefulProcessor, schema: str, key: str = "key") -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def capped(events: DataFrame, key: str, limit: int, seconds: int, mark: bool = False, closed: bool = False, delay: str = "1 hour") -> DataFrame:
    """events(event_id, ts, key) stream -> (key, event_id, accepted), each once the watermark has passed it."""
    e = events.withWatermark("ts", delay).select(F.col(key).cast("string").alias("key"), "ts", "event_id", micros("ts").alias("us"))
    return _run(e, SlidingCap(limit, seconds, mark, closed), "key string, event_id bigint, accepted boolean")


def digests(results: DataFrame, key: str, seconds: int, delay: str = "1 hour") -> DataFrame:
    """results(event_id, ts, key, success) stream -> digests sent (key, us, succeeded, failed, kind)."""
    e = results.withWatermark("ts", delay).select(F.col(key).cast("string").alias("key"), "ts", "event_id", micros("ts").alias("us"), "success")
    return _run(e, CooledDigest(seconds), "key string, us bigint, succeeded bigint, failed bigint, kind string")


def landed(messages: DataFrame, attempt: Callable[[str, int], str], most: int = 3, pause: int = 300, keep: int = 7 * 86400, delay: str = "1 hour", buckets: int = 512) -> DataFrame:
    """messages(msg_id, ts, body) stream -> (msg_id, status ok or failed, attempts, us of the last attempt), one row per message. A bucket's
    messages are held by a task together, so ``buckets`` goes with the number of messages that wait."""
    msg = F.col("msg_id").cast("string")
    e = messages.withWatermark("ts", delay).select(F.pmod(F.xxhash64(msg), F.lit(buckets)).alias("bucket"), msg.alias("msg"), "ts", micros("ts").alias("us"), "body")
    return _run(e, Landing(attempt, most, pause, keep), "msg_id string, status string, attempts bigint, us bigint", "bucket")


def closed_by(events: DataFrame, heartbeat: str, key: str, beyond: str = "3650 days") -> DataFrame:
    """The stream with late heartbeats under a key of their own (null), one per row that ``heartbeat`` selects: a stream that ends needs
    them for its watermark to pass the last events and timers."""
    beats = events.filter(heartbeat).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL '{beyond.split()[0]}' DAY")).withColumn(key, F.lit(None).cast(events.schema[key].dataType))
    return events.unionByName(beats)
