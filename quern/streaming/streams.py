"""Structured Streaming jobs, and the batch form of each rule.

Batch forms cut time into cells, so an event stream with one hot key spreads over
tasks: what is sorted together is one key's events of one or two cells.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quern.session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Cells that are put in order together.
RUN_CELLS = 1024
WINDOW_SECONDS, MAX_REQUESTS, MAX_REPORTS, DEBOUNCE_SECONDS = 60, 120, 20, 120


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


# --- batch forms -----------------------------------------------------------------------

def sliding_count(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Adds recent: events of the key in the last ``seconds`` up to and with this one.
    Each event also visits the next cell as context; no key is sorted whole."""
    width = seconds * 1_000_000
    e = events.withColumn("_us", micros(ts)).withColumn("_cell", F.floor(F.col("_us") / width))
    both = e.withColumn("_v", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_cell", F.col("_cell") + F.col("_v"))
    w = Window.partitionBy(key, "_cell").orderBy("_us").rangeBetween(-width, 0)
    return both.withColumn("recent", F.count(F.lit(1)).over(w)).filter("_v = 0").drop("_us", "_cell", "_v")


def debounced(events: DataFrame, key: str | None, ts: str, gap_seconds: int) -> DataFrame:
    """(key, first_us, last_us, n) of bursts: a pause of the gap or more ends one.
    Events of one cell as wide as the gap are always one burst, so a partial
    aggregate leaves one row per key and cell, and runs of cells are sorted apart, also those of one global key."""
    gap = gap_seconds * 1_000_000
    keys = [key] if key else [F.lit("all").alias("key")]
    name = key or "key"
    cells = (events.select(*keys, micros(ts).alias("us")).groupBy(name, F.floor(F.col("us") / gap).alias("cell"))
             .agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n")))
    # bursts within a run of cells, then the few runs in order: a burst that crosses an edge keeps its number
    d = cells.withColumn("run", F.floor(F.col("cell") / RUN_CELLS))
    inside = Window.partitionBy(name, "run").orderBy("cell")
    starts = F.coalesce(F.col("lo") - F.lag("hi").over(inside) >= gap, F.lit(True)).cast("bigint")
    d = d.withColumn("_s", starts).withColumn("_b", F.sum("_s").over(inside))
    runs = Window.partitionBy(name).orderBy("run")
    edges = (d.groupBy(name, "run").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.max("_b").alias("_m"))
             .withColumn("_joins", F.coalesce(F.col("_lo") - F.lag("_hi").over(runs) < gap, F.lit(False)).cast("bigint"))
             .withColumn("_off", F.sum(F.col("_m") - F.col("_joins")).over(runs) - F.col("_m")))
    d = d.join(edges.select(name, "run", "_off"), [name, "run"]).withColumn("burst", F.col("_b") + F.col("_off"))
    return d.groupBy(name, "burst").agg(F.min("lo").alias("first_us"), F.max("hi").alias("last_us"), F.sum("n").alias("n")).drop("burst")


def digest(results: DataFrame, ts: str, success: Column, minutes: int) -> DataFrame:
    """One row per window with something in it: counts and the kind of message."""
    d = results.groupBy(F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes").alias("w")).agg(
        F.count_if(success).alias("succeeded"), F.count_if(~success).alias("failed"))
    kind = F.when((F.col("succeeded") > 0) & (F.col("failed") > 0), "PARTIAL").when(F.col("failed") > 0, "FAILURE").otherwise("SUCCESS")
    return d.select(F.unix_seconds("w.start").alias("start"), "succeeded", "failed", kind.alias("kind"))


def refreshed(rollup: DataFrame, children: DataFrame, changed: DataFrame, key: str, build) -> DataFrame:
    """The rollup with only the changed records rebuilt: ``build(children)`` -> rollup rows."""
    ids = changed.select(key).distinct()
    return rollup.join(ids, key, "left_anti").unionByName(build(children.join(ids, key, "left_semi")))


def split_known_links(messages: DataFrame, library_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, known) messages by link key; works on a stream against the static library."""
    known = library_links.select("link_key").distinct()
    return (messages.join(known, "link_key", "left_anti"), messages.join(known, "link_key", "left_semi"))


# --- streams -----------------------------------------------------------------------------

def message_source(spark, path: str, schema: StructType | str, watermark: str = "1 day", files_per_trigger: int = 100) -> DataFrame:
    """Delivered messages (JSON files), each once by msg_id."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return s.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["msg_id"])


def intake(stream: DataFrame, handle, out: str, checkpoint: str, max_attempts: int = 3):
    """Runs ``handle`` (messages -> messages with status ok / failed / transient) on every
    batch; a batch id is its folder, so a batch run again overwrites itself. Transient
    failures go to retry until the attempts are used up."""
    def write(batch: DataFrame, batch_id: int):
        done = handle(batch).persist()
        again = (F.col("status") == "transient") & (F.col("attempts") + 1 < max_attempts)
        for name, cond in (("good", F.col("status") == "ok"), ("retry", again), ("failed", ~again & (F.col("status") != "ok"))):
            done.filter(cond).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        done.unpersist()
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Quota(StatefulProcessor):
    """At most ``limit`` accepted events in the window; the first refusal is marked
    and counts too, later ones do not. Arrivals are judged as they come and the state stays: ``timed.SlidingCap``
    judges in time order and clears the log of an idle key."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "us long", ttlDurationMs=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])   # one key's events of one micro-batch
        log = [r[0] for r in self.log.get()]
        out, width = [], self.seconds * 1_000_000
        for us, eid in zip(batch["us"], batch["event_id"]):
            while log and us - log[0] > width:
                log.pop(0)
            accepted = len(log) < self.limit
            if len(log) <= self.limit:
                log.append(int(us))      # the first refusal leaves its mark
            out.append((key[0], int(eid), bool(accepted)))
        self.log.put([(u,) for u in log]) if log else self.log.clear()
        yield pd.DataFrame(out, columns=["key", "event_id", "accepted"])

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """A digest goes out when something is queued and the cooldown since the last one
    has passed; otherwise items stay queued."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last long, ok long, bad long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("us")
        last, ok, bad = self.state.get() if self.state.exists() else (-1, 0, 0)
        out = []
        for us, success in zip(batch["us"], batch["success"]):
            ok, bad = ok + int(success), bad + int(not success)
            if last < 0 or us - last >= self.seconds * 1_000_000:
                out.append((key[0], int(us), ok, bad, "PARTIAL" if ok and bad else "FAILURE" if bad else "SUCCESS"))
                last, ok, bad = int(us), 0, 0
        self.state.update((int(last), int(ok), int(bad)))
        yield pd.DataFrame(out, columns=["key", "us", "succeeded", "failed", "kind"])

    def close(self) -> None:
        pass


def quota(events: DataFrame, key: str, limit: int = MAX_REQUESTS, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """events(event_id, ts, key) stream -> (key, event_id, accepted)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    e = events.select(F.col(key).cast("string").alias("key"), "event_id", micros("ts").alias("us"))
    return e.groupBy("key").transformWithStateInPandas(statefulProcessor=Quota(limit, seconds), outputStructType="key string, event_id long, accepted boolean",
                                                      outputMode="Append", timeMode="None")


def cooldown_digest(results: DataFrame, key: str, seconds: int) -> DataFrame:
    """results(ts, key, success) stream -> digests sent."""
    results.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    e = results.select(F.col(key).cast("string").alias("key"), micros("ts").alias("us"), "success")
    return e.groupBy("key").transformWithStateInPandas(statefulProcessor=Cooldown(seconds), outputStructType="key string, us long, succeeded long, failed long, kind string",
                                                      outputMode="Append", timeMode="None")


def debounce_stream(changes: DataFrame, ts: str, gap: str = "120 seconds", watermark: str = "10 minutes", key: str | None = None) -> DataFrame:
    """One row per closed burst of changes."""
    s = changes.withWatermark(ts, watermark)
    # session windows need a key that is no constant; an empty text made of the time is
    # the same for all, and watermarked bursts keep its state to one open session
    k = F.col(key) if key else F.substring(F.col(ts).cast("string"), 1, 0).alias("key")
    return s.groupBy(F.session_window(ts, gap).alias("w"), k).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into the shared folder and reads it back."""
    spark = stream.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
