"""Heartbeats and their supervisor, as batch functions and as Structured Streaming queries with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from millrace.operators import state

BEAT = "agent_id string, ts timestamp, sequence long, alive boolean"
ACTION = "agent_id string, check_at double, action string, consecutive_failures int, backoff_seconds double, total_restarts int"
MEMORY = "last_seen double, failures int, last_action string, last_action_at double, restarts int"
_ACTION = [c.split(" ")[0] for c in ACTION.split(", ")]
_MEMORY = ("last_seen", "failures", "last_action", "last_action_at", "restarts", "next")


ALL = (1 << 31) - 1  # files of a batch: whatever a run finds is one batch, so batches don't grow with the files


def source(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A stream of heartbeat Parquet files."""
    return spark.readStream.schema(BEAT).option("maxFilesPerTrigger", files).parquet(folder)


def latest(beats: DataFrame) -> DataFrame:
    """The last heartbeat of each agent, batch or stream (update mode)."""
    return beats.groupBy("agent_id").agg(F.max_by(F.struct("ts", "sequence", "alive"), F.struct("ts", "sequence")).alias("b")).select("agent_id", "b.ts", "b.sequence", "b.alive")


def health(beats: DataFrame, now: float, timeout: float = 8.0) -> DataFrame:
    """(agent_id, age, healthy) at a time; an agent without heartbeats isn't in beats."""
    seen = F.col("ts").cast("double")
    return latest(beats).select("agent_id", F.round(state.age(seen, F.lit(now)), 3).alias("age"), state.healthy(seen, F.lit(timeout), F.lit(now)).alias("healthy"))


def _wait(failures: int, base: float, factor: float, most: float) -> float:
    return 0.0 if failures <= 0 else min(base * factor ** (failures - 1), most)


def _checked(memory: dict, seen: float | None, now: float, timeout: float, waits: tuple[float, float, float]) -> tuple[str, float]:
    """One check of one agent: (action, wait); memory is brought up to date.

    healthy clears the failures; an unhealthy agent is restarted, but not within its wait after a restart."""
    if seen is not None and now - seen <= timeout:
        memory.update(failures=0, last_action="monitored", last_action_at=now, last_seen=seen)
        return "healthy", 0.0
    memory["failures"] += 1
    wait = _wait(memory["failures"], *waits)
    if memory["last_action"] == "restarted" and now - memory["last_action_at"] < wait:
        memory.update(last_action="backoff", last_action_at=now)
        return "backoff_skipped", wait
    memory.update(last_action="restarted", last_action_at=now, failures=0, restarts=memory["restarts"] + 1)
    return "restarted", wait


def supervised(beats: DataFrame, checks: list[float], timeout: float = 8.0, base: float = 2.0, factor: float = 2.0, most: float = 60.0) -> DataFrame:
    """The supervisor's actions for each agent at the given check times, each seeing the heartbeats up to it.

    Only the last heartbeat before each check matters, so an agent's frame has as many rows as there are checks at most."""
    times = sorted(checks)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        last, agent = dict(zip(pdf["nth"], pdf["t"])), pdf["agent_id"].iloc[0]
        memory = {"last_seen": None, "failures": 0, "last_action": "none", "last_action_at": 0.0, "restarts": 0}
        rows, seen = [], None
        for nth, now in enumerate(times):
            seen = last.get(nth, seen)
            action, wait = _checked(memory, seen, now, timeout, (base, factor, most))
            rows.append((agent, now, action, memory["failures"], wait, memory["restarts"]))
        return pd.DataFrame(rows, columns=_ACTION)

    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in times]).cast("array<double>"), lambda c: c < F.col("t")))  # the first check that sees it
    last = beats.select("agent_id", F.col("ts").cast("double").alias("t")).groupBy("agent_id", at.alias("nth")).agg(F.max("t").alias("t"))
    return last.groupBy("agent_id").applyInPandas(one, ACTION)


class _Supervisor(StatefulProcessor):
    """The state of an agent, one value: its memory and the last heartbeat of each interval between checks that is still to come;
    and one timer, for the next check. Each call to the state is a round trip, so there is one read and one write for a batch or timer."""

    def __init__(self, start: float, interval: float, last: float | None, timeout: float, waits: tuple[float, float, float]) -> None:
        self.start, self.interval, self.last, self.timeout, self.waits = start, interval, last, timeout, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", MEMORY + ", next long, nths array<long>, times array<double>")

    def _time(self, nth: int) -> float:
        return self.start + nth * self.interval

    def _remembered(self) -> tuple[dict, dict[int, float], bool]:
        """(memory, last heartbeat of each interval to come, whether the agent is known)."""
        held = self.memory.get()
        if held is None:
            return dict(zip(_MEMORY, (None, 0, "none", 0.0, 0, 0))), {}, False
        return dict(zip(_MEMORY, held)), dict(zip(*held[len(_MEMORY) :])), True

    def _remember(self, memory: dict, ahead: dict[int, float]) -> None:
        self.memory.update((*memory.values(), list(ahead), list(ahead.values())))

    def _timed(self, nth: int) -> None:
        if self.last is None or self._time(nth) <= self.last:
            self.handle.registerTimer(int(self._time(nth) * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        memory, ahead, known = self._remembered()
        for pdf in rows:
            t = np.sort(pdf["t"].to_numpy())
            nth = np.maximum(np.ceil((t - self.start) / self.interval), 0).astype(int)  # the first check that sees it
            last = np.flatnonzero(np.append(nth[1:] != nth[:-1], True))
            for n, seen in zip(nth[last].tolist(), t[last].tolist()):
                ahead[n] = max(seen, ahead.get(n, seen))
        self._remember(memory, ahead)
        if not known:
            self._timed(0)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        (memory, ahead, _), now, out = self._remembered(), timerValues.getCurrentWatermarkInMs() / 1000.0, []
        while self._time(memory["next"]) <= now and (self.last is None or self._time(memory["next"]) <= self.last):
            at, nth = self._time(memory["next"]), memory["next"]
            if nth in ahead:
                memory["last_seen"] = max(ahead.pop(nth), memory["last_seen"] or 0.0)
            action, wait = _checked(memory, memory["last_seen"], at, self.timeout, self.waits)
            out.append((key[0], at, action, memory["failures"], wait, memory["restarts"]))
            memory["next"] = nth + 1
        self._remember(memory, ahead)
        self._timed(memory["next"])
        yield pd.DataFrame(out, columns=_ACTION)

    def close(self) -> None:
        pass


def supervise_stream(beats: DataFrame, start: float, interval: float, last: float | None = None, timeout: float = 8.0, base: float = 2.0, factor: float = 2.0, most: float = 60.0, late: str = "0 seconds") -> DataFrame:
    """supervised() over a stream: each agent is checked at start, start + interval, ... up to last, when the watermark has passed
    the time, with the heartbeats up to it. Memory and timers are keyed state, so a restarted stream goes on where it was.

    State is bounded: an agent's memory, and a heartbeat for each interval that the watermark hasn't passed."""
    _keyed_state(beats.sparkSession)
    timed = beats.withWatermark("ts", late).select("agent_id", "ts", F.col("ts").cast("double").alias("t"))
    return timed.groupBy("agent_id").transformWithStateInPandas(_Supervisor(start, interval, last, timeout, (base, factor, most)), ACTION, "append", "EventTime")


def _keyed_state(spark: SparkSession) -> None:
    """Timers, maps and expiry need the state store that keeps its tables on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Arrivals(StatefulProcessor):
    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "beats long", ttlDurationMs=int(self.ttl * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new, n = not self.seen.exists(), sum(map(len, rows))
        n += 0 if new else self.seen.get()[0]
        self.seen.update((n,))
        yield pd.DataFrame([(key[0], "joined" if new else "seen", n)], columns=["agent_id", "event", "beats"])

    def close(self) -> None:
        pass


def arrivals(beats: DataFrame, ttl: float) -> DataFrame:
    """(agent_id, event, beats) for each agent in a batch of a stream: 'joined' if nothing was heard of it within ttl seconds of
    processing time, else 'seen'; beats since it joined. Who is silent for longer expires from the state by itself."""
    _keyed_state(beats.sparkSession)
    return beats.select("agent_id", "ts").groupBy("agent_id").transformWithStateInPandas(_Arrivals(ttl), "agent_id string, event string, beats long", "append", "ProcessingTime")


def windowed(events: DataFrame, ts: str, size: str, key: str, late: str = "10 minutes") -> DataFrame:
    """An extension: counts by event-time window and key, late rows dropped behind the watermark in streams."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def batch_sink(path: str, fail: Callable[[int], bool] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that can be repeated: a batch is the folder of its number, and is written over if it comes again.

    A stream that ends between a batch's write and its commit repeats the batch when it resumes; so each is there once.
    fail(batch) is for tests: whether the sink is to raise after that batch's write."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if fail and fail(number):
            raise RuntimeError(f"stopped after the write of batch {number}")

    return write


def run_to_end(stream: DataFrame, path: str, mode: str, checkpoint: str, fail: Callable[[int], bool] | None = None, **trigger: bool) -> DataFrame:
    """Run a stream over all that is there into a folder of batches; the checkpoint lets a later run resume. Returns what sunk() does.

    State that expires by processing time never has all that is there behind it: such streams take the trigger once=True."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(batch_sink(path, fail)).option("checkpointLocation", checkpoint)
    writer.trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return sunk(stream.sparkSession, path, stream.schema, mode)


def sunk(spark: SparkSession, path: str, schema: StructType, mode: str = "append") -> DataFrame:
    """What a sink's folder holds: the last batch of mode complete, all of others with their batch."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    if mode != "complete":
        return rows
    last = rows.agg(F.max("batch").alias("_last"))  # a complete result isn't empty once it has had a row
    return rows.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("batch", "_last")


def merged(updates: DataFrame, key: str) -> DataFrame:
    """The last row of each key over the batches of a stream in update mode."""
    values = [c for c in updates.columns if c not in (key, "batch")]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return last.select(key, *[F.col(f"_v.{c}").alias(c) for c in values])


def action_log(actions: DataFrame, kind: str = "All", n: int = 100) -> DataFrame:
    """The newest actions, of one kind or all."""
    some = actions if kind == "All" else actions.where(F.col("action") == kind)
    return state.capped_log(some, [F.col("check_at").desc(), F.col("agent_id")], n)


def clock(c: Column) -> Column:
    """Seconds since the epoch as HH:MM:SS."""
    return F.date_format(F.timestamp_seconds(c), "HH:mm:ss")
