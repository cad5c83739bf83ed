"""A watcher of workers as a stream: circuit breaker, stalls, growing back-off and heartbeats from one state a worker.

Rows (worker, time, number, whether it is a fault of the storage) are held until the watermark has passed them, then
worked off in order of time and number; what falls due between rows comes from timers. So the output doesn't depend on
how rows are dealt to batches, nor on the order within the allowed delay. Of rows later than that, none counts.

* breaker: the first time `faults` faults follow each other; once a worker.
* heartbeat: every `beat` seconds from a worker's first row, and at every `every`-th row, while the worker runs.
* stall: `stall` seconds after the last row or retry; the worker no longer runs until its next row.
* retry: min(base * 2 ** n, cap) seconds after the n-th stall in a row; a row starts the count anew.
* gone: `tries` stalls in a row; nothing falls due until another row.

A row at the very time that something is due comes first. ``plan`` gives stall, retry and gone of a gap in batch form.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

US = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Seconds and counts; the stall is that of ``monitor.verdict``."""

    stall: int = 1_800
    beat: int = 90
    every: int = 200
    faults: int = 4
    base: int = 60
    cap: int = 1_200
    tries: int = 6

    def wait(self, n: int) -> int:
        return min(self.base * 2**n, self.cap)


@dataclass
class Watch:
    """The state of a worker; times in microseconds, -1 where nothing is due."""

    rows: int = 0
    run: int = 0
    opened: bool = False
    running: bool = False
    waiting: bool = False
    stalls: int = 0
    beat: int = -1
    due: int = -1

    def next(self) -> int:
        return min((t for t in (self.beat, self.due) if t >= 0), default=-1)

    def advance(self, until: int, limits: Limits) -> Iterator[tuple[int, str, int]]:
        """(time, kind, number) of all that is due before a time."""
        while 0 <= (now := self.next()) < until:
            if now == self.beat:
                self.beat += limits.beat * US
                yield now, "heartbeat", self.rows
            elif self.waiting:
                self.waiting, self.due = False, now + limits.stall * US
                yield now, "retry", self.stalls
            else:
                self.stalls, self.running, self.beat = self.stalls + 1, False, -1
                yield now, "stall", self.stalls
                if self.stalls < limits.tries:
                    self.waiting, self.due = True, now + limits.wait(self.stalls) * US
                else:
                    self.due = -1
                    yield now, "gone", self.stalls

    def row(self, at: int, number: int, fault: bool, limits: Limits) -> Iterator[tuple[int, str, int]]:
        yield from self.advance(at, limits)
        self.rows, self.run = self.rows + 1, self.run + 1 if fault else 0
        if not self.running:
            self.running, self.waiting, self.beat = True, False, at + limits.beat * US
        self.stalls, self.due = 0, at + limits.stall * US
        if self.run >= limits.faults and not self.opened:
            self.opened = True
            yield at, "breaker", number
        if self.rows % limits.every == 0:
            self.beat = at + limits.beat * US
            yield at, "heartbeat", self.rows


class _Processor(StatefulProcessor):
    """Rows wait in a list until a timer says that the watermark has passed them; the worker's state is one value."""

    def __init__(self, worker: str, limits: Limits):
        self.worker, self.limits = worker, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = {"int": "long", "bool": "boolean"}
        self.state = handle.getValueState("state", ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Watch)) + ", timer long")
        self.held = handle.getListState("held", "at long, number long, fault boolean")

    def _load(self) -> tuple[Watch, int]:
        if not self.state.exists():
            return Watch(), -1
        *values, timer = self.state.get()
        return Watch(*values), timer

    def _keep(self, watch: Watch, timer: int, least: int) -> None:
        """Stores the state, with a timer (in milliseconds) for the next time at which there is something to do."""
        due = [t for t in (least, watch.next()) if t >= 0]
        wanted = -(-min(due) // 1000) if due else -1
        if wanted != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if wanted >= 0:
                self.handle.registerTimer(wanted)
        self.state.update((*asdict(watch).values(), wanted))

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watch, timer = self._load()
        least = [timer * 1000] if timer >= 0 else []
        for batch in rows:
            new = list(zip(batch["watch_at"].tolist(), batch["watch_number"].tolist(), batch["watch_fault"].tolist(), strict=True))
            if new:
                self.held.appendList(new)
                least.append(min(r[0] for r in new))
        self._keep(watch, timer, min(least, default=-1))
        yield self._out(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, (watch, _) = timerValues.getCurrentWatermarkInMs() * 1000, self._load()
        waiting = sorted(map(tuple, self.held.get())) if self.held.exists() else []
        ready, later = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        out = [x for r in ready for x in watch.row(*r, self.limits)]
        out += watch.advance(now + 1, self.limits)
        if ready:
            self.held.clear()
            if later:
                self.held.put(later)
        self._keep(watch, -1, min((r[0] for r in later), default=-1))  # this timer is spent
        yield self._out(key, out)

    def _out(self, key, rows: list[tuple[int, str, int]]) -> pd.DataFrame:
        at = pd.to_datetime([r[0] for r in rows], unit="us", utc=True)
        return pd.DataFrame({self.worker: pd.Series([key[0]] * len(rows)), "at": at, "kind": pd.Series([r[1] for r in rows], dtype=object), "number": pd.Series([r[2] for r in rows], dtype="int64")})


def watched(rows: DataFrame, worker: str, at: str, number: str, fault: str, limits: Limits | None = None, late: str = "0 seconds") -> DataFrame:
    """(worker, at, kind, number): what the watcher reports of a stream of rows. Rows without a worker or a time are left
    out; an unknown fault is none. Needs the RocksDB state store (``rocksdb``)."""
    rows = rows.where(F.col(worker).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    rows = rows.select(worker, at, F.unix_micros(at).alias("watch_at"), F.col(number).cast("long").alias("watch_number"), F.coalesce(F.col(fault), F.lit(False)).alias("watch_fault"))
    schema = f"{worker} {dict(rows.dtypes)[worker]}, at timestamp, kind string, number long"
    return rows.groupBy(worker).transformWithStateInPandas(_Processor(worker, limits or Limits()), schema, "append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State with lists and timers lives in RocksDB; streams that are started in here keep theirs there."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def plan(limits: Limits) -> list[tuple[str, int, int]]:
    """(kind, number, seconds after the last row) of all that a gap brings."""
    out, at = [], 0
    for n in range(1, limits.tries + 1):
        at += limits.stall
        out.append(("stall", n, at))
        if n < limits.tries:
            at += limits.wait(n)
            out.append(("retry", n, at))
    return [*out, ("gone", limits.tries, at)]


def gaps(rows: DataFrame, worker: str, at: str, number: str, limits: Limits | None = None) -> DataFrame:
    """(worker, at, kind, number): the stalls, retries and ends of rows that are all there; now is the time of the last."""
    now = rows.agg(F.max(at)).first()[0]
    steps = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).cast("long").alias("number"), F.lit(s).alias("after")) for k, n, s in plan(limits or Limits())))
    after = F.lead(at).over(W.partitionBy(worker).orderBy(at, number))
    gone = rows.where(F.col(worker).isNotNull() & F.col(at).isNotNull()).select(worker, F.col(at).alias("__from"), after.alias("__to"))
    due = gone.select(worker, "__from", "__to", F.explode(steps).alias("s")).withColumn("at", F.timestamp_seconds(F.unix_micros("__from") / US + F.col("s.after")))
    fits = F.when(F.col("__to").isNull(), F.col("at") <= F.lit(now)).otherwise(F.col("at") < F.col("__to"))
    return due.where(fits).select(worker, "at", "s.kind", "s.number")
