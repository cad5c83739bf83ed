"""Each content processed once, its result fanned out to every row that carries it; and what came too late for that.

Equal contents of one window of time are one piece of work: ``once`` gives the first row of each, when the watermark has
closed the window. ``fan_out`` joins the results back to all rows, stream to stream; rows whose content gave no result
come out without one, when the watermark has passed them. Rows of a window that is closed already are late: they are
dropped, and ``Observed`` counts what came in, so that the difference to what counts is known.
"""

from __future__ import annotations

import threading
from collections import Counter
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def once(rows: DataFrame, key: str, at: str, number: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(w, key, first, n): the first row of each content and window, by time and number, and how many there are."""
    found = rows.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key)
    return found.agg(F.min_by(number, F.struct(at, number)).alias("first"), F.count("*").alias("n"))


def fan_out(rows: DataFrame, results: DataFrame, key: str, at: str, number: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(w, key, number and the results' columns) of every row that is not late; `results` have (w, key)."""
    own = rows.withWatermark(at, late).select(F.window(at, window).alias("w"), key, number)
    return own.join(results, ["w", key], "left")


class Observed(StreamingQueryListener):
    """Sums the metrics that streams observe, over all batches of what is started inside ``with``; rows dropped as late
    by stateful operators are counted under `late`."""

    def __init__(self, spark: SparkSession):
        self.spark, self.sums, self.open, self.ended = spark, Counter(), set(), threading.Condition()

    def __enter__(self) -> Observed:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        with self.ended:  # what streams report comes a little after they have ended
            self.ended.wait_for(lambda: not self.open, timeout=60)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self.ended:
            self.open.add(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        for row in event.progress.observedMetrics.values():
            self.sums.update(row.asDict())
        self.sums["late"] += sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.ended:
            self.open.discard(event.runId)
            self.ended.notify_all()
