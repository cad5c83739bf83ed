"""Structured Streaming forms of the incremental derivations; each has a batch form that it must agree with.

Late rows: events later than the watermark allows are left out, as Structured Streaming does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.greedy import throttle_batch


def new_files(spark: SparkSession, folder: str, schema, names: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """A stream of a folder's Parquet files; with a checkpoint, files once read are not read again."""
    return spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def rates(events: DataFrame, at: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, key, n, rate): counts and rows per second by window, sliding if asked."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = events.withWatermark(at, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), key, "n", (F.col("n") / (F.unix_seconds("w.end") - F.unix_seconds("w.start"))).alias("rate"))


def sessions(events: DataFrame, at: str, key: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(key, start, end, n): sessions that a longer gap ends; rows exactly a gap apart are one session."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"), F.max(at).alias("end"))
    return out.select(key, F.col("w.start").alias("start"), "end", "n")


def first_of_each(rows: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """One row for each key within the watermark: equal contents are processed once."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def throttle(readings: DataFrame, machine: str, order: str, temperature: str, margin: str) -> DataFrame:
    """(machine, order, action): each machine's throttle over its readings, with its state kept between batches."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames)).sort_values(order)
        state = tuple(held.get) if held.exists else ("nominal", 0, 0, 0)
        actions, state = throttle_batch(state, new[temperature].to_numpy(float), new[margin].to_numpy(float))
        held.update(state)
        yield pd.DataFrame({machine: key[0], order: new[order].to_numpy(), "action": actions})

    types = dict(readings.dtypes)
    return readings.groupBy(machine).applyInPandasWithState(
        step, f"{machine} {types[machine]}, {order} {types[order]}, action string", "state string, hard int, soft int, cool int", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and give its rows, from a table beside its checkpoint: of a stream in complete
    mode the last state, in append mode all batches. A batch that is run again overwrites its own rows."""
    path = f"{checkpoint}-{name}-rows"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/{number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)


def upsert_batches(stream: DataFrame, path: str, key: str, order: str, checkpoint: str) -> None:
    """Append each batch's latest rows to a log; readers take the latest of each key with ``mutation.latest``."""
    from ..operators.mutation import latest

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, [key], [F.desc(order)]).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
