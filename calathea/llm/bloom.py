"""A fixed-size Bloom filter of long keys, built on the executors: a bounded broadcast that only spares shuffled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

BITS = 1 << 23


def _places(key: np.ndarray) -> tuple[np.ndarray, ...]:
    h = mix(key.view(np.uint64))
    return tuple(((h >> np.uint64(k)) % np.uint64(BITS)).astype(np.int64) for k in (0, 20, 40))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS, bool)
    for batch in batches:
        for at in _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)):
            bits[at] = True
    cells = np.packbits(bits).view(np.int64)
    at = np.flatnonzero(cells)
    yield pa.record_batch({"cell": pa.array(at), "bits": pa.array(cells[at])})


def build(keys: DataFrame) -> np.ndarray:
    """The filter's bytes for a table of one long column; the driver gets BITS / 64 rows at most."""
    rows = keys.mapInArrow(_cells, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def test(bloom: np.ndarray, keys: pa.Array) -> np.ndarray:
    """False only for keys that the filter was not built from; nulls count as 0."""
    key = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    hit = np.ones(len(key), bool)
    for at in _places(key):
        hit &= (bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return hit
