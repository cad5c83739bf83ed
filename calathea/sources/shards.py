"""Shards of vectors as a Spark data source: read, followed as a stream, and appended to all or nothing.

A shard is an .npz file of parallel arrays (asset_id, embedding, det_score) and of the provenance it was made with. A
folder of shards has a log, ``_commits``: what its files name is there, and nothing else; a folder without a log is read
as it stands. ::

    register(spark)
    spark.read.format("vector_shards").option("expect.model", "m1").load(path)
    spark.readStream.format("vector_shards").option("listings", folder).load(path)
    rows.write.format("vector_shards").option("batch", "2024-05-01").option("made.model", "m1").mode("append").save(path)

Reading. A partition is a shard. Filters on `shard` choose files, those on `asset_id` rows: of a shard without one that
fits, no vector is read (with spark.sql.python.filterPushdown.enabled). A shard of other provenance than expected stops
the read.
Stream. An offset is the number of a listing of (path, size, time of change), kept in the folder `listings`; a batch reads
what is new or has changed since the last, so a mended shard comes once more, and at most `most` shards (1,000).
Writing. Tasks write to ``_staged`` and take back what they wrote if they fail. The commit is one file; a batch that is
written again changes nothing, and what a failed job or a lost executor leaves is never named. Rows without a vector leave
nothing but their asset_id in the log's files of keys: ``processed`` has all that were worked off.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

SCHEMA = "shard string, asset_id long, embedding array<float>, det_score float"
COMMITS, STAGED = "_commits", "_staged"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    return fs, path.rstrip("/")


def _names(fs: pafs.FileSystem, folder: str, end: str) -> list[pafs.FileInfo]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == pafs.FileType.File and f.base_name.endswith(end) and not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name)


def _json(fs: pafs.FileSystem, path: str) -> dict:
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _publish(fs: pafs.FileSystem, path: str, value: dict) -> None:
    """A small file that is there whole or not at all."""
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(json.dumps(value).encode())
    fs.move(part, path)


def shards(uri: str) -> list[tuple[str, int, int]]:
    """(name, size, microseconds of the last change) of the shards that a folder has."""
    fs, folder = _place(uri)
    log = _names(fs, f"{folder}/{COMMITS}", ".json")
    found = {f.base_name: f for f in _names(fs, folder, ".npz")}
    if log:
        named = [n for f in log for n in _json(fs, f.path)["shards"]]
        found = {n: found[n] for n in named if n in found}
    return [(n, f.size, (f.mtime_ns or 0) // 1000) for n, f in sorted(found.items())]


@dataclass
class Shard(D.InputPartition):
    name: str


_RANGES = {D.GreaterThan: np.greater, D.GreaterThanOrEqual: np.greater_equal, D.LessThan: np.less, D.LessThanOrEqual: np.less_equal, D.EqualTo: np.equal}


class _Read:
    """What reader and stream reader share: a shard's rows as record batches."""

    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.expected = {k.removeprefix("expect."): v for k, v in options.items() if k.startswith("expect.")}
        self.rows = int(options.get("rows", 10_000))
        self.wanted: list[tuple[type, object]] = []

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        fs, folder = _place(self.uri)
        with fs.open_input_file(f"{folder}/{partition.name}") as f, np.load(f) as z:
            for k, v in self.expected.items():
                if k not in z or str(z[k]) != v:
                    raise ValueError(f"{partition.name}: {k} is {z[k] if k in z else 'missing'}, not {v}")
            ids = z["asset_id"].astype(np.int64)
            fits = np.ones(len(ids), bool)
            for kind, value in self.wanted:
                fits &= np.isin(ids, list(value)) if kind is D.In else _RANGES[kind](ids, value)
            at = np.flatnonzero(fits)
            if not len(at):
                return  # the vectors are another member of the archive, and stay unread
            vectors, scores = z["embedding"].astype(np.float32), z["det_score"].astype(np.float32)
            for s in range(0, len(at), self.rows):
                some = at[s : s + self.rows]
                flat = pa.array(vectors[some].ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * vectors.shape[1]), flat)
                yield pa.record_batch([pa.array([partition.name] * len(some)), pa.array(ids[some]), lists, pa.array(scores[some])], names=["shard", "asset_id", "embedding", "det_score"])


class ShardReader(_Read, D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.chosen: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (*_RANGES, D.In)) and f.attribute == ("asset_id",) and f.value is not None:
                self.wanted.append((type(f), f.value))
            elif isinstance(f, (D.EqualTo, D.In, D.StringStartsWith)) and f.attribute == ("shard",):
                self.chosen.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[Shard]:
        fits = {D.EqualTo: lambda n, v: n == v, D.In: lambda n, v: n in v, D.StringStartsWith: lambda n, v: n.startswith(v)}
        return [Shard(n) for n, _, _ in shards(self.uri) if all(fits[k](n, v) for k, v in self.chosen)] or [Shard("")]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.name else iter(())


class Listings:
    """Numbered listings of files, {name: [size, time of change]}, in a folder that outlasts the driver: what a stream's
    offsets stand for. The next one takes in at most `most` new or changed files; the others wait."""

    def __init__(self, uri: str, most: int):
        self.fs, self.folder = _place(uri)
        self.most = most
        kept = _names(self.fs, self.folder, ".json")
        self.last = int(kept[-1].base_name.removesuffix(".json")) if kept else 0

    def __getitem__(self, n: int) -> dict[str, list[int]]:
        return _json(self.fs, f"{self.folder}/{n:012d}.json") if n else {}

    def advance(self, now: dict[str, list[int]]) -> int:
        before = self[self.last]
        changed = [n for n in sorted(now) if before.get(n) != now[n]]
        if changed or before.keys() - now.keys():
            self.last += 1
            taken = {n: state for n, state in before.items() if n in now} | {n: now[n] for n in changed[: self.most]}
            _publish(self.fs, f"{self.folder}/{self.last:012d}.json", taken)
        return self.last

    def forget(self, end: int) -> None:
        for f in _names(self.fs, self.folder, ".json"):
            if int(f.base_name.removesuffix(".json")) < end - 1:
                self.fs.delete_file(f.path)


class ShardStream(_Read, D.DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.listings = Listings(options["listings"], int(options.get("most", 1_000)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"listing": self.listings.advance({n: [size, at] for n, size, at in shards(self.uri)})}

    def partitions(self, start: dict, end: dict) -> Sequence[Shard]:
        before, now = self.listings[start["listing"]], self.listings[end["listing"]]
        return [Shard(n) for n, state in sorted(now.items()) if before.get(n) != state]

    def commit(self, end: dict) -> None:
        self.listings.forget(end["listing"])


@dataclass
class Staged(D.WriterCommitMessage):
    shard: str | None
    keys: str | None


class ShardWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.uri, self.batch = options["path"], options.get("batch") or uuid.uuid4().hex
        self.staged = f"{STAGED}/{uuid.uuid4().hex}"  # of this attempt alone
        self.made = {k.removeprefix("made."): v for k, v in options.items() if k.startswith("made.")}

    def _save(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        fs, folder = _place(self.uri)
        buffer = io.BytesIO()
        np.savez(buffer, **arrays, **self.made)
        fs.create_dir(f"{folder}/{self.staged}", recursive=True)
        with fs.open_output_stream(f"{folder}/{self.staged}/{name}") as f:
            f.write(buffer.getbuffer())

    def _drop(self, *names: str) -> None:
        fs, folder = _place(self.uri)
        for name in names:
            if fs.get_file_info(f"{folder}/{self.staged}/{name}").type == pafs.FileType.File:
                fs.delete_file(f"{folder}/{self.staged}/{name}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        name, parts, keys = f"{self.batch}-{uuid.uuid4().hex}.npz", [], []
        try:
            for batch in iterator:
                keys.append(batch.column("asset_id").to_numpy().astype(np.int64))
                some = batch.filter(batch.column("embedding").is_valid())
                if some.num_rows:
                    flat = some.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                    parts.append((some.column("asset_id").to_numpy(), flat.reshape(some.num_rows, -1), some.column("det_score").to_numpy(zero_copy_only=False).astype(np.float32)))
            if parts:
                self._save(name, dict(zip(("asset_id", "embedding", "det_score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))
            if keys:
                self._save(f"keys-{name}", {"asset_id": np.unique(np.concatenate(keys))})
        except BaseException:
            self._drop(name, f"keys-{name}")
            raise
        return Staged(name if parts else None, f"keys-{name}" if keys else None)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, folder = _place(self.uri)
        done = [m for m in messages if m]
        log = f"{folder}/{COMMITS}/{self.batch}.json"
        if fs.get_file_info(log).type == pafs.FileType.File:
            self.abort(messages)  # this batch is there already
            return
        for m in done:
            for name in (m.shard, m.keys):
                if name:
                    fs.create_dir(f"{folder}/{COMMITS}/keys", recursive=True)
                    fs.move(f"{folder}/{self.staged}/{name}", f"{folder}/{COMMITS}/keys/{name}" if name == m.keys else f"{folder}/{name}")
        _publish(fs, log, {"shards": [m.shard for m in done if m.shard], "keys": [m.keys for m in done if m.keys]})
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        """What this attempt has staged goes; a task that still runs can only add what nothing names."""
        fs, folder = _place(self.uri)
        if fs.get_file_info(f"{folder}/{self.staged}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{folder}/{self.staged}")


class VectorShards(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(dict(self.options))

    def streamReader(self, schema: StructType) -> ShardStream:  # noqa: N802
        return ShardStream(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        if overwrite:
            raise ValueError("shards are appended to, never overwritten")
        return ShardWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorShards)


def _keys(names: list[str], uri: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _place(uri)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                with fs.open_input_file(f"{folder}/{COMMITS}/keys/{names[at]}") as f, np.load(f) as z:
                    yield pa.record_batch([pa.array(z["asset_id"])], names=["asset_id"])

    return run


def processed(spark: SparkSession, uri: str) -> DataFrame:
    """(asset_id): what has been worked off, with or without vectors; a resumed run leaves these out by an anti join."""
    fs, folder = _place(uri)
    names = [n for f in _names(fs, f"{folder}/{COMMITS}", ".json") for n in _json(fs, f.path)["keys"]]
    return spark.range(0, len(names), 1, max(1, min(len(names), 1_000))).mapInArrow(_keys(names, uri), "asset_id long").distinct()
