"""Sources and sinks of the pipelines."""

from __future__ import annotations

import csv
import io
import itertools
import json
import posixpath
import re
import tarfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S


def files(spark: SparkSession, path: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """(path, name, extension, mtime, size) of the files below a folder, without reading them; extensions are upper case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    out = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"))
    out = out.withColumn("extension", S.extension(F.col("name")))
    return out if extensions is None else out.where(F.col("extension").isin(*extensions))


def csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; no rows where there is no file."""
    try:
        return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def csv_after_junk(spark: SparkSession, path: str, needed: Sequence[str], key_pattern: str, first: str = "uuid", multi_line: bool = False) -> DataFrame:
    """The rows of CSV files that have other text before their header: the header is the first line that begins with
    the column `first`, and rows are the lines after it whose first field looks like a key. All columns are text; it is
    an error if a needed one is missing. With `multi_line`, quoted fields may go over lines, which makes a file one
    task's stream, and rows with fewer fields than the header go."""
    lines = spark.read.text(path)
    headers = lines.where(F.col("value").startswith(f"{first},")).select(F.col("value")).distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError(f"{path}: {len(headers) or 'no'} header lines that begin with {first}")
    columns = next(csv.reader([headers[0].value]))
    if missing := [c for c in needed if c not in columns]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    if multi_line:
        paths = files(spark, path).select("path")
        return paths.repartition(max(1, paths.count())).mapInArrow(_records(columns, first, key_pattern), schema)
    fields = F.from_csv("value", F.lit(schema), {"mode": "PERMISSIVE"})
    return lines.where(F.col("value").rlike(f"^{key_pattern},")).select(fields.alias("r")).select("r.*")


def _records(columns: list[str], first: str, key_pattern: str) -> Callable:
    """The records of files, read as streams."""

    def rows_of(path: str) -> Iterator[list[str]]:
        fs, at = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
        with fs.open_input_stream(at) as raw, io.TextIOWrapper(raw, "utf-8", errors="replace", newline="") as text:
            if any(line.startswith(f"{first},") for line in text):  # the rest follows the header
                yield from (r for r in csv.reader(text) if len(r) >= len(columns) and re.match(key_pattern, r[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = rows_of(path)
                while some := list(itertools.islice(found, 5_000)):
                    yield pa.record_batch([pa.array([r[k] for r in some], pa.string()) for k in range(len(columns))], names=columns)

    return run


def jsonl(spark: SparkSession, path: str, schema: str, required: str) -> DataFrame:
    """JSON lines; those that do not parse, or lack the required field, go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(required).isNotNull())


_PAIRS = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())]))


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of packed cells, how many whole ones each cell has); null cells have none."""
    cells = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = cells.buffers()
    at = np.frombuffer(offsets, np.int64)[cells.offset : cells.offset + len(cells) + 1]
    size = np.dtype(kind).itemsize
    counts = np.diff(at) // size
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(at[:-1], counts) + step * size
    return np.ascontiguousarray(raw[start[:, None] + np.arange(size)]).view(kind).ravel() if len(start) else np.zeros(0, kind), counts


@F.arrow_udf(_PAIRS)
def unpack_scores(ids: pa.Array, scores: pa.Array) -> pa.Array:
    """Packed little-endian uint32 ids and float16 scores, paired; the longer one's rest goes."""
    (i, ni), (x, nx) = _flat(ids, "<u4"), _flat(scores, "<f2")
    n = np.minimum(ni, nx)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    take = lambda values, counts: values[np.repeat(np.cumsum(counts) - counts, n) + step]
    pairs = pa.StructArray.from_arrays([pa.array(take(i, ni).astype(np.int64)), pa.array(take(x, nx).astype(np.float64))], names=["id", "score"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pairs)


def packed_labels(items: DataFrame, key: str, ids: str, scores: str, lexicon: DataFrame) -> DataFrame:
    """(key, place, category, content, score) of packed label arrays, looked up in a lexicon (lexeme_id, category, content)."""
    flat = items.select(key, F.posexplode(unpack_scores(F.col(ids), F.col(scores))).alias("place", "x")).select(key, "place", F.col("x.id").alias("lexeme_id"), "x.score")
    return flat.join(lexicon, "lexeme_id").select(key, "place", "category", "content", "score")


def _shards(provenance: dict[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content)) as z:
                    for k, v in provenance.items():
                        if str(z[k]) != v:
                            raise ValueError(f"{path}: {k} is {z[k]}, not {v}")
                    vectors = z["embedding"].astype(np.float32)
                    yield pa.record_batch({
                        "path": [path] * len(vectors), "asset_id": pa.array(z["asset_id"].astype(np.int64)), "embedding": pa.array(list(vectors), pa.list_(pa.float32())),
                        "det_score": pa.array(z["det_score"].astype(np.float32)),
                    })

    return run


def vector_shards(spark: SparkSession, path: str, provenance: dict[str, str]) -> DataFrame:
    """(path, asset_id, embedding, det_score) of .npz shards; a shard of other provenance stops the read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return raw.mapInArrow(_shards(provenance), "path string, asset_id long, embedding array<float>, det_score float")


def write_csv(rows: DataFrame, path: str, overwrite: bool = True, most: int = 5_000_000) -> None:
    """A CSV with a header; one file up to `most` rows, as people read manifests, and beyond that parts of so many.
    Without `overwrite` an existing one is an error."""
    out = rows.coalesce(1) if rows.limit(most + 1).count() <= most else rows.repartition(max(2, -(-rows.count() // most)))
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines, nulls left out; each partition writes its rows as they come."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def bundle(spark: SparkSession, path: str, schema: str, required: str, name: str = "records.jsonl", index: str = "index.sqlite") -> tuple[DataFrame, str | None, dict]:
    """(records, path of the search index or None, manifest) of a bundle: a folder, or a .tgz of one, which is unpacked
    beside it in the same store. The manifest may name the index; records without `required` go."""
    fs, hadoop = _store(spark, path)
    folder = path.rstrip("/")
    if not fs.getFileStatus(hadoop(path)).isDirectory():
        folder = f"{folder}.unpacked-{uuid.uuid4().hex[:8]}"
        _unpack(spark, path, folder)
    manifest = {}
    if fs.exists(hadoop(f"{folder}/manifest.json")):
        manifest = json.loads(bytes(spark.read.format("binaryFile").load(f"{folder}/manifest.json").first().content))
    if not fs.exists(hadoop(f"{folder}/{name}")):
        raise ValueError(f"{path}: no {name}")
    other = f"{folder}/{(manifest.get('search_index') or {}).get('filename') or index}"
    return jsonl(spark, f"{folder}/{name}", schema, required), other if fs.exists(hadoop(other)) else None, manifest


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    """(file system of a path, function from a path to the file system's)."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _unpack(spark: SparkSession, path: str, folder: str) -> None:
    """The plain files of a .tgz, a bundle's few, as files of a folder: streamed, so that no archive is held; names that
    lead out of it are an error."""
    at = lambda uri: pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    (fs, source), (to, root) = at(path), at(folder)
    with fs.open_input_stream(source) as raw, tarfile.open(fileobj=raw, mode="r|gz") as t:
        for member in t:
            name = posixpath.normpath(member.name)
            if name.startswith(("/", "..")):
                raise ValueError(f"{path}: unsafe name {member.name}")
            if member.isfile():
                to.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                content = t.extractfile(member)
                with to.open_output_stream(f"{root}/{name}") as out:
                    while block := content.read(1 << 20):
                        out.write(block)


class CachedCount:
    """How many files a folder has, counted at most once in so many seconds, by one caller for all that ask meanwhile;
    their contents aren't read. After a count that failed, none is tried for a while: the last one holds, if there is one."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 600, hold_off: float = 60):
        self.spark, self.path, self.seconds, self.hold_off = spark, path, seconds, hold_off
        self.value, self.due, self.error, self.lock = None, 0.0, None, threading.Lock()

    def get(self) -> int:
        with self.lock:
            if time.monotonic() >= self.due:
                try:
                    self.value, self.error = files(self.spark, self.path).select("path").count(), None
                    self.due = time.monotonic() + self.seconds
                except Exception as e:  # noqa: BLE001
                    self.error, self.due = e, time.monotonic() + self.hold_off
            if self.value is None:
                raise OSError(f"{self.path} cannot be counted") from self.error
            return self.value


def append_processed(rows: DataFrame, keys: DataFrame, path: str, batch: str) -> bool:
    """Append results and the keys they came from, also of those without results, all or nothing: what a batch has written
    counts when its one file in ``_commits`` names it. A batch that is there already is not written again (False)."""
    spark, root = rows.sparkSession, path.rstrip("/")
    fs, hadoop = _store(spark, path)
    if fs.exists(hadoop(f"{root}/_commits/{batch}.json")):
        return False
    names = {kind: f"{kind}/{batch}-{uuid.uuid4().hex[:8]}" for kind in ("rows", "keys")}
    rows.write.parquet(f"{root}/{names['rows']}")
    keys.write.parquet(f"{root}/{names['keys']}")
    part = hadoop(f"{root}/_commits/.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(json.dumps(names).encode()))
    out.close()
    if not fs.rename(part, hadoop(f"{root}/_commits/{batch}.json")):
        raise OSError(f"{path}: cannot commit {batch}")
    return True


def committed(spark: SparkSession, path: str, schema: str, kind: str = "rows") -> DataFrame:
    """The rows, or the keys, of all committed batches; a resumed run leaves out these keys."""
    root = path.rstrip("/")
    fs, hadoop = _store(spark, path)
    if not fs.exists(hadoop(f"{root}/_commits")):
        return spark.createDataFrame([], schema)
    names = [r[0] for r in spark.read.schema(f"{kind} string").json(f"{root}/_commits/*.json").collect()]
    return spark.read.schema(schema).parquet(*(f"{root}/{n}" for n in names)) if names else spark.createDataFrame([], schema)


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Copies of tables below a folder, and their manifest (name, rows, checksum, sha256: of the files' digests in order
    of names), which is written as `manifest` beside them."""
    spark = next(iter(tables.values())).sparkSession
    found = []
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
        copy = spark.read.parquet(f"{path}/{name}")
        r = copy.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*copy.columns).cast("decimal(38,0)")).alias("c")).first()
        found.append((name, r.n, str(r.c), _digest(spark, f"{path}/{name}")))
    out = spark.createDataFrame(found, "name string, rows long, checksum string, sha256 string")
    out.write.json(f"{path}/manifest")
    return out


def _digest(spark: SparkSession, path: str) -> str:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    own = raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    return own.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: x["digest"]), ""), 256)).first()[0]


def intact(spark: SparkSession, path: str) -> DataFrame:
    """(name, intact) of a snapshot's tables: whether their files are those of its manifest."""
    rows = spark.read.json(f"{path}/manifest").select("name", "sha256").collect()
    return spark.createDataFrame([(r.name, _digest(spark, f"{path}/{r.name}") == r.sha256) for r in rows], "name string, intact boolean")


def retain(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete all but the `keep` last folders of a place, by name (snapshots are named by time); returns those deleted."""
    fs, hadoop = _store(spark, path)
    names = sorted(x.getPath().getName() for x in fs.listStatus(hadoop(path)) if x.isDirectory())
    gone = names[: max(0, len(names) - keep)]
    for name in gone:
        fs.delete(hadoop(f"{path.rstrip('/')}/{name}"), True)
    return gone


def mirror(spark: SparkSession, source: str, target: str, days: float, now: float) -> list[str]:
    """Copy a snapshot below the target if its files are intact there, then delete the target's folders that are older
    than so many days; returns those deleted. The copy just made stays, whatever its age."""
    fs, hadoop = _store(spark, target)
    name = hadoop(source).getName()
    part, final = hadoop(f"{target.rstrip('/')}/.{name}.part"), hadoop(f"{target.rstrip('/')}/{name}")
    fs.delete(part, True)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(_store(spark, source)[0], hadoop(source), fs, part, False, conf)
    if not all(r.intact for r in intact(spark, part.toString()).collect()):
        raise ValueError(f"the copy of {source} differs from its manifest")
    fs.delete(final, True)
    if not fs.rename(part, final):
        raise OSError(f"{target}: cannot rename the copy")
    gone = []
    for x in fs.listStatus(hadoop(target)):
        own = x.getPath().getName()
        if x.isDirectory() and own != name and not own.startswith(".") and x.getModificationTime() / 1000 < now - days * 86_400:
            fs.delete(x.getPath(), True)
            gone.append(own)
    return sorted(gone)
