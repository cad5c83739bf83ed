"""New, changed and vanished files of a folder as a stream: an ingest that mends itself.

A file source reads a name once and never looks again. Here a file comes again when its size or its time of change is
another than when it was last told, and once more, as gone, when it is no longer there; what reads it is up to the
batch. ::

    register(spark)
    spark.readStream.format("changed_files").option("ends", ".jpg,.heic").option("listings", folder).load(path)

Rows are (path, size, changed: microseconds, kind: new, changed or gone). A batch has at most `most` files (100,000), dealt
to partitions of `each` (1,000). As a batch source, it tells all files, as new.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from .shards import Listings, _place

SCHEMA = "path string, size long, changed long, kind string"


@dataclass
class Files(D.InputPartition):
    rows: list[tuple[str, int | None, int | None, str]]


class _Changes:
    def __init__(self, options: dict[str, str]):
        self.uri, self.each = options["path"], int(options.get("each", 1_000))
        self.ends = tuple(x.lower() for x in options.get("ends", "").split(",") if x)

    def now(self) -> dict[str, list[int]]:
        fs, folder = _place(self.uri)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=True))
        # hidden and unfinished files, and what lies in such folders, are none yet
        shown = (f for f in found if f.type == pafs.FileType.File and not any(x.startswith((".", "_")) for x in f.path.removeprefix(folder).split("/")))
        return {f.path.removeprefix(f"{folder}/"): [f.size, (f.mtime_ns or 0) // 1000] for f in shown if not self.ends or f.path.lower().endswith(self.ends)}

    def dealt(self, before: dict[str, list[int]], now: dict[str, list[int]]) -> list[Files]:
        rows = [(n, *state, "changed" if n in before else "new") for n, state in sorted(now.items()) if before.get(n) != state]
        rows += [(n, None, None, "gone") for n in sorted(before.keys() - now.keys())]
        return [Files(rows[k : k + self.each]) for k in range(0, len(rows), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition.rows:
            columns = zip(*partition.rows, strict=True)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "size", "changed", "kind"])


class FileReader(_Changes, D.DataSourceReader):
    def partitions(self) -> Sequence[Files]:
        return self.dealt({}, self.now())


class FileStream(_Changes, D.DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.listings = Listings(options["listings"], int(options.get("most", 100_000)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"listing": self.listings.advance(self.now())}

    def partitions(self, start: dict, end: dict) -> Sequence[Files]:
        return self.dealt(self.listings[start["listing"]], self.listings[end["listing"]])

    def commit(self, end: dict) -> None:
        self.listings.forget(end["listing"])


class ChangedFiles(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(dict(self.options))

    def streamReader(self, schema: StructType) -> FileStream:  # noqa: N802
        return FileStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangedFiles)
