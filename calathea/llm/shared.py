"""Scratch tables and files in the folder that all executors share, and small helpers of the operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and all runs on this machine, below a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "calathea")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/calathea/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table in the shared folder and read again: a short lineage that outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or path, and the path in it; works on executors."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def publish(uri: str, writer) -> None:
    """Let writer(stream) fill a file; it gets its name only when complete, so retried tasks leave no halves."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        writer(out)
    fs.move(part, path)


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that clashes with none of those taken (Spark ignores case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def column(df: DataFrame, name: str):
    """A column by its plain name, dots and all."""
    return F.col(f"`{name}`")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors that don't start beside it or with it on their path."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or os.getcwd() == str(root) or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    with tempfile.TemporaryDirectory() as folder:
        name = os.path.join(folder, f"{root.name}-calathea.zip")
        with zipfile.ZipFile(name, "w") as z:
            for f in (root / "calathea").rglob("*.py"):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(name)
    _shipped.add(app)
