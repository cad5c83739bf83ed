"""Tables between the rounds of iterative derivations: written to the shared folder, so they outlive executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset and all runs on this machine, below a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "calathea")
        spark.conf.set("spark.checkpoint.dir", base)
    if base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/calathea/{name}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame, name: str = "round") -> DataFrame:
    """The rows, written out and read again."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
