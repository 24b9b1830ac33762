"""Session set-up."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession | None = None) -> None:
    """Lets Python workers import this package when it runs from a source tree."""
    root, env = str(Path(__file__).resolve().parents[1]), (spark or SparkSession.active()).sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors share. Only where that is unset and
    everything runs on this machine, as in tests, a temporary folder of its own; a cluster without one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: tables in between need a folder that all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='proselens-')}")
        base = _OWN[0]
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: what reads it more than once doesn't work it out again, and
    lost executors don't lose it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local(cores: int = 8, **conf: str) -> SparkSession:
    """A session of this machine for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
