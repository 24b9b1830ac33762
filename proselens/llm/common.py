"""Helpers that the corpus operators share: where scratch tables go, how workers find this package, and the
definition of a word."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder

#: A word: a maximal run of bytes other than the six ASCII white-space bytes. ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when it runs from a source tree."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends here and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the table behind a materialised df, once nothing reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives freed memory back to the system: an idle worker else keeps what its largest task needed."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def lean(run):
    """A function over batches that releases memory when it ends."""

    def go(batches):
        yield from run(batches)
        release()

    return go


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def schema_with(df: DataFrame, *more: tuple[str, str]) -> StructType:
    """df's schema and more fields after it (DataFrame.schema itself is shared and must not be added to)."""
    out = StructType(list(df.schema.fields))
    for name, kind in more:
        out = out.add(name, kind)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
