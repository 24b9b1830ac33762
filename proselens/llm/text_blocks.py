"""Blocks of documents as a bucketed table, and exchanges between blocks and keys.

Corpus-wide statistics of small things (words, word pairs, passages) are found in two moves: each block sends its
distinct keys, packed into one binary row a key partition; the reducer of a partition sums them over all blocks and
sends every block its answers back, in the block's own order. A key that a third of the corpus holds costs a row a
block, not a row an occurrence. The table of blocks is bucketed by block, so only answers move in the second step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import lean, parts, release, scratch, ship
from .words import slices


class Blocks:
    """docs in blocks of about ``size`` bytes of text, whole rows of docs each, written once."""

    def __init__(self, docs: DataFrame, text: str, size: int):
        spark = self.spark = docs.sparkSession
        ship(spark)
        at = docs.columns.index(text)

        def pack(batches):
            from pyspark import TaskContext

            block = TaskContext.get().partitionId() << 24
            held: list[pa.RecordBatch] = []
            n = 0

            def flush():
                nonlocal held, n, block
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(pa.Table.from_batches(held).combine_chunks())
                row = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])
                held, n, block = [], 0, block + 1
                return row

            for b in batches:
                for x in slices(b, at, size):
                    held.append(x)
                    n += pc.sum(pc.binary_length(x.column(at))).as_py() or 0
                    if n >= size * 0.7:
                        yield flush()
            if held:
                yield flush()

        self.n = max(2 * parts(spark), 8)
        self.name = f"blocks_{uuid.uuid4().hex}"
        packed = docs.mapInArrow(lean(pack), "block long, data binary")
        packed.write.bucketBy(self.n, "block").option("path", scratch(spark, "blocks")).option("compression", "none").saveAsTable(self.name)
        self.df = spark.table(self.name)
        # The plan knows the files; the catalogue needn't keep a name for them.
        spark.sql(f"DROP TABLE {self.name}")

    def emit(self, f: Callable, schema: str) -> DataFrame:
        """f(block, table) -> record batches, for each block."""

        def run(batches):
            for b in batches:
                for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield from f(block, _open(data.as_buffer()))

        return self.df.mapInArrow(lean(run), schema)

    def answer(self, answers: DataFrame, f: Callable, schema: str | StructType) -> DataFrame:
        """f(block, table, answers) -> table, for each block with its rows of answers (column ``block``)."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = f(left.column(0)[0].as_py(), _open(left.column(1)[0].as_buffer()), right)
            release()
            return out

        return self.df.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def _open(data: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def by_part(part: np.ndarray, n: int):
    """(part, places in it) of the parts that occur; places keep their order."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, order[cut[p] : cut[p + 1]]


def column(t: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, one row's after the other, and the rows' offsets."""
    rows = [np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]
    return np.concatenate(rows) if rows else np.zeros(0, kind), np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
