"""Operators on streams. All are stateless across documents, so each micro-batch is a batch job and no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import stylometry
from ..plans.analyze import analyse


def documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """Documents of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def style_stream(docs: DataFrame) -> DataFrame:
    """Style features of a stream, one projection."""
    return stylometry.run(docs)


def analyse_stream(docs: DataFrame, write: Callable[[dict[str, DataFrame], int], None], checkpoint: str, **options) -> StreamingQuery:
    """The whole analysis of each micro-batch, handed to write(tables, batch)."""
    return docs.writeStream.foreachBatch(lambda df, batch: write(analyse(df, **options), batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
