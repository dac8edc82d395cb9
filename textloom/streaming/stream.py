"""Chunking and indexing of a stream of documents. Chunking keeps no state, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.chunkers import chunk
from textloom.operators.index import ParquetIndex


def chunk_stream(docs: DataFrame, name: str = "recursive", **options) -> DataFrame:
    """A streaming frame of chunks."""
    if not docs.isStreaming:
        raise ValueError("want a streaming DataFrame")
    return chunk(docs, name, **options)


def index_stream(docs: DataFrame, index: ParquetIndex, checkpoint: str, *, name: str = "recursive", source_col: str = "source", embedder: str = "hashing", **options) -> StreamingQuery:
    """Chunks each micro-batch into the index. Keyed upserts make a batch that is sent again harmless."""
    chunks = chunk(docs, name, keep=[source_col], **options)

    def write(batch: DataFrame, _: int) -> None:
        index.index(batch.drop("chunk_index"), source=F.coalesce(F.col(source_col), F.lit("")), embedder=embedder)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(spark: SparkSession, path: str, schema, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events by type and window over a Parquet stream; rows later than `late` are dropped by the watermark."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
