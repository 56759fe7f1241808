"""Structured Streaming over a folder of pairs files into a pixel table of additive parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelweave.functions.columns import saturated
from pixelweave.functions.genome import Layout
from pixelweave.operators.pixels import count_pairs
from pixelweave.sources.pairs import binned, parse


def count_stream(spark: SparkSession, folder: str, layout: Layout, out: str, checkpoint: str, zero_based: bool = False, available_now: bool = True) -> StreamingQuery:
    """Count each batch of new files into out/batch=N. A batch that is tried again replaces its own part."""

    def add(batch: DataFrame, number: int) -> None:
        count_pairs(binned(parse(batch), layout, zero_based)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = spark.readStream.text(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counted(spark: SparkSession, out: str) -> DataFrame:
    """The pixels of all batches so far."""
    parts = spark.read.parquet(out).groupBy("bin1_id", "bin2_id")
    return parts.agg(saturated(F.sum(F.col("count").cast("long"))).alias("count"))
