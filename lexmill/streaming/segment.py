"""Segmentation of streams. It is stateless and row-local, so the batch functions apply as they are, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.config import SegmentConfig
from lexmill.operators.kernel import Packed
from lexmill.operators.matcher import Lexicon, segment


def segment_stream(stream: DataFrame, lexicon: Lexicon | Packed, config: SegmentConfig = SegmentConfig(), text: str = "text") -> DataFrame:
    """A streaming DataFrame's tokens."""
    if not stream.isStreaming:
        raise ValueError("not a stream: use lexmill.operators.matcher.segment")
    return segment(stream, lexicon, config, text)


def segment_folder(spark: SparkSession, source: str, target: str, checkpoint: str, lexicon: Lexicon | Packed, config: SegmentConfig = SegmentConfig(), columns: tuple[str, ...] = ("item_id", "text"), lower: bool = False) -> None:
    """Segment all Parquet rows that a folder or glob holds by now into ``target``; a rerun takes up where the last one ended."""
    schema = spark.read.parquet(source).select(*columns).schema
    stream = spark.readStream.schema(schema).parquet(source)
    if lower:
        stream = stream.withColumn("text", F.lower("text"))
    query = segment_stream(stream, lexicon, config).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
