"""The card pipeline over a stream of pages: every stage is stateless, so batch and stream are one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.cards import cards


def page_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_cards(pages: DataFrame, out: str, checkpoint: str, *, watermark: str | None = None, **options) -> StreamingQuery:
    """Appends the cards of all pages that are there to parquet; with a watermark on fetched_at, a page fetched again within it counts once."""
    if watermark:
        pages = pages.withWatermark("fetched_at", watermark).dropDuplicatesWithinWatermark(["page_id"])
    return cards(pages, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
