"""Incremental append as a stream: files arrive, late and repeated rows fall away, the rest is appended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str = "time", delay: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark; what is older than it is dropped."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return stamped.dropDuplicatesWithinWatermark(list(keys))


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that appends to a store partitioned by day."""

    def write(batch: DataFrame, _: int) -> None:
        batch.withColumn("day", F.to_date("time")).write.mode("append").partitionBy("day").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_means(stream: DataFrame, values: Sequence[str], key: str = "unit_id", delay: str = "1 day") -> DataFrame:
    """Tumbling days of a stream, final once the watermark has passed them."""
    stamped = stream.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay)
    return stamped.groupBy(key, F.window("time", "1 day")).agg(*(F.avg(v).alias(v) for v in values)).select(key, F.to_date("window.start").alias("day"), *values)
