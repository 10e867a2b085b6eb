"""The same annotation on streams: files of sentences as they arrive, and windowed counts with late and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_table(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files below ``path`` as a stream. The schema is given: a stream must not infer it from what happens to be there."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """Drops repeated deliveries that arrive within the lateness; state older than that is given up."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_accuracy(results: DataFrame, time: str = "ran_at", window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Decisions and right ones per predicate in tumbling windows of event time. A repeated delivery within the lateness counts once;
    rows later than the watermark fall away, rows with a null time do too. Works on a batch table as well."""
    results = results.withColumn(time, F.col(time).cast("timestamp"))
    rows = results.where(F.col(time).isNotNull() & F.col("result_value").isNotNull())
    rows = once(rows, ["result_id"], time, lateness) if results.isStreaming else rows.dropDuplicates(["result_id"])
    per = rows.groupBy(F.window(time, window).alias("w"), "predicate").agg(F.count(F.lit(1)).alias("n"), F.sum("result_value").alias("correct"))
    return per.select(F.col("w.start").alias("start"), "predicate", "n", "correct")
