"""The same computations over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(key, start, end, n)``: runs of events no more than ``gap`` apart, late ones within the watermark included."""
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("end")).select(key, F.col("w.start").alias("start"), "end", "n")


def sampled(stream: DataFrame, key: str, time: str, value: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``(key, start, n, mean)`` per tumbling window."""
    return stream.withWatermark(time, late).groupBy(key, F.window(time, every).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.col("w.start").alias("start"), "n", "mean")


def run_to_table(result: DataFrame, to: str, checkpoint: str) -> None:
    """Process what the sources hold now and leave the complete result at ``to``."""
    query = (
        result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(to)).start()
    )
    query.awaitTermination()
