"""Daily sums of a stream of sales, for files that arrive while the engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import contract


def daily_sums(stream: DataFrame, lateness: str = "2 days", date: str = contract.DATE, value: str = contract.AMOUNT) -> DataFrame:
    """(ds, y) of each day; rows later than ``lateness`` behind the newest are left out, so state stays bounded."""
    days = stream.withWatermark(date, lateness).groupBy(F.window(date, "1 day").alias("w"))
    return days.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("y")).select(F.to_date("w.start").alias("ds"), "y")


def write(days: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Appends each day to Parquet once its watermark has passed; the checkpoint makes a restart exact."""
    return days.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
