"""Extension beyond the batch audit: inflow of a ticket stream by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_inflow(stream: DataFrame, ts: str, id_column: str, late: str = "2 days") -> DataFrame:
    """``day, count``: distinct ids per day; ids repeated within the watermark count once, later rows are dropped."""
    timed = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_column])
    days = timed.groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("count"))
    return days.select(F.to_date("window.start").alias("day"), "count")
