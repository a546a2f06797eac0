"""Weekly score monitors over a stream. The batch operators have no streaming counterpart elsewhere; this is an extra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", every: str = "7 days", late: str = "1 day", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """(start, keys, n, total) of tumbling windows; a window is closed `late` after its end. Works on batches as well."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("__t", late)
    g = rows.groupBy(F.window("__t", every).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")
