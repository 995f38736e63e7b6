"""Extension: bars from a stream of ticks, with a watermark, appended once per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.sources.contract import append_missing

TICKS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_ticks(spark: SparkSession, path: str, schema: str = TICKS) -> DataFrame:
    """A stream over the parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def bars(ticks: DataFrame, width: str = "1 day", late: str = "2 days", asset: str = "event_type") -> DataFrame:
    """Open, high, low, close, volume and count per asset and window; with a stream, windows close once the watermark passes.

    Open and close are the values with the least and the greatest (time, id).
    """
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    at = F.struct("ts", "event_id")
    out = rows.groupBy(F.window("ts", width).alias("w"), F.col(asset).alias("asset")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("value").alias("volume"))
    return out.select(F.to_date("w.start").alias("date"), "asset", "open", "high", "low", "close", "volume")


def write_bars(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("date", "asset")):
    """Starts a query that appends finished bars to a parquet table; a replayed batch adds no key twice."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_missing(df, path, list(keys))).start()
