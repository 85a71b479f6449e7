"""The count, group and retention operators over unbounded input, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.functions import paths
from tessella.functions.aggregates import DAY_MS
from tessella.operators.dataset import Dataset, Filter


def stream_group_by(stream: DataFrame, path: str, time: str, window: str = "1 day", late: str = "1 hour", filter: Filter = None) -> DataFrame:
    """(window, key, count) of the values at a path, per tumbling window of event time; windows close once `late` has passed."""
    data = Dataset.table(stream.withWatermark(time, late)).where(filter)
    values = data.values(path)
    value = values.column if values.single else F.explode(values.array())
    rows = data.df.select(time, value.alias("value"))
    return rows.groupBy(F.window(time, window), paths.key_text(F.col("value"), values.dtype).alias("key")).agg(F.count("*").alias("count"))


def stream_retention(stream: DataFrame, user: str, time: str, late: str = "1 hour", gap: str = "30 days", days: tuple[int, ...] = (1, 7)) -> DataFrame:
    """(user, session, first, last, dN...) once a user has been silent for `gap`: whether logins span N days.

    State per user is two times, not the logins.
    """
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), F.col(user)).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    span = F.unix_millis(F.col("last").cast("timestamp")) - F.unix_millis(F.col("first").cast("timestamp"))
    return rows.withColumns({f"d{n}": span >= n * DAY_MS for n in days})


def run_to_end(result: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now into Parquet files, exactly once, and stop; the next run goes on from the checkpoint."""
    query = result.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
