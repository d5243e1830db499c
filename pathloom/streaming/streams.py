"""Expressions in Structured Streaming.  They keep no state, so the same columns run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.api import evaluate_many


def project(stream: DataFrame, expressions: dict[str, str], col: str | None = None, **options) -> DataFrame:
    """The stream with one column for each named expression."""
    return evaluate_many(stream, expressions, col, **options)


def windowed_count(stream: DataFrame, time_col: str, window: str, lateness: str, *keys: str) -> DataFrame:
    """Rows by event-time window and keys; state of windows older than lateness is dropped."""
    return stream.withWatermark(time_col, lateness).groupBy(F.window(time_col, window).alias("window"), *keys).count()


def start(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """Writes what is available and stops; a restart with the same checkpoint goes on where it stopped."""
    return stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
