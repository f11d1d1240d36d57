"""Raw tables, day ranges, and frames that come from elsewhere."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.schemas import RAW


def read_raw(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(RAW[table]).parquet(path)


def from_rows(spark: SparkSession, rows: Iterable, table: str) -> DataFrame:
    """A small set of rows, such as a test's, by position in the raw table's columns."""
    return spark.createDataFrame(list(rows), RAW[table])


def day_range(
    start: date | str | None = None, end: date | str | None = None, today: date | None = None
) -> tuple[date, date]:
    """First and last day to load, both included. Both default to yesterday. A range that is
    reversed or reaches into the future is refused."""
    today = today or date.today()
    yesterday = today - timedelta(days=1)
    start, end = (
        date.fromisoformat(d) if isinstance(d, str) else d or yesterday for d in (start, end)
    )
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    if end > today:
        raise ValueError(f"{end} is in the future")
    return start, end


def events_between(events: DataFrame, start: date, end: date) -> DataFrame:
    """Events of the days from ``start`` to ``end``, both included. The condition is on the stored
    columns, so it prunes day partitions where there are any and reaches the file scan."""
    if "event_date" in events.columns:
        events = events.where(F.col("event_date").between(F.lit(start), F.lit(end)))
    after = F.lit(end + timedelta(days=1)).cast("timestamp_ntz")
    first = F.lit(start).cast("timestamp_ntz")
    return events.where((F.col("started_at") >= first) & (F.col("started_at") < after))
