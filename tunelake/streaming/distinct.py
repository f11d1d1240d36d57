"""Distinct counts of a stream by day, in states that can be merged: over any range of days they come
from the states alone, without the events.

A state only grows (a bitmap by *or*, a sketch by union), so each batch appends the states it changed,
and reading merges the versions of a state. A batch that is repeated replaces its own files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_DAY = "cast(cast(started_at as timestamp_ntz) as date) as event_date"


def daily_bitmaps(raw_events: DataFrame, number: str) -> DataFrame:
    """Exact: the ids of a day as bitmaps of 32,768 numbers each. ``number`` is an expression for
    the id as a whole number, of which few below the highest are unused. Events without a day or
    number do not count. A bitmap is one row of 4 KB, however often its ids occur."""
    return raw_events.selectExpr(_DAY, f"cast({number} as bigint) as id").where(
        "event_date is not null and id is not null"
    ).selectExpr(
        "event_date", "bitmap_bucket_number(id) as bucket", "bitmap_bit_position(id) as place"
    ).groupBy("event_date", "bucket").agg(F.expr("bitmap_construct_agg(place) as ids"))


def daily_sketches(raw_events: DataFrame, column: str, bits: int = 14) -> DataFrame:
    """Approximate, for ids of any kind: one sketch a day of 2^``bits`` registers, with a relative
    error of about 1 / sqrt(2^bits)."""
    return raw_events.selectExpr(_DAY, f"cast({column} as string) as id").where(
        "event_date is not null and id is not null"
    ).groupBy("event_date").agg(F.expr(f"hll_sketch_agg(id, {bits}) as ids"))


def kept(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the states that change to files at ``path``, then stop when all has been read."""
    def keep(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        states.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _spread(states: DataFrame, days: int) -> DataFrame:
    """Each state under every day whose ``days`` days include it, of days that have a state."""
    ends = f"explode(sequence(event_date, date_add(event_date, {days - 1}))) as event_date"
    others = [c for c in states.columns if c not in ("event_date", "batch")]
    return states.selectExpr(ends, *others).join(
        states.select("event_date").distinct(), "event_date", "left_semi")


def distinct_ids(bitmaps: DataFrame, days: int = 1) -> DataFrame:
    """event_date, n_ids: the exact number of ids in the ``days`` days that end with each day."""
    return _spread(bitmaps, days).groupBy("event_date", "bucket").agg(
        F.expr("bitmap_or_agg(ids) as ids")
    ).groupBy("event_date").agg(F.expr("sum(bitmap_count(ids)) as n_ids"))


def estimated_ids(sketches: DataFrame, days: int = 1) -> DataFrame:
    """event_date, n_ids: the number of ids, estimated, as in ``distinct_ids``."""
    return _spread(sketches, days).groupBy("event_date").agg(
        F.expr("hll_sketch_estimate(hll_union_agg(ids)) as n_ids"))
