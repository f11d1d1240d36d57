"""Structured Streaming forms of the incremental event load."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunelake.functions import measures as m
from tunelake.plans.staging import stg_stream_events
from tunelake.schemas import EVENTS, PLATFORMS, envelope
from tunelake.sinks.store import Store
from tunelake.sources import landing

FACTS = "date string, page int, records int, total int, has_more boolean, arrived timestamp"


def merge_stream(
    events: DataFrame, store: Store, checkpoint: str, day_in_key: bool = False
) -> StreamingQuery:
    """Merge arriving raw events into the stored table, then stop when all that is there has been
    read. A batch that is repeated after a failure merges to the same table."""
    def merge(batch: DataFrame, _batch_id: int) -> None:
        store.merge_events(batch, day_in_key=day_in_key)

    store.create_raw_tables([EVENTS])
    return (
        events.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_complete_days(
    path: str, store: Store, facts: str, checkpoint: str, files_per_batch: int | None = None,
    day_in_key: bool = False,
) -> StreamingQuery:
    """Merge the events of a day once all of the day's pages have landed below ``path``, in any order
    and over any number of batches, then stop when all that is there has been read.

    What is kept of a page until then is one narrow row at ``facts`` (the pages themselves stay where
    they landed), so a day may have any number of pages, and only days of the batch are looked at.
    A batch that is repeated replaces its rows and merges to the same table; so does a page that
    lands once more after its day. A page without ``data`` never completes its day."""
    spark = store.spark
    reader = spark.readStream.schema(envelope(EVENTS)).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def merge(batch: DataFrame, batch_id: int) -> None:
        arrived = f"{facts}/batch={batch_id}"
        batch.withColumn("arrived", F.current_timestamp()).write.mode("overwrite").parquet(arrived)
        # No more than the days that there are.
        days = [r.date for r in spark.read.schema(FACTS).parquet(arrived).select(
            "date").where("date is not null").distinct().collect()]
        known = page_facts_at(store, facts).where(F.col("date").isin(days))
        waiting = {r.date for r in landing.incomplete(known, EVENTS).select("date").collect()}
        ready = sorted(date.fromisoformat(d) for d in days if d not in waiting)
        if ready:
            store.merge_events(
                landing.read_pages(spark, path, EVENTS, ready), day_in_key=day_in_key)

    store.create_raw_tables([EVENTS])
    return (
        landing.page_facts(reader.json(path)).writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def page_facts_at(store: Store, facts: str) -> DataFrame:
    return store.spark.read.schema(FACTS).parquet(f"{facts}/batch=*")


def overdue_days(store: Store, facts: str, after: str = "1 day") -> DataFrame:
    """Days whose first page landed longer than ``after`` ago and that still are not complete:
    date, first_arrival, and what they have (``records``) of the ``total`` they announce."""
    known = page_facts_at(store, facts)
    arrivals = known.groupBy("date").agg(F.expr("min(arrived) as first_arrival")).where(
        f"first_arrival <= current_timestamp() - interval {after}")
    return landing.incomplete(known, EVENTS).select("date", "records", "total").join(
        arrivals, "date").select("date", "first_arrival", "records", "total")


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event id once, given that its copies arrive within ``delay`` of each other. What counts
    is when an event arrives, not when it happened, so an event may be as old as it likes. State
    is kept no longer than ``delay``."""
    return (
        events.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", delay)
        .dropDuplicatesWithinWatermark(["event_id"]).drop("__arrived")
    )


def daily_stats(raw_events: DataFrame) -> DataFrame:
    """The additive daily measures over one-day windows. Distinct counts are not among them: exact
    ones would keep every id of a day as state. A day with very many events is combined within
    each task before it reaches its state, which is one row. Windows are cut in the events' own
    time, which has no zone; all days are kept, so there is no watermark."""
    staged = stg_stream_events(raw_events)
    return staged.groupBy(F.window("started_at", "1 day")).agg(*map(F.expr, [
        "count(*) as streams",
        "sum(ms_played) as ms",
        f"sum({m.tenths('pct_played')}) as tenths",
        "count(pct_played) as played",
        "sum(cast(is_completed as int)) as completions",
        "sum(cast(is_skipped as int)) as skips",
        *(f"sum({m.matches('platform', p)}) as streams_{p}" for p in PLATFORMS),
    ])).selectExpr(
        "cast(window.start as date) as event_date",
        "streams as total_streams",
        f"{m.hours('ms')} as total_listening_hours",
        f"{m.mean_of_tenths('tenths', 'played')} as avg_pct_played",
        "completions as completed_streams",
        "skips as skipped_streams",
        f"{m.rate_pct('completions', 'streams')} as completion_rate_pct",
        f"{m.rate_pct('skips', 'streams')} as skip_rate_pct",
        *(f"streams_{p}" for p in PLATFORMS),
    )


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to Parquet files, exactly once, and stop when all has been read."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_totals(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the current totals of all days at ``path``, including days not yet closed: the table
    is one row per day and is rewritten with each batch."""
    def rewrite(totals: DataFrame, _batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(path)

    return (
        stats.writeStream.outputMode("complete").foreachBatch(rewrite)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
