
from __future__ import annotations

import inspect
import os
import sys
from collections.abc import Callable
from datetime import date, timedelta

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tunelake.fixtures import mapping, oracle  # noqa: E402
from tunelake.functions import keys, measures  # noqa: E402
from tunelake.operators import ranking  # noqa: E402
from tunelake.operators.lookups import lookup  # noqa: E402
from tunelake.plans import jobs, marts, patterns, quality_suite, reports  # noqa: E402
from tunelake.schemas import RAW  # noqa: E402
from tunelake.session import scratch_path  # noqa: E402
from tunelake.sinks.catalog import publish  # noqa: E402
from tunelake.sinks.store import EVENTS, Store  # noqa: E402
from tunelake.sources import landing  # noqa: E402
from tunelake.sources.tables import events_between  # noqa: E402
from tunelake.streaming import distinct, ingest  # noqa: E402

try:  # the operators for training text are optional: without their folder, everything else runs
    import corpus_pipeline
    from tunelake.llm import queries as llm_queries
except ImportError:
    corpus_pipeline = llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]


def _inputs(staged: dict[str, DataFrame]) -> tuple[DataFrame, ...]:
    return (staged["stg_stream_events"], staged["stg_tracks"], staged["stg_artists"],
            staged["stg_users"])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Averages to eight places; the last bits may differ between engines."""
    return df.selectExpr(*(
        f"{measures.round_half(c, 8)} as {c}" if c in columns else f"`{c}`" for c in df.columns
    ))


# --- models ---------------------------------------------------------------------------------


MART_TABLES = ("stream_events", "tracks", "artists", "users")


def _staged(model: str) -> Query:
    table = model.removeprefix("stg_")
    return lambda spark, sf: mapping.staged(spark, sf, table)[model]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.staged(spark, sf, EVENTS)["stg_stream_events"]


def enriched_events(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.enriched(mapping.staged(spark, sf, *MART_TABLES))


def enriched_lines(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.enriched(
        mapping.staged_lines(spark, sf, *MART_TABLES), mapping.line_keys(spark, sf))


def _mart(build: Callable[..., DataFrame], lines: bool = False) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        staged = (mapping.staged_lines if lines else mapping.staged)(spark, sf, *MART_TABLES)
        counted = "keys_of" in inspect.signature(build).parameters
        keys = {"keys_of": mapping.line_keys(spark, sf)} if lines and counted else {}
        return _rounded(build(*_inputs(staged), **keys), "avg_pct_played")
    return run


def daily_pivots(spark: SparkSession, sf: str) -> DataFrame:
    daily = marts.daily_listening_stats(*_inputs(mapping.staged(spark, sf, *MART_TABLES)))
    return daily.select(
        "event_date", "total_streams", *(c for c in daily.columns if c.startswith("streams_"))
    )


def user_modes(spark: SparkSession, sf: str) -> DataFrame:
    activity = marts.user_activity(*_inputs(mapping.staged(spark, sf, *MART_TABLES)))
    return activity.select("user_id", "top_genre", "preferred_platform", "preferred_device")


def inactive_users(spark: SparkSession, sf: str) -> DataFrame:
    activity = marts.user_activity(*_inputs(mapping.staged(spark, sf, *MART_TABLES)))
    return activity.where("total_streams = 0").select(
        "user_id", "username", "total_streams", "total_listening_hours", "first_stream_date"
    )


def snowflake_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue by region along the chain line, supplier, nation, region."""
    def read(name: str) -> DataFrame:
        return mapping.table(spark, sf, name)

    places = lookup(
        read("nation").selectExpr("n_nationkey", "n_name", "n_regionkey as r_regionkey"),
        read("region"), "r_regionkey",
    ).withColumnRenamed("n_nationkey", "s_nationkey")
    makers = lookup(
        read("supplier").select("s_suppkey", "s_nationkey"), places, "s_nationkey"
    ).withColumnRenamed("s_suppkey", "l_suppkey")
    per_supplier = read("lineitem").groupBy("l_suppkey").agg(
        F.expr("count(*) as n"), F.expr("sum(l_quantity) as quantity")
    )
    return lookup(per_supplier, makers, "l_suppkey").groupBy("r_name", "n_name").agg(
        F.expr("sum(n) as line_count"),
        F.expr("sum(quantity) as total_quantity"),
        F.expr("count(l_suppkey) as suppliers"),
    )


# --- pattern checks ---------------------------------------------------------------------------


def _volume(spark: SparkSession, sf: str) -> DataFrame:
    return marts.daily_volume(_events(spark, sf))


def _order_volume(spark: SparkSession, sf: str) -> DataFrame:
    orders = mapping.table(spark, sf, "orders")
    return marts.daily_volume(orders.selectExpr("cast(o_orderdate as date) as event_date"))


def weekend_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.weekend_ratio(_volume(spark, sf))


def evening_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.evening_ratio(_events(spark, sf))


def seasonal_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Over ``orders``, which covers several years."""
    return patterns.seasonal_ratio(_order_volume(spark, sf))


def pareto_users(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.pareto_users(_events(spark, sf))


def pareto_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.pareto_tracks(_events(spark, sf))


def pareto_artists(spark: SparkSession, sf: str) -> DataFrame:
    staged = mapping.staged(spark, sf, EVENTS, "tracks")
    return patterns.pareto_artists(staged["stg_stream_events"], staged["stg_tracks"])


def pareto_users_l(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.pareto_users(mapping.staged_lines(spark, sf, EVENTS)["stg_stream_events"])


def pareto_tracks_l(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.pareto_tracks(mapping.staged_lines(spark, sf, EVENTS)["stg_stream_events"])


def pattern_summary(spark: SparkSession, sf: str) -> DataFrame:
    staged = mapping.staged(spark, sf, EVENTS, "tracks")
    return patterns.pattern_summary(staged["stg_stream_events"], staged["stg_tracks"])


# --- data tests -------------------------------------------------------------------------------


def _models(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    raw = mapping.raw_tables(spark, sf)
    staged = mapping.stage(raw)
    models = {f"raw.{name}": df for name, df in raw.items()}
    return models | staged | {"int_enriched_events": jobs.enriched(staged)} | jobs.build_marts(
        staged
    )


def _tests(suite: Callable[[dict[str, DataFrame]], DataFrame], *marts_named: str) -> Query:
    """A suite over all models, or over the named marts, which are then the only ones built."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        if not marts_named:
            return suite(_models(spark, sf))
        return suite(jobs.build_marts(mapping.staged(spark, sf, *MART_TABLES), marts_named))
    return run


# --- loads ------------------------------------------------------------------------------------


def _raw(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The raw tables with exactly the stored types."""
    return {t: _raw_table(spark, sf, t) for t in RAW}


def _raw_table(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return landing.typed(mapping.raw_table(spark, sf, table), table)


def _store(spark: SparkSession, label: str, *tables: str) -> Store:
    store = Store(spark, scratch_path(spark, label))
    store.create_raw_tables(tables)
    return store


def _table(store: Store, table: str) -> DataFrame:
    return store.read("raw", table).drop("_dlt_load_id", "_dlt_id")


def _longer(events: DataFrame) -> DataFrame:
    return events.withColumn("ms_played", F.expr("ms_played + 1000"))


def _span(spark: SparkSession, sf: str) -> tuple[date, date]:
    """First and last day of the events: one row."""
    days = _raw_table(spark, sf, EVENTS).selectExpr("cast(started_at as date) as day")
    return tuple(days.agg(F.min("day"), F.max("day")).first())


def _first_and_second(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two loads that overlap: the first two thirds of the days, and the last two thirds with other
    values."""
    events, (first, last) = _raw_table(spark, sf, EVENTS), _span(spark, sf)
    third = (last - first).days // 3, 2 * (last - first).days // 3
    low, high = (first + timedelta(days=n) for n in third)
    return events_between(events, first, high), _longer(events_between(events, low, last))


def replace_load(spark: SparkSession, sf: str) -> DataFrame:
    store, tracks = _store(spark, "replace", "tracks"), _raw_table(spark, sf, "tracks")
    store.replace("raw", "tracks", tracks.withColumn("title", F.lit("old")))
    store.replace("raw", "tracks", tracks)
    return _table(store, "tracks")


def replace_events(spark: SparkSession, sf: str) -> DataFrame:
    """What was stored before, on other days, is gone."""
    store, events = _store(spark, "replace", EVENTS), _raw_table(spark, sf, EVENTS)
    later = F.expr("cast(started_at + interval 100 days as timestamp_ntz)")
    store.replace("raw", EVENTS, events.withColumn("started_at", later))
    store.replace("raw", EVENTS, events)
    return _table(store, EVENTS)


def upsert_replace(spark: SparkSession, sf: str) -> DataFrame:
    """Users in debt change to ``free``, and each rich one brings a new user."""
    store = _store(spark, "upsert", "users")
    users = _raw_table(spark, sf, "users")
    balance = mapping.table(spark, sf, "customer").selectExpr(
        "cast(c_custkey as string) as user_id", "c_acctbal"
    )
    changed = users.join(balance, "user_id").where("c_acctbal < 0 or c_acctbal > 9000")
    batch = changed.withColumns({
        "user_id": F.expr("if(c_acctbal < 0, user_id, concat('friend-of-', user_id))"),
        "subscription_type": F.expr("if(c_acctbal < 0, 'free', subscription_type)"),
    }).select(*users.columns)
    store.insert_or_replace("users", users)
    store.insert_or_replace("users", batch)
    return _table(store, "users")


def upsert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "ignore", EVENTS)
    for batch in _first_and_second(spark, sf):
        store.insert_or_ignore(EVENTS, batch)
    return _table(store, EVENTS)


def merge_events(spark: SparkSession, sf: str) -> DataFrame:
    """The second load runs twice; the table is the same as after one run."""
    store = _store(spark, "merge", EVENTS)
    first, second = _first_and_second(spark, sf)
    for batch in (first, second, second):
        store.merge_events(batch)
    return _table(store, EVENTS)


def merge_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """With the keys indexed, the middle third of the days moves by 100 days and gets other values; then
    everything is loaded once more where its key is missing, which it is nowhere."""
    store, events = _store(spark, "indexed", EVENTS), _raw_table(spark, sf, EVENTS)
    store.replace("raw", EVENTS, events)
    store.index_keys()
    (first, last), later = _span(spark, sf), "cast(started_at + interval 100 days as timestamp_ntz)"
    low, high = (first + timedelta(days=n * (last - first).days // 3) for n in (1, 2))
    moved = _longer(events_between(events, low, high)).withColumn("started_at", F.expr(later))
    store.merge_events(moved)
    store.insert_or_ignore(EVENTS, events)
    return _table(store, EVENTS)


def _land(spark: SparkSession, sf: str, *tables: str) -> str:
    """Land the raw tables, or those named, as JSON pages of at most 500 records; events by day."""
    path = scratch_path(spark, "landing")
    pages = {
        "artists": "popularity_rank div 500", "albums": "datediff(release_date, '2000-01-01')",
        "tracks": "track_id div 500", "users": "user_id div 500", EVENTS: "event_id div 500",
    }
    for table in tables or RAW:
        df = mapping.raw_table(spark, sf, table)
        by_day = {}
        if table == EVENTS:
            first, last = _span(spark, sf)
            days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
            by_day = {"day": "started_at", "days": days}
        landing.write_pages(df, f"{path}/{table}", pages[table], 500, **by_day)
    return path


def landing_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = _land(spark, sf, "tracks")
    return landing.read_pages(spark, f"{path}/tracks", "tracks").drop("_dlt_load_id", "_dlt_id")


def unknown_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The tracks land with two fields that the schema lacks, one of them in some records only."""
    path = scratch_path(spark, "landing")
    tracks = mapping.raw_table(spark, sf, "tracks").selectExpr(
        "*", "concat('code-', track_id) as code",
        "if(popularity_rank <= 100, cast(popularity_rank as bigint), null) as peak")
    landing.write_pages(tracks, f"{path}/tracks", "track_id div 500", 500)
    return landing.field_types(landing.extra_fields(spark, f"{path}/tracks", "tracks"))


def daily_load(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, "load")
    first, last = _span(spark, sf)
    jobs.daily_load(store, _land(spark, sf), first.isoformat(), today=last + timedelta(days=1))
    return _table(store, EVENTS)


def _history(spark: SparkSession, sf: str, label: str) -> Store:
    store = _store(spark, label)
    first, last = _span(spark, sf)
    jobs.backfill(store, _raw(spark, sf), first.isoformat(), last.isoformat())
    return store


def backfill_rows(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.row_report(_history(spark, sf, "backfill")).where("n_rows is not null")


def built_daily_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Backfill, build the mart tables, read one back."""
    store = _history(spark, sf, "build")
    jobs.build(store)
    return _rounded(store.read("marts", "daily_listening_stats"), "avg_pct_played")


def build_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """What the writes of the marts found of their own tests."""
    return jobs.build(_history(spark, sf, "verdicts"))


def _refreshed(mart: str) -> Query:
    """Load the first two thirds of the days, the middle third with other values and days of its own
    devices; build; then merge the last two thirds as they are, refreshing the marts. What the
    marts hold is then that of the events themselves."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        store = _store(spark, "refresh")
        for table in ("artists", "albums", "tracks", "users"):
            store.replace("raw", table, _raw_table(spark, sf, table))
        events, (first, last) = _raw_table(spark, sf, EVENTS), _span(spark, sf)
        low, high = (first + timedelta(days=n * (last - first).days // 3) for n in (1, 2))
        altered = _longer(events_between(events, low, high)).withColumns({
            "platform": F.lit("web"), "completed": F.lit(True), "user_id": F.lit("1")})
        before = events_between(events, first, low - timedelta(days=1)).unionByName(altered)
        jobs.refresh(store, before, day_in_key=True)
        jobs.refresh(store, events_between(events, low, last), day_in_key=True)
        return _rounded(store.read("marts", mart), "avg_pct_played")
    return run


def global_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every track by its streams, and of every part by its order lines."""
    tracks = _events(spark, sf).groupBy("track_id").agg(F.count("*").alias("streams"))
    parts = mapping.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("track_id")).agg(
        F.count("*").alias("streams"))
    return ranking.global_rank(tracks, "streams", "track_id").withColumn(
        "source", F.lit("events")).unionByName(
        ranking.global_rank(parts, "streams", "track_id").withColumn("source", F.lit("lines")))


def enriched_view(spark: SparkSession, sf: str) -> DataFrame:
    """Backfill, enter the models in the catalog, read the lasting view back by its name."""
    publish(_history(spark, sf, "view"), [])
    return spark.table("dev_intermediate.int_enriched_events")


def date_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    events = mapping.raw_table(spark, sf, EVENTS)
    return events_between(events, date(2024, 1, 10), date(2024, 1, 16)).select(
        "event_id", "user_id", "track_id", "started_at", "ms_played"
    )


def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.count_rows({f"raw.{t}": df for t, df in mapping.raw_tables(spark, sf).items()})


# --- expressions and reports ------------------------------------------------------------------


def surrogate_key(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    day, number = F.col("event_date"), F.col("event_id")
    return events.select(
        "event_id",
        keys.surrogate_key(F.lit("user"), F.col("user_id")).alias("user_key"),
        keys.event_key(day, number).alias("event_key"),
        keys.natural_event_key(day, number).alias("natural_key"),
    )


def completion_flags(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.raw_table(spark, sf, EVENTS).select(
        "event_id", "ms_played", "track_duration_ms", "completed", "skipped"
    )


def calendar_expected_volume(spark: SparkSession, sf: str) -> DataFrame:
    return reports.volume_against_expected(_volume(spark, sf))


def calendar_expected_volume_l(spark: SparkSession, sf: str) -> DataFrame:
    return reports.volume_against_expected(_order_volume(spark, sf))


def last_n_days(spark: SparkSession, sf: str) -> DataFrame:
    daily = marts.daily_listening_stats(*_inputs(mapping.staged(spark, sf, *MART_TABLES)))
    return _rounded(reports.last_days(daily, 7), "avg_pct_played")


def top_tracks_yesterday(spark: SparkSession, sf: str) -> DataFrame:
    top = marts.top_tracks_daily(*_inputs(mapping.staged(spark, sf, *MART_TABLES)))
    return _rounded(
        reports.top_tracks_of_yesterday(top, 10, as_of=date(2024, 1, 21)), "avg_pct_played"
    )


def genres_yesterday(spark: SparkSession, sf: str) -> DataFrame:
    genres = marts.genre_trends(*_inputs(mapping.staged(spark, sf, *MART_TABLES)))
    return _rounded(reports.genres_of_yesterday(genres, as_of=date(2024, 1, 21)), "avg_pct_played")


# --- streams ----------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    # A pattern, so that it may be one file or a folder of files.
    path = f"{sf}/event[s].parquet"
    stream = spark.readStream.schema(mapping.TABLES["events"]).parquet(path)
    return mapping.stream_events(stream)


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The events arrive a third at a time, the newest days first, and then all once more; each
    arrival is a run of the stream, which goes on where the last one ended. Each event is kept once."""
    path, (first, last) = scratch_path(spark, "dedup"), _span(spark, sf)
    raw = mapping.raw_table(spark, sf, EVENTS)
    third = (last - first).days // 3
    edges = [first, first + timedelta(days=third), first + timedelta(days=2 * third)]
    parts = list(zip(edges, [*(d - timedelta(days=1) for d in edges[1:]), last]))
    for n, (a, b) in enumerate([*reversed(parts), *reversed(parts)]):
        events_between(raw, a, b).write.parquet(f"{path}/in/arrival={n}")
        stream = spark.readStream.schema(raw.schema).parquet(f"{path}/in/arrival=*")
        ingest.to_table(
            ingest.deduplicated(stream), f"{path}/rows", f"{path}/checkpoint"
        ).awaitTermination()
    return spark.read.schema(raw.schema).parquet(f"{path}/rows")


def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Landed pages are read as a stream and merged into the event table."""
    store = _store(spark, "stream", EVENTS)
    pages = landing.stream_pages(spark, f"{_land(spark, sf, EVENTS)}/{EVENTS}", EVENTS)
    ingest.merge_stream(pages, store, f"{store.root}/checkpoint").awaitTermination()
    return _table(store, EVENTS)


def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "daily")
    totals = ingest.daily_stats(_event_stream(spark, sf))
    ingest.latest_totals(totals, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return _rounded(spark.read.parquet(f"{path}/rows"), "avg_pct_played")


def stream_pages_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Odd pages of all days arrive first, then the others; a day is merged once it is complete."""
    store, landed = _store(spark, "complete", EVENTS), _land(spark, sf, EVENTS)
    pages = landing.landed_pages(spark, f"{landed}/{EVENTS}", EVENTS)
    for odd in (1, 0):
        pages.where(f"page % 2 = {odd}").write.mode("append").partitionBy("date").json(
            f"{store.root}/arriving")
        ingest.merge_complete_days(
            f"{store.root}/arriving", store, f"{store.root}/facts", f"{store.root}/checkpoint"
        ).awaitTermination()
    return _table(store, EVENTS)


def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Users per day and per seven days, exact, from the stream's daily states."""
    path = scratch_path(spark, "distinct")
    states = distinct.daily_bitmaps(_event_stream(spark, sf), "user_id")
    distinct.kept(states, f"{path}/states", f"{path}/checkpoint").awaitTermination()
    states = spark.read.parquet(f"{path}/states")
    return distinct.distinct_ids(states).withColumnRenamed("n_ids", "users").join(
        distinct.distinct_ids(states, 7).withColumnRenamed("n_ids", "users_7_days"), "event_date")


# --- contract ---------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    return queries()["daily_stats"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {
        "stg_artists": _staged("stg_artists"),
        "stg_albums": _staged("stg_albums"),
        "stg_tracks": _staged("stg_tracks"),
        "stg_users": _staged("stg_users"),
        "stg_events": _staged("stg_stream_events"),
        "enriched_events": enriched_events,
        "enriched_lines": enriched_lines,
        "daily_stats": _mart(marts.daily_listening_stats),
        "daily_pivots": daily_pivots,
        "top_tracks_daily": _mart(marts.top_tracks_daily),
        "genre_trends": _mart(marts.genre_trends),
        "user_activity": _mart(marts.user_activity),
        "user_modes": user_modes,
        "inactive_users": inactive_users,
        "snowflake_join_l": snowflake_lines,
        "daily_stats_l": _mart(marts.daily_listening_stats, lines=True),
        "top_parts_daily_l": _mart(marts.top_tracks_daily, lines=True),
        "genre_trends_l": _mart(marts.genre_trends, lines=True),
        "user_activity_l": _mart(marts.user_activity, lines=True),
        "weekend_ratio": weekend_ratio,
        "evening_ratio": evening_ratio,
        "seasonal_ratio": seasonal_ratio,
        "pareto_users": pareto_users,
        "pareto_tracks": pareto_tracks,
        "pareto_artists": pareto_artists,
        "pareto_users_l": pareto_users_l,
        "pareto_tracks_l": pareto_tracks_l,
        "pattern_summary": pattern_summary,
        "dq_not_null": _tests(quality_suite.not_null_tests),
        "dq_unique": _tests(quality_suite.unique_tests),
        "dq_accepted_values": _tests(quality_suite.accepted_values_tests),
        "dq_relationships": _tests(quality_suite.relationship_tests),
        "dq_rate_range": _tests(quality_suite.range_tests, "daily_listening_stats"),
        "dq_rank_range": _tests(quality_suite.range_tests, "top_tracks_daily"),
        "dq_share_sum": _tests(quality_suite.share_tests, "genre_trends"),
        "replace_load": replace_load,
        "replace_events": replace_events,
        "upsert_replace": upsert_replace,
        "upsert_ignore": upsert_ignore,
        "merge_events": merge_events,
        "merge_indexed": merge_indexed,
        "landing_scan": landing_scan,
        "unknown_fields": unknown_fields,
        "daily_load": daily_load,
        "backfill_rows": backfill_rows,
        "built_daily_stats": built_daily_stats,
        "build_verdicts": build_verdicts,
        "incremental_marts": _refreshed("user_activity"),
        "incremental_days": _refreshed("daily_listening_stats"),
        "global_rank": global_rank,
        "enriched_view": enriched_view,
        "date_range_scan": date_range_scan,
        "row_counts": row_counts,
        "surrogate_key": surrogate_key,
        "completion_flags": completion_flags,
        "calendar_expected_volume": calendar_expected_volume,
        "calendar_expected_volume_l": calendar_expected_volume_l,
        "last_n_days": last_n_days,
        "top_tracks_yesterday": top_tracks_yesterday,
        "genres_yesterday": genres_yesterday,
        "stream_dedup": stream_dedup,
        "stream_merge": stream_merge,
        "stream_daily": stream_daily,
        "stream_pages_complete": stream_pages_complete,
        "stream_distinct": stream_distinct,
        **(llm_queries.QUERIES | {"pipeline": corpus_pipeline.run} if llm_queries else {}),
    }


def _stored(table: str, source: str | None = None) -> str:
    """A raw table with the stored types."""
    casts = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
             "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    columns = ", ".join(
        f"CAST({f.name} AS {casts[f.dataType.simpleString()]}) AS {f.name}"
        for f in RAW[table].fields if not f.name.startswith("_")
    )
    day = ", CAST(started_at AS DATE) AS event_date" if table == EVENTS else ""
    return f"SELECT {columns}{day} FROM {source or 'raw_' + table}"


def oracle_sql() -> dict[str, str]:
    """For each key in ``queries()``, the equivalent DuckDB SQL."""
    def rows(model: str) -> str:
        return f"SELECT * FROM {model}"

    md5 = ("substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
           "substr({h}, 17, 4) || '-' || substr({h}, 21)")
    day = "CAST(started_at AS DATE)"
    span = "(max(d) - min(d))"
    second_load = (
        f"(SELECT e.* REPLACE (CASE WHEN {day} {{}} THEN ms_played + 1000 ELSE ms_played END "
        f"AS ms_played) FROM raw_stream_events e, (SELECT min(d) + CAST({span} // 3 AS INTEGER) "
        f"AS low, min(d) + CAST(2 * {span} // 3 AS INTEGER) AS high "
        f"FROM (SELECT {day} AS d FROM raw_stream_events)))")
    customers = "(SELECT u.*, c_acctbal FROM raw_users u JOIN customer ON user_id = c_custkey)"
    selects = {
        "stg_artists": rows("stg_artists"),
        "stg_albums": rows("stg_albums"),
        "stg_tracks": rows("stg_tracks"),
        "stg_users": rows("stg_users"),
        "stg_events": rows("stg_stream_events"),
        "enriched_events": rows("int_enriched_events"),
        "enriched_lines": rows("int_enriched_lines"),
        "daily_stats": rows("daily_listening_stats"),
        "daily_pivots": "SELECT event_date, total_streams, COLUMNS('streams_(ios|android|web|"
                        "chromecast|alexa|free|premium|family|student)') "
                        "FROM daily_listening_stats",
        "top_tracks_daily": rows("top_tracks_daily"),
        "genre_trends": rows("genre_trends"),
        "user_activity": rows("user_activity"),
        "user_modes": "SELECT user_id, top_genre, preferred_platform, preferred_device "
                      "FROM user_activity",
        "inactive_users": "SELECT user_id, username, total_streams, total_listening_hours, "
                          "first_stream_date FROM user_activity WHERE total_streams = 0",
        "snowflake_join_l": """
            SELECT r_name, n_name, COUNT(*) AS line_count, SUM(l_quantity) AS total_quantity,
                   COUNT(DISTINCT s_suppkey) AS suppliers
            FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey
            LEFT JOIN nation ON n_nationkey = s_nationkey
            LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name""",
        "daily_stats_l": rows("daily_listening_stats_l"),
        "top_parts_daily_l": rows("top_tracks_daily_l"),
        "genre_trends_l": rows("genre_trends_l"),
        "user_activity_l": rows("user_activity_l"),
        "weekend_ratio": oracle.weekend("daily_volume"),
        "evening_ratio": oracle.evening("stg_stream_events"),
        "seasonal_ratio": oracle.seasonal("order_volume"),
        "pareto_users": oracle.pareto("user_id", "stg_stream_events"),
        "pareto_tracks": oracle.pareto("track_id", "stg_stream_events"),
        "pareto_artists": oracle.pareto_artists("stg_stream_events"),
        "pareto_users_l": oracle.pareto("user_id", "stg_line_events"),
        "pareto_tracks_l": oracle.pareto("track_id", "stg_line_events"),
        "pattern_summary": oracle.summary(),
        "dq_not_null": oracle.not_null(),
        "dq_unique": oracle.unique(),
        "dq_accepted_values": oracle.accepted_values(),
        "dq_relationships": oracle.relationships(),
        "dq_rate_range": oracle.ranges(("daily_listening_stats",)),
        "dq_rank_range": oracle.ranges(("top_tracks_daily",)),
        "dq_share_sum": oracle.shares(),
        "replace_load": _stored("tracks"),
        "replace_events": _stored(EVENTS),
        "upsert_replace": _stored("users", f"""(
            SELECT CAST(user_id AS VARCHAR) AS user_id, * EXCLUDE (user_id, c_acctbal)
                   REPLACE (CASE WHEN c_acctbal < 0 THEN 'free' ELSE subscription_type END
                            AS subscription_type) FROM {customers}
            UNION ALL
            SELECT 'friend-of-' || user_id, * EXCLUDE (user_id, c_acctbal) FROM {customers}
            WHERE c_acctbal > 9000)"""),
        "upsert_ignore": _stored(EVENTS, second_load.format("> high")),
        "merge_events": _stored(EVENTS, second_load.format(">= low")),
        "merge_indexed": _stored(EVENTS, second_load.format("BETWEEN low AND high").replace(
            "AS ms_played", f"AS ms_played, CASE WHEN {day} BETWEEN low AND high "
            "THEN started_at + INTERVAL 100 DAY ELSE started_at END AS started_at")),
        "landing_scan": _stored("tracks"),
        "unknown_fields": "SELECT 'code' AS field, 'STRING' AS type, COUNT(*) AS records "
                          "FROM raw_tracks UNION ALL SELECT 'peak', 'BIGINT', COUNT(*) "
                          "FROM raw_tracks WHERE popularity_rank <= 100",
        "daily_load": _stored(EVENTS),
        "backfill_rows": " UNION ALL ".join(
            f"SELECT 'raw.{t}' AS \"table\", COUNT(*) AS n_rows FROM raw_{t}" for t in RAW),
        "built_daily_stats": rows("daily_listening_stats"),
        "build_verdicts": " UNION ALL ".join(
            f"SELECT * FROM ({sql}) WHERE model IN ({', '.join(map(repr, jobs.MARTS))})"
            for sql in (oracle.not_null(), oracle.accepted_values(),
                        oracle.ranges(("daily_listening_stats", "top_tracks_daily")))),
        "incremental_marts": "SELECT * REPLACE (CAST(user_id AS VARCHAR) AS user_id) "
                             "FROM user_activity",
        "incremental_days": rows("daily_listening_stats"),
        "global_rank": """
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY streams DESC,
                                         track_id NULLS LAST) AS rank
            FROM (SELECT 'events' AS source, track_id, COUNT(*) AS streams
                  FROM stg_stream_events GROUP BY track_id
                  UNION ALL
                  SELECT 'lines', l_partkey, COUNT(*) FROM lineitem GROUP BY l_partkey)""",
        "enriched_view": "SELECT * REPLACE (CAST(event_id AS VARCHAR) AS event_id, "
                         "CAST(track_id AS VARCHAR) AS track_id, "
                         "CAST(user_id AS VARCHAR) AS user_id) FROM int_enriched_events",
        "date_range_scan": "SELECT event_id, user_id, track_id, started_at, ms_played FROM "
                           "stg_stream_events WHERE event_date BETWEEN DATE '2024-01-10' AND "
                           "DATE '2024-01-16'",
        "row_counts": " UNION ALL ".join(
            f"SELECT 'raw.{t}' AS \"table\", COUNT(*) AS n_rows FROM raw_{t}" for t in RAW),
        "surrogate_key": f"""
            SELECT event_id, {md5.format(h='u')} AS user_key, {md5.format(h='e')} AS event_key,
                   'ev-' || strftime(event_date, '%Y-%m-%d') || '-' || event_id AS natural_key
            FROM (SELECT *, md5('user-' || user_id) AS u,
                         md5('event-' || strftime(event_date, '%Y-%m-%d') || '-' || event_id) AS e
                  FROM stg_stream_events)""",
        "completion_flags": "SELECT event_id, ms_played, track_duration_ms, completed, skipped "
                            "FROM raw_stream_events",
        "calendar_expected_volume": oracle.calendar("daily_volume"),
        "calendar_expected_volume_l": oracle.calendar("order_volume"),
        "last_n_days": "SELECT * FROM daily_listening_stats ORDER BY event_date DESC LIMIT 7",
        "top_tracks_yesterday": "SELECT * FROM top_tracks_daily WHERE event_date = "
                                "DATE '2024-01-20' ORDER BY daily_rank LIMIT 10",
        "genres_yesterday": "SELECT * FROM genre_trends WHERE event_date = DATE '2024-01-20'",
        "stream_dedup": "SELECT * FROM raw_stream_events",
        "stream_merge": _stored(EVENTS),
        "stream_daily": "SELECT event_date, total_streams, total_listening_hours, avg_pct_played, "
                        "completed_streams, skipped_streams, completion_rate_pct, skip_rate_pct, "
                        "COLUMNS('streams_(ios|android|web|chromecast|alexa)') "
                        "FROM daily_listening_stats",
        "stream_pages_complete": _stored(EVENTS),
        "stream_distinct": """
            SELECT d.event_date, d.users, COUNT(DISTINCT e.user_id) AS users_7_days
            FROM (SELECT event_date, COUNT(DISTINCT user_id) AS users FROM stg_stream_events
                  WHERE user_id IS NOT NULL GROUP BY event_date) d
            JOIN stg_stream_events e
              ON e.event_date BETWEEN d.event_date - 6 AND d.event_date
            GROUP BY d.event_date, d.users""",
    }
    llm = llm_queries.ORACLE_SQL if llm_queries else {}
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        llm = llm | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: oracle.sql(select) for name, select in selects.items()} | llm
