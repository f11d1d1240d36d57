"""The jobs a user runs: load, backfill, build, test, check, report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame

from tunelake.plans import marts
from tunelake.plans.enrich import enriched_events
from tunelake.plans.patterns import pattern_summary
from tunelake.plans.quality_suite import all_tests, watched, watched_tests
from tunelake.plans.staging import stage
from tunelake.schemas import DIMENSIONS, EVENTS, RAW
from tunelake.session import scratch_path
from tunelake.sinks.catalog import publish
from tunelake.sinks.store import Store, in_days
from tunelake.sources.landing import extra_fields, read_pages
from tunelake.sources.tables import day_range, events_between

MARTS = {
    "daily_listening_stats": marts.daily_listening_stats,
    "top_tracks_daily": marts.top_tracks_daily,
    "genre_trends": marts.genre_trends,
    "user_activity": marts.user_activity,
}


def daily_load(
    store: Store,
    landing: str,
    start: str | None = None,
    today: date | None = None,
    dry_run: bool = False,
    day_in_key: bool = False,
    keep_extra: bool = False,
) -> tuple[date, date]:
    """Load landed pages: dimensions are replaced, and events from ``start`` to yesterday (by
    default yesterday only) are merged on their key. Only the pages of these days are opened, and
    nothing is written unless all pages are complete. With ``day_in_key`` (see the merge) the load
    costs no more than its days. With ``keep_extra``, fields that the schema lacks are kept beside
    the raw tables; that reads the pages once more. A dry run only works out the days."""
    first, last = day_range(start, None, today)
    if dry_run:
        return first, last
    store.create_raw_tables()
    days = [first + timedelta(days=n) for n in range((last - first).days + 1)]
    found = {t: read_pages(store.spark, f"{landing}/{t}", t) for t in DIMENSIONS}
    events = read_pages(store.spark, f"{landing}/{EVENTS}", EVENTS, days)
    for table, df in found.items():
        store.replace("raw", table, df)
    store.merge_events(events_between(events, first, last), day_in_key=day_in_key)
    if keep_extra:
        for table in RAW:
            of_days = days if table == EVENTS else None
            store.keep_extra(
                table, extra_fields(store.spark, f"{landing}/{table}", table, of_days))
    return first, last


def backfill(
    store: Store,
    history: dict[str, DataFrame],
    start: str,
    end: str | None = None,
    skip_reference: bool = False,
    today: date | None = None,
    day_in_key: bool = False,
) -> tuple[date, date]:
    """Load the days from ``start`` to ``end`` (yesterday by default) of a history of raw tables,
    all in one job: dimension rows replace stored ones, stored events win over new ones."""
    first, last = day_range(start, end, today)
    store.create_raw_tables()
    if not skip_reference:
        for table in DIMENSIONS:
            store.insert_or_replace(table, history[table])
    store.insert_or_ignore(
        EVENTS, events_between(history[EVENTS], first, last), day_in_key=day_in_key)
    return first, last


def staged_models(store: Store) -> dict[str, DataFrame]:
    return stage({table: store.read("raw", table) for table in RAW})


def build_marts(
    staged: dict[str, DataFrame], names: Iterable[str] = tuple(MARTS)
) -> dict[str, DataFrame]:
    """The named marts as frames, by name."""
    inputs = (staged["stg_stream_events"], staged["stg_tracks"], staged["stg_artists"],
              staged["stg_users"])
    return {name: MARTS[name](*inputs) for name in names}


def enriched(
    staged: dict[str, DataFrame], keys_of: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    return enriched_events(staged["stg_stream_events"], staged["stg_tracks"],
                           staged["stg_artists"], staged["stg_users"], keys_of)


def build(store: Store, parallel: int = 4, values: DataFrame | None = None) -> DataFrame:
    """Rebuild the mart tables from the raw tables, and enter all models in the session catalog:
    staged models and enriched events as views, the rest as tables. The marts are submitted side
    by side, so that one's last tasks do not leave the cluster idle. Returns the marts' tests of nulls,
    values and ranges, which the writes themselves made. With stored ``values`` of the same events (see
    ``marts.user_values``), ``user_activity`` is made of these and doesn't read the events."""
    staged = staged_models(store)
    built = build_marts(staged, MARTS if values is None else DAY_MARTS)
    if values is not None:
        built["user_activity"] = marts.activity_of(
            values, staged["stg_tracks"], staged["stg_artists"], staged["stg_users"])
    models = {name: watched(name, df) for name, df in built.items()}
    with ThreadPoolExecutor(parallel) as pool:
        writes = [pool.submit(store.replace, "marts", name, model.df)
                  for name, model in models.items()]
        for write in writes:
            write.result()
    publish(store, list(MARTS))
    return watched_tests(models, {name: store.read("marts", name) for name in models})


#: Sums behind ``user_activity``, kept from load to load: what each refresh adds and takes away.
USER_VALUES, UNFINISHED = "user_values", "refresh_not_finished"
DAY_MARTS = [name for name in MARTS if name != "user_activity"]


def _touched(store: Store, days: set) -> dict[str, DataFrame]:
    """Staged models, of the events those of ``days`` only."""
    raw = {table: store.read("raw", table) for table in RAW}
    return stage(raw | {EVENTS: raw[EVENTS].where(in_days(days))})


def build_values(store: Store) -> None:
    """Start the sums behind ``user_activity`` anew, from all events."""
    events = staged_models(store)["stg_stream_events"]
    store.replace("marts", USER_VALUES, marts.user_values(events))
    store.drop("marts", UNFINISHED)


def _begin(store: Store) -> None:
    """Mark that the marts and the sums may be out of step until the refresh is through."""
    store.replace("marts", UNFINISHED, store.spark.createDataFrame([(True,)], "begun boolean"))


def refresh(
    store: Store, batch: DataFrame, latest_by: str | None = None, day_in_key: bool = False
) -> set:
    """Merge a batch of events and bring the marts up to date at the cost of the days it touches,
    which are returned. The marts of days replace these days. For ``user_activity``, the days' old
    sums are taken off and their new ones added, as rows behind the stored sums, and the mart is made
    of the sums; no other day's events are read.

    Without stored sums (the first time, or after a refresh that was cut off) everything is built.
    Dimensions are taken as they are: after a change of titles, genres or subscriptions, ``build``
    brings the other days up to date.
    """
    store.create_raw_tables()
    merge = store.plan_merge(batch, latest_by, day_in_key)
    if not store.exists("marts", USER_VALUES) or store.exists("marts", UNFINISHED):
        _begin(store)
        store.apply_merge(merge)
        events = staged_models(store)["stg_stream_events"]
        store.replace("marts", USER_VALUES, marts.user_values(events))
        build(store, values=store.read("marts", USER_VALUES))
        store.drop("marts", UNFINISHED)
        return merge.touched
    if not merge.days:
        return set()
    spark, days = store.spark, merge.touched
    negated = [f"-{c} as {c}" for c in marts.VALUES]
    _begin(store)
    old = marts.user_values(_touched(store, days)["stg_stream_events"]).selectExpr(
        "user_id", "kind", "value", *negated)
    path = scratch_path(spark, "old-values")
    old.write.parquet(path)
    store.apply_merge(merge)
    staged = _touched(store, days)
    new = marts.user_values(staged["stg_stream_events"])
    changes = marts.summed_values(spark.read.schema(old.schema).parquet(path), new, keep_zero=True)

    def of_users() -> None:
        store.append("marts", USER_VALUES, changes)
        values = marts.summed_values(store.read("marts", USER_VALUES))
        store.replace("marts", "user_activity", marts.activity_of(
            values, staged["stg_tracks"], staged["stg_artists"], staged["stg_users"]))

    # Side by side, as in a build: each writes tables of its own.
    with ThreadPoolExecutor(len(MARTS)) as pool:
        writes = [pool.submit(of_users), *(
            pool.submit(store.replace_days, name, days, df)
            for name, df in build_marts(staged, DAY_MARTS).items())]
        for write in writes:
            write.result()
    store.drop("marts", UNFINISHED)
    publish(store, list(MARTS))
    return days


def stored_models(store: Store) -> dict[str, DataFrame]:
    """Every model the tests know: raw and staged tables, enriched events, and stored marts."""
    staged = staged_models(store)
    models = {f"raw.{table}": store.read("raw", table) for table in RAW}
    models |= staged | {"int_enriched_events": enriched(staged)}
    return models | {name: store.read("marts", name) for name in MARTS}


def test(store: Store) -> DataFrame:
    """All data tests, as (model, column, test, n_failed, passed)."""
    return all_tests(stored_models(store))


def check(store: Store) -> DataFrame:
    """The pattern checks, as (check, value, threshold, status). The checks on days read the built
    daily mart where there is one."""
    staged, mart = staged_models(store), "daily_listening_stats"
    daily = store.read("marts", mart) if store.exists("marts", mart) else None
    return pattern_summary(staged["stg_stream_events"], staged["stg_tracks"], daily)


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows per table, as (table, n_rows)."""
    counts = [
        df.selectExpr("count(*) as n_rows").selectExpr(f"'{name}' as table", "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def row_report(store: Store) -> DataFrame:
    """Row counts of the stored tables. Tables that do not exist have no row count."""
    names = [("raw", t) for t in RAW] + [("marts", t) for t in MARTS]
    found = {f"{layer}.{t}": store.read(layer, t) for layer, t in names if store.exists(layer, t)}
    missing = [(f"{layer}.{t}", None) for layer, t in names if f"{layer}.{t}" not in found]
    absent = store.spark.createDataFrame(missing, "table string, n_rows bigint")
    return absent.unionByName(count_rows(found)) if found else absent
