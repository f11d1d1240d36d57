"""Stored tables and the four ways to load them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunelake.operators.quality import Watched, value_conditions
from tunelake.operators.upserts import (
    new_rows, one_per_key, refuse_null_keys, replace_rows, stored_matches,
)
from tunelake.schemas import EVENTS, PRIMARY_KEY, RAW
from tunelake.session import checkpoint_root, scratch_path
from tunelake.sinks.key_index import KeyIndex

DAY = "event_date"


def schema_name(layer: str | None, env: str, default: str = "main") -> str:
    """The schema of a layer: as named in ``prod``, with ``dev_`` before it elsewhere, and the
    default schema if no layer is given."""
    if layer is None:
        return default
    return layer.strip() if env == "prod" else f"dev_{layer.strip()}"


@dataclass(frozen=True)
class Merge:
    """A batch of events as files, the days it has, and other days that hold older copies."""

    batch: DataFrame
    days: set
    moved: set
    latest_by: str | None

    @property
    def touched(self) -> set:
        return self.days | self.moved


@dataclass(frozen=True)
class Store:
    """Parquet tables below a root folder that all executors can reach. The event table is
    partitioned by day; the others are not partitioned."""

    spark: SparkSession
    root: str
    env: str = "dev"

    def path(self, layer: str, table: str) -> str:
        return f"{self.root.rstrip('/')}/{schema_name(layer, self.env)}/{table}"

    def read(self, layer: str, table: str) -> DataFrame:
        reader = self.spark.read
        if layer == "raw":
            reader = reader.schema(_stored_schema(table))
        return reader.parquet(self.path(layer, table))

    def exists(self, layer: str, table: str) -> bool:
        try:
            self.spark.read.schema("x int").parquet(self.path(layer, table))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
        return True

    def keep_extra(self, table: str, extra: DataFrame) -> None:
        """Keep landed fields that the raw table's schema lacks (``date``, ``key``, ``field``,
        ``value``) beside it: those of a dimension replace earlier ones, those of events the earlier
        ones of the same landed days."""
        writer = extra.write.mode("overwrite")
        if table == EVENTS:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy("date")
        writer.parquet(self.path("raw", f"{table}_extra"))

    def read_extra(self, table: str) -> DataFrame:
        return self.spark.read.schema("date string, key string, field string, value variant").parquet(
            self.path("raw", f"{table}_extra"))

    def create_raw_tables(self, tables: Iterable[str] = tuple(RAW)) -> None:
        """Create those raw tables that do not exist yet, empty."""
        for table in tables:
            if not self.exists("raw", table):
                empty = self.spark.createDataFrame([], _stored_schema(table))
                self._write("raw", table, empty, "overwrite")

    def replace(self, layer: str, table: str, df: DataFrame) -> None:
        """The table becomes the frame; of events, stored days that the frame lacks go."""
        if layer == "raw":
            refuse_null_keys(df, PRIMARY_KEY[table])
        indexed = layer == "raw" and table == EVENTS and self.keys.ready()
        if indexed:
            self.keys.distrust()
        self._write(layer, table, df, "overwrite")
        if indexed:
            self.index_keys()

    @property
    def keys(self) -> KeyIndex:
        """The days of the events' keys, once ``index_keys`` has built it."""
        path = self.path("raw", f"{EVENTS}_keys")
        return KeyIndex(self.spark, path, f"{path}_complete", PRIMARY_KEY[EVENTS], DAY)

    def index_keys(self) -> None:
        """Index the stored events by key, or do so anew. From then on, merges look up which days hold
        older copies, and every load keeps the index up to date."""
        self.keys.build(self.read("raw", EVENTS).select(PRIMARY_KEY[EVENTS], DAY))

    def insert_or_replace(self, table: str, batch: DataFrame, latest_by: str | None = None) -> None:
        """Rows of the batch replace stored rows with the same key; others are added."""
        if table == EVENTS:
            return self.merge_events(batch, latest_by)
        refuse_null_keys(batch, PRIMARY_KEY[table])
        merged = replace_rows(self.read("raw", table), batch, PRIMARY_KEY[table], latest_by)
        # The table is read and rewritten: the result is put in the shared folder in between.
        checkpoint_root(self.spark)
        self._write("raw", table, merged.checkpoint(), "overwrite")

    def merge_events(
        self, batch: DataFrame, latest_by: str | None = None, day_in_key: bool = False
    ) -> None:
        """Upsert events by key; running it again changes nothing. Only the days concerned are
        rewritten: those of the batch, and those that hold older copies of its keys. With
        ``day_in_key`` a key never changes its day, and the search for older copies elsewhere is
        left out. Otherwise it is a scan of the other days' stored keys, or, with ``index_keys``, of
        the index and the few days that it names. The batch itself is evaluated once.

        A run that is cut off may leave some days rewritten and others not, or a moved event in two
        days: the days are replaced one by one. Running the merge again mends that, as it finds
        the older copies by key; with ``day_in_key`` no event is ever in two days."""
        self.apply_merge(self.plan_merge(batch, latest_by, day_in_key))

    def plan_merge(
        self, batch: DataFrame, latest_by: str | None = None, day_in_key: bool = False
    ) -> Merge:
        """A merge worked out, with nothing written to the table yet."""
        key = PRIMARY_KEY[EVENTS]
        batch = self._materialised(_with_day(batch), key)
        days, moved = _days(batch), set()
        if days and not day_in_key:
            stored, elsewhere = self.read("raw", EVENTS).select(key, DAY), not_in_days(days)
            if self.keys.ready():
                elsewhere = in_days(self.keys.days_of(batch, elsewhere))
            moved = _days(stored_matches(stored.where(elsewhere), batch, key))
        return Merge(batch, days, moved, latest_by)

    def apply_merge(self, merge: Merge) -> None:
        key, moved = PRIMARY_KEY[EVENTS], merge.moved
        if not merge.days:
            return
        stored = self.read("raw", EVENTS)
        keys = merge.batch.select(key).distinct()
        new = one_per_key(merge.batch, key, merge.latest_by).select(*stored.columns)
        kept = stored.where(in_days(merge.touched)).join(keys, key, "left_anti")
        if self.keys.ready():
            self.keys.add(merge.batch, in_days(merge.days))
        self._write("raw", EVENTS, kept.select(*stored.columns).unionByName(new), "overwrite",
                    whole=False)
        self._drop_stale_days(moved, keys)

    def insert_or_ignore(
        self, table: str, batch: DataFrame, first_by: str | None = None, day_in_key: bool = False
    ) -> None:
        """Add the rows of the batch whose key is not stored yet; stored rows win."""
        key = PRIMARY_KEY[table]
        stored = self.read("raw", table)
        batch = self._materialised(_with_day(batch) if table == EVENTS else batch, key)
        if table == EVENTS:
            indexed = self.keys.ready()
            days = _days(batch) if day_in_key or indexed else set()
            if day_in_key:
                stored = stored.where(in_days(days))
            elif indexed:
                stored = stored.where(in_days(self.keys.days_of(batch, F.lit(True))))
            if indexed:
                self.keys.add(batch, in_days(days))
        self._write("raw", table, new_rows(stored, batch, key, first_by), "append")

    def append(self, layer: str, table: str, df: DataFrame) -> None:
        """Add rows as they are; the index of the events' keys, if any, has to be built anew."""
        if layer == "raw" and table == EVENTS:
            self.keys.distrust()
        self._write(layer, table, df, "append")

    def drop(self, layer: str, table: str) -> None:
        """Delete the table's folder, if there is one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(layer, table))
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def replace_days(self, table: str, days: set, fresh: DataFrame) -> None:
        """The mart's rows of ``days`` become ``fresh``. A mart of days is a few hundred rows a day; it
        is read and rewritten, with the result in the shared folder in between."""
        kept = self.read("marts", table).where(not_in_days(days))
        checkpoint_root(self.spark)
        self.replace("marts", table, kept.unionByName(fresh).checkpoint())

    def _drop_stale_days(self, moved: set, keys: DataFrame) -> None:
        """Delete the days of which nothing is left because all their events moved to another day:
        an overwrite by partition leaves a day alone for which it has no rows."""
        if not moved:
            return
        still_there = self.read("raw", EVENTS).where(in_days(moved))
        emptied = moved - _days(still_there.join(keys, PRIMARY_KEY[EVENTS], "left_anti"))
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for day in emptied:
            value = "__HIVE_DEFAULT_PARTITION__" if day is None else day.isoformat()
            folder = hadoop.Path(f"{self.path('raw', EVENTS)}/{DAY}={value}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _materialised(self, batch: DataFrame, key: str) -> DataFrame:
        """A batch as files in the shared folder, so that it isn't made again for each use. The same
        pass sees to it that every row has a key."""
        path = scratch_path(self.spark, "batch")
        watched = Watched(batch, value_conditions([key], {}))
        watched.df.write.parquet(path)
        if watched.failing():
            refuse_null_keys(self.spark.read.schema(batch.schema).parquet(path), key)
        return self.spark.read.schema(batch.schema).parquet(path)

    def _write(
        self, layer: str, table: str, df: DataFrame, mode: str, whole: bool = True
    ) -> None:
        """``whole``: an overwrite replaces the table, and not just the days that ``df`` has."""
        if layer == "raw" and table == EVENTS:
            # Few files per day, and a day with very many rows is split over several tasks.
            days = _with_day(df).hint("rebalance", DAY)
            days.write.mode(mode).partitionBy(DAY).option(
                "partitionOverwriteMode", "static" if whole else "dynamic"
            ).parquet(self.path(layer, table))
        else:
            df.write.mode(mode).parquet(self.path(layer, table))


def _stored_schema(table: str) -> T.StructType:
    fields = list(RAW[table].fields)
    return T.StructType([*fields, T.StructField(DAY, T.DateType())] if table == EVENTS else fields)


def _with_day(events: DataFrame) -> DataFrame:
    if DAY in events.columns:
        return events
    return events.withColumn(DAY, F.expr("cast(cast(started_at as timestamp_ntz) as date)"))


def _days(df: DataFrame) -> set:
    """The days present: one value per day reaches the driver."""
    return {row[0] for row in df.select(DAY).distinct().collect()}


def in_days(days: set) -> Column:
    """A condition on the partition column, which prunes to these days."""
    listed = F.col(DAY).isin([d for d in days if d is not None])
    return listed | F.col(DAY).isNull() if None in days else listed


def not_in_days(days: set) -> Column:
    """The opposite, also true of rows without a day if these are not among ``days``."""
    return ~F.coalesce(in_days(days), F.lit(False))
