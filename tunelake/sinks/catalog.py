"""Stored tables and models in the session catalog, where SQL finds them by ``schema.name``.

Raw tables and marts are tables over the store's folders; staged models and enriched events are
lasting views on them, so nothing is stored twice. With a catalog that lasts (a metastore), every
later session sees them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from tunelake.plans.enrich import ENRICHED
from tunelake.plans.staging import MODELS
from tunelake.schemas import EVENTS, RAW
from tunelake.sinks.store import DAY, Store, schema_name


@dataclass(frozen=True)
class Selection:
    """What a staged model selects, as SQL text for a view: the part of a frame that models use."""

    source: str
    columns: list[str]

    def selectExpr(self, *expressions: str) -> str:  # noqa: N802, the frame's own name
        return f"SELECT {', '.join(expressions)} FROM {self.source}"


def _schema(store: Store, layer: str) -> str:
    """The layer's schema, made if missing; its folder is the store's."""
    name = schema_name(layer, store.env)
    store.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}` "
                    f"LOCATION '{store.root.rstrip('/')}/{name}'")
    return f"`{name}`"


def _table(store: Store, layer: str, table: str, columns: T.StructType, by: str = "") -> str:
    """A table over a folder of the store. Only its entry is made anew, no data."""
    name = f"{_schema(store, layer)}.{table}"
    store.spark.sql(f"DROP TABLE IF EXISTS {name}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    store.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet {by} "
                    f"LOCATION '{store.path(layer, table)}'")
    return name


def publish(store: Store, marts: list[str]) -> None:
    """Enter raw tables, staged models, enriched events and the marts that are stored."""
    spark = store.spark
    for table in RAW:
        by = f"PARTITIONED BY ({DAY})" if table == EVENTS else ""
        name = _table(store, "raw", table, store.read("raw", table).schema, by)
        if by:
            spark.catalog.recoverPartitions(name)
    staging, raw = _schema(store, "staging"), _schema(store, "raw")
    for table, model in MODELS.items():
        columns = store.read("raw", table).columns
        select = model(Selection(f"{raw}.{table}", columns))
        spark.sql(f"CREATE OR REPLACE VIEW {staging}.stg_{table} AS {select}")
    columns = ", ".join(f"{side}.{c}" for side, names in ENRICHED.items() for c in names)
    spark.sql(f"""
        CREATE OR REPLACE VIEW {_schema(store, 'intermediate')}.int_enriched_events AS
        SELECT {columns} FROM {staging}.stg_stream_events event
        LEFT JOIN {staging}.stg_tracks track ON event.track_id = track.track_id
        LEFT JOIN {staging}.stg_artists artist ON track.artist_id = artist.artist_id
        LEFT JOIN {staging}.stg_users user ON event.user_id = user.user_id""")
    for mart in marts:
        _table(store, "marts", mart, store.read("marts", mart).schema)
