"""Key-based combination of a stored table with a batch of new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def refuse_null_keys(batch: DataFrame, key: str) -> None:
    """A key that is NULL identifies nothing: a batch that has one is an error. Reads the key column
    only."""
    missing = batch.where(F.col(key).isNull()).count()
    if missing:
        raise ValueError(f"{missing} rows of the batch have no {key}")


def one_per_key(df: DataFrame, key: str, latest_by: str | None = None, keep: str = "last") -> DataFrame:
    """One row per key: the last (or first) by ``latest_by``. Rows that tie, or all rows if there
    is no such column, are ordered by their content, so a rerun picks the same one. Copies of one
    key are cut to a single row in each task before the shuffle."""
    content = F.xxhash64(*df.columns)
    order = [content] if latest_by is None else [F.col(latest_by), content]
    if keep == "last":
        order = [c.desc() for c in order]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def stored_matches(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The stored rows whose key is in the batch. The batch's keys are the build side, so a small
    batch is broadcast and a large stored table stays where it is."""
    return stored.join(batch.select(key).distinct(), key, "left_semi")


def replace_rows(stored: DataFrame, batch: DataFrame, key: str, latest_by: str | None = None) -> DataFrame:
    """Stored rows with the batch's rows in place of those with the same key, and new ones added."""
    new = one_per_key(batch, key, latest_by)
    return stored.join(new.select(key), key, "left_anti").unionByName(new.select(*stored.columns))


def new_rows(stored: DataFrame, batch: DataFrame, key: str, first_by: str | None = None) -> DataFrame:
    """The batch's rows whose key is not stored yet, one per key."""
    new = one_per_key(batch, key, first_by, keep="first")
    taken = stored_matches(stored.select(key), batch, key)
    return new.join(taken, key, "left_anti").select(*stored.columns)
