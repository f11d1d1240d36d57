"""Key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_key(prefix: Column, index: Column) -> Column:
    """md5 of ``prefix-index`` laid out as 8-4-4-4-12 hex digits."""
    digest = F.md5(F.concat_ws("-", prefix.cast("string"), index.cast("string")))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def event_key(day: Column, index: Column) -> Column:
    """Surrogate key of the n-th event of a day."""
    return surrogate_key(F.concat(F.lit("event-"), F.date_format(day, "yyyy-MM-dd")), index)


def natural_event_key(day: Column, index: Column) -> Column:
    """Readable key of the n-th event of a day: ``ev-<date>-<n>``."""
    return F.concat_ws("-", F.lit("ev"), F.date_format(day, "yyyy-MM-dd"), index.cast("string"))
