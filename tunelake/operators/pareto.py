"""Concentration: the share of rows that belongs to the most active keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pareto_share(
    df: DataFrame, key: str, fraction: str = "0.2", weight: str | None = None
) -> DataFrame:
    """Percentage of rows held by the top ``fraction`` of the keys, as a one-row frame (``top_pct``,
    ``n_keys``, ``n_rows``). Only keys that occur count; a NULL key is a key of its own. ``weight``
    names the column that holds the number of rows, if ``df`` is already counted.

    Ranking every key would sort all of them in one task. The sum over the top k keys needs only
    how many keys have each row count: every level above the cut counts in full, and the level at
    the cut in part, whichever of its equal keys are taken. There are at most sqrt(2 * rows)
    different row counts (a million and a half for 10^12 rows), so the running total over the
    levels stays small at any size.
    """
    rows = F.count("*") if weight is None else F.sum(weight)
    per_key = df.groupBy(key).agg(rows.alias("rows"))
    levels = per_key.groupBy("rows").agg(F.count("*").alias("keys"))
    total = levels.agg(F.sum("keys").alias("n"), F.sum(F.col("rows") * F.col("keys")).alias("m"))
    quota = F.floor(total.select("n").scalar() * F.lit(Decimal(fraction))).cast("long")

    above = F.sum("keys").over(
        Window.orderBy(F.desc("rows")).rowsBetween(Window.unboundedPreceding, -1)
    )
    room = F.greatest(quota - F.coalesce(above, F.lit(0)), F.lit(0))
    taken = F.least(F.col("keys"), room)
    top = levels.withColumn("taken", taken).agg(
        # NULL, not 0, when the quota is below one key: nothing was summed.
        F.sum(F.when(F.col("taken") > 0, F.col("rows") * F.col("taken"))).alias("top_rows"),
        F.sum("keys").alias("n_keys"),
        F.sum(F.col("rows") * F.col("keys")).alias("n_rows"),
    )
    return top.select(
        (F.col("top_rows") * F.lit(100.0) / F.col("n_rows")).alias("top_pct"),
        "n_keys",
        "n_rows",
    )
