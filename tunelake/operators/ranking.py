"""Top rows per group, and the place of every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunelake.session import scratch_path


def top_per_group(
    df: DataFrame, group: str, by: str, tiebreak: str, k: int, rank: str = "daily_rank"
) -> DataFrame:
    """The ``k`` rows with the highest ``by`` in each group, numbered from 1. Ties go to the lower
    ``tiebreak`` (NULL last), so the cut is the same on every run. Spark cuts each task's rows to
    ``k`` per group before the shuffle."""
    order = f"partition by {group} order by {by} desc, {tiebreak} asc nulls last"
    top = df.selectExpr("*", f"row_number() over ({order}) as {rank}").where(f"{rank} <= {k}")
    return top.withColumn(rank, F.col(rank).cast("bigint"))


def global_rank(df: DataFrame, by: str, tiebreak: str, rank: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 1, when all are in order: highest ``by`` first, ties by
    the lower ``tiebreak``, NULL last in both. A window over everything would be one task; here rows
    go to tasks by range, each task numbers its own, and the sizes of the ranges, one line per
    task, say how many rows come before. The ranges are written to the shared folder, as only one
    run of them has these numbers."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "ranked")
    order = [F.desc_nulls_last(by), F.asc_nulls_last(tiebreak)]
    # The number of a row is that of its task, times 2**33, plus its place there.
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "__at", F.monotonically_increasing_id())
    ordered.write.parquet(path)
    ordered = spark.read.schema(ordered.schema).parquet(path)
    task = F.shiftright("__at", 33)
    sizes = ordered.groupBy(task.alias("__task")).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(
        Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__task", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1
    return ordered.withColumn("__task", task).join(F.broadcast(offsets), "__task").select(
        *df.columns, place.cast("bigint").alias(rank))
