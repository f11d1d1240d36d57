"""Small helpers that several operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.session import scratch_path

#: A word where only sizes count: a run of anything but ASCII white space.
SIZE_WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the map of wanted rows (see ``among``); with very many rows it lets more through.
MAP_BITS = 1 << 25
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` written once to the shared folder, in a folder for each value of ``by``, and read back:
    its lineage ends there, so a lost executor costs a reread and not the work before."""
    path = scratch_path(df.sparkSession, label)
    # Unlike the default codec, zstd leaves no buffers outside the heap behind, file by file.
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def spent(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once all that is made of them is written itself, and let
    Spark find out that nothing refers to the shuffles of the jobs before: their files go too."""
    spark = tables[0].sparkSession
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, row: str = "__row") -> DataFrame:
    """``docs`` with a number of each row, stored with it: a second scan of a table may be split
    otherwise (executors come and go) and would be numbered otherwise."""
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def without_rows(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """``docs``, which ``numbered`` gave, without the rows whose number is in ``dropped`` (column
    ``__row``) and without its column ``row``."""
    return docs.join(dropped.select(F.col("__row").alias(row)), row, "left_anti").drop(row)


def _bit(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(MAP_BITS)) + 1


def among(texts: DataFrame, rows: DataFrame, key: str = "__row") -> DataFrame:
    """``texts`` with ``__maybe``: false only if its ``key`` isn't among those of ``rows``. The map
    that is sent to all tasks has MAP_BITS bits, whatever the size of the tables."""
    bits = rows.select(_bit(key).alias("b")).groupBy(
        F.expr("bitmap_bucket_number(b)").alias("__bucket")
    ).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", F.expr("int(__at div 8) + 1"), F.lit(1))), 16, 10)
    return texts.withColumn("__b", _bit(key)).withColumns({
        "__bucket": F.expr("bitmap_bucket_number(__b)"),
        "__at": F.expr("bitmap_bit_position(__b)"),
    }).join(F.broadcast(bits), "__bucket", "left").withColumn("__byte", byte.cast("int")).withColumn(
        "__maybe", F.coalesce(F.expr("__byte & shiftleft(1, int(__at % 8)) <> 0"), F.lit(False))
    ).drop("__b", "__bucket", "__at", "__map", "__byte")


def narrowed(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose ``key`` may be among those of ``rows``: all that are, and a few
    others. An exact join with ``rows`` then moves about as many rows as it returns."""
    return among(table, rows, key).where("__maybe").drop("__maybe")


def filled(name: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(name: str) -> Column:
    return F.regexp_count(filled(name), F.lit(SIZE_WORD)).cast("bigint")


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows go to Python at once: with long texts, Spark's default of 10,000 rows
    may fill a task's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that long texts don't add up."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
