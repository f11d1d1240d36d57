"""Exact duplicates by a tree of merged digest runs.

Every input partition reduces its rows to a sorted run of (digest, survivor, count). Runs of the
same digest range meet in rounds: in each, ``fan_in`` neighbouring runs (numbers that differ only
in their last bits, as in a binomial tree) are brought together, sorted, and merged into one run,
which keeps one verified survivor per digest. The range ("shard") of a digest never changes, so the
last round leaves one run per range instead of one run for everything, and no task holds more
than a range. A text that a third of all rows share is one entry of each run from the first round.

Only digests travel. Two rows are the same only if SHA-256, byte length and a second, independent
hash agree; all three are compared at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import filled, fresh, numbered, stored, without_rows

DIGEST = ("__sha", "__bytes", "__check")


def _digested(docs: DataFrame, text: str, row_id: str, place: str | None) -> DataFrame:
    return docs.select(
        F.col(row_id).alias("__id"),
        (F.col(place) if place else F.monotonically_increasing_id()).alias("__row"),
        F.spark_partition_id().alias("__run"),
        F.unhex(F.sha2(filled(text), 256)).alias("__sha"),
        F.octet_length(filled(text)).alias("__bytes"),
        F.xxhash64(filled(text)).alias("__check"),
    )


def _merge(runs: DataFrame, keep_largest: bool) -> DataFrame:
    """One round: rows of equal digest within a (shard, run) become one."""
    best = F.max if keep_largest else F.min
    return (
        runs.repartition("__shard", "__run")
        .sortWithinPartitions("__shard", "__run", *DIGEST)
        .groupBy("__shard", "__run", *DIGEST)
        .agg(best("__best").alias("__best"), F.sum("__n").alias("__n"))
    )


def duplicate_groups(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    keep: str = "smallest",
    fan_in: int = 8,
    shards: int = 1024,
    place: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``__id``, ``__row`` (its place in the scan, or column ``place``),
    ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``keep`` is "smallest" or "largest" ``row_id``. Null text counts as empty, and empty texts are
    a group like any other. A null id is never preferred to another id. Rows that agree in text and
    id are told apart by their place in the scan: exactly one row of a group is ``kept``. An empty
    table gives an empty result. Other columns are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is 'smallest' or 'largest', not {keep!r}")
    largest = keep == "largest"
    # The digests are read three times (rounds, rows) and cost a pass over all text: store them.
    rows = stored(_digested(docs, text, row_id, place), "digests")
    n_runs = (rows.agg(F.max("__run")).first()[0] or 0) + 1
    null_last = F.col("__id").isNotNull() if largest else F.col("__id").isNull()
    runs = rows.select(
        F.pmod(F.conv(F.hex(F.substring("__sha", 1, 4)), 16, 10).cast("bigint"), F.lit(shards))
        .cast("int").alias("__shard"),
        "__run", *DIGEST,
        F.struct(null_last.alias("null_last"), F.col("__id").alias("id"),
                 F.col("__row").alias("row")).alias("__best"),
        F.lit(1).cast("bigint").alias("__n"),
    )
    # Each partition's own run first: copies in it are one row before anything is exchanged.
    runs = runs.groupBy("__shard", "__run", *DIGEST).agg(
        (F.max if largest else F.min)("__best").alias("__best"), F.sum("__n").alias("__n"))
    while True:
        runs = _merge(runs.withColumn("__run", F.floor(F.col("__run") / fan_in).cast("int")),
                      largest)
        n_runs = -(-n_runs // fan_in)
        if n_runs <= 1:
            break
    merged = runs.select(*DIGEST, "__best", "__n")
    return rows.drop("__run").join(merged, list(DIGEST)).select(
        "__id", "__row",
        F.col("__best.id").alias("keep_id"),
        F.col("__n").alias("group_size"),
        (F.col("__row") == F.col("__best.row")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def without_duplicates(
    docs: DataFrame, text: str = "text", row_id: str = "doc_id", keep: str = "smallest"
) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    row = fresh(docs, "__row")
    docs = numbered(docs, row)
    dropped = duplicate_groups(docs, text, row_id, keep, place=row).where("not kept")
    return without_rows(docs, dropped, row)
