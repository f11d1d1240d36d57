"""Exact top-k inner-product search by histogram selection.

Queries are taken in blocks of bounded size; each block is sent to all tasks and scored against all
vectors, several times, without moving a vector:

1. every task counts its scores in a coarse histogram per query; the sums of the histograms show
   in which bin a query's k-th best score lies;
2. that bin is divided again, and so on, until a bin is one integer: the k-th value itself, and the
   number of scores above it;
3. every task returns what is above the k-th value, and of those equal to it the ones that come
   first in the order of ties, as many as are missing.

A task only reports bins from its own k-th best score up, since no other bin can hold the k-th best
of all; so what a task sends is bounded by k per query, however the scores are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelake.llm.common import stored
from tunelake.session import scratch_path

BINS = 1024
#: Vectors and queries scored at a time in a task.
ROWS, QUERIES = 1024, 1024
#: Stands for the vec_id null in a task: after all others.
NO_ID = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """``__row``, ``__id``, ``__v``: floor(scale * x) of every usable vector."""
    usable = F.col(embedding).isNotNull() & F.forall(
        embedding,
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)),
    )
    return vectors.select(
        F.monotonically_increasing_id().alias("__row"), F.col(vec_id).alias("__id"),
        F.col(embedding).alias("__e"), usable.alias("__ok"),
    ).where("__ok").select(
        "__row", "__id",
        F.transform("__e", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("__v"),
    )


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    """Vectors as rows; missing components at the end are zero."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy().astype(kind)
    out = np.zeros((len(column), dims), kind)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _scores(batches: Iterator[pa.RecordBatch], queries: np.ndarray, query_rows: np.ndarray
            ) -> Iterator[tuple]:
    """(first query, ids, rows, scores, is own row) for a block of queries and a block of vectors.
    Scores are whole numbers and exact."""
    dims, kind = queries.shape[1], queries.dtype
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = part.column("__row").to_numpy()
            ids = part.column("__id").fill_null(NO_ID).to_numpy()
            held = _matrix(part.column("__v"), dims, kind).T
            for first in range(0, len(queries), QUERIES):
                block = slice(first, first + QUERIES)
                scores = (queries[block] @ held).astype(np.int64)
                yield first, ids, rows, scores, query_rows[block, None] == rows


def _histograms(shared, low: np.ndarray, width: int, part: int, k: int):
    """Counts of scores in [low, low + width) per query, in parts of ``part``, from the bin of the
    task's own k-th best score up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_rows = shared.value
        found = np.zeros((len(queries), BINS), np.int64)
        above = np.zeros(len(queries), np.int64)
        for first, _, _, scores, own in _scores(batches, queries, query_rows):
            n = len(scores)
            at = scores - low[first:first + n, None]
            above[first:first + n] += ((at >= width) & ~own).sum(1)
            inside = (at >= 0) & (at < width) & ~own
            flat = (at // part + np.arange(n)[:, None] * BINS)[inside]
            found[first:first + n] += np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
        from_top = np.cumsum(found[:, ::-1], axis=1)[:, ::-1] + above[:, None]
        higher = np.pad(from_top[:, 1:], ((0, 0), (0, 1)))
        higher[:, -1] = above
        query, at = np.nonzero((found > 0) & (higher < k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(at), pa.array(found[query, at])], ["q", "bin", "n"])

    return count


def _winners(shared, kth: np.ndarray, ties: np.ndarray):
    """What beats the k-th value, and of its equals the first ``ties`` in the task."""
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_rows = shared.value
        equal: dict[int, list] = {}

        def rows(q, ids, at, scores):
            return pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(at, pa.int64()),
                 pa.array(scores, pa.int64())], ["q", "vec_id", "row", "score"])

        for first, ids, at, scores, own in _scores(batches, queries, query_rows):
            limit = kth[first:first + len(scores), None]
            q, j = np.nonzero((scores > limit) & ~own)
            if len(q):
                yield rows(q + first, ids[j], at[j], scores[q, j])
            q, j = np.nonzero((scores == limit) & ~own)
            for one in np.unique(q).tolist():
                here = j[q == one]
                best = equal.setdefault(one + first, [])
                best += zip(ids[here].tolist(), at[here].tolist())
                best.sort()
                del best[ties[one + first]:]
        q = [q for q, best in equal.items() for _ in best]
        flat = [x for best in equal.values() for x in best]
        yield rows(q, [x[0] for x in flat], [x[1] for x in flat], [int(kth[i]) for i in q])

    return select


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: float = 64.0,
    query_block: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with ``is_query``, the k other rows with
    the highest inner product of floor(scale * x); ties go to the smaller vec_id, then to the
    earlier row. With fewer than k other rows, all of them.

    Vectors that are null, or hold a null or non-finite component, take no part, as query or
    candidate; a shorter vector counts as filled up with zeros, an empty one scores 0. A null
    vec_id comes after all others in ties. Repeated rows are rows of their own: only the query's
    own row is left out. An empty table gives an empty result; other columns are not looked at.
    Scores have to stay below 2**53.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    # Every pass reads this table: quantised once, queries marked.
    marked = vectors.withColumn("__query", F.coalesce(is_query, F.lit(False)))
    flags = marked.select(F.monotonically_increasing_id().alias("__row"), "__query")
    usable = quantised(vectors, vec_id, embedding, scale)
    table = stored(
        usable.join(flags.where("__query"), "__row", "left").select(
            "__row", F.col("__id").cast("long").alias("__id"), "__v",
            F.coalesce("__query", F.lit(False)).alias("__query"),
            F.aggregate("__v", F.lit(0.0), lambda s, x: s + x.cast("double") * x).alias("__norm"),
        ), "vectors")
    facts = table.agg(
        F.max("__norm").alias("norm"), F.max(F.size("__v")).alias("dims"),
        F.count_if("__query").alias("queries"), F.count("*").alias("rows"),
    ).first()
    if not facts.queries:
        return spark.createDataFrame([], schema)
    bound = int(facts.norm) + 1  # no score is larger: its square is at most the norms' product
    if bound >= 2**53:
        raise ValueError("scores of 2**53 or more are not exact")
    kind = np.float32 if bound < 2**24 else np.float64
    dims, n_blocks = max(1, facts.dims), -(-facts.queries // query_block)
    candidates = table.select("__row", "__id", "__v")
    path = scratch_path(spark, "winners")
    for block in range(n_blocks):
        # About query_block rows, whatever the size of the table.
        asked = table.where(F.col("__query") & (F.pmod(F.xxhash64("__row"), F.lit(n_blocks))
                                                == block)).select("__row", "__id", "__v").toArrow()
        if not asked.num_rows:
            continue
        shared = spark.sparkContext.broadcast((
            _matrix(asked.column("__v").combine_chunks(), dims, kind),
            asked.column("__row").to_numpy(),
        ))
        n = asked.num_rows
        low, width = np.full(n, -bound, np.int64), 2 * bound + 1
        above = np.zeros(n, np.int64)
        while width > 1:
            part = -(-width // BINS)
            counted = candidates.mapInArrow(
                _histograms(shared, low, width, part, k), "q long, bin long, n long"
            ).groupBy("q", "bin").agg(F.sum("n").alias("n"))
            down = Window.partitionBy("q").orderBy(F.desc("bin"))
            need = spark.createDataFrame(
                [(i, int(k - a)) for i, a in enumerate(above)], "q long, need long")
            # One line per query of the block: the highest bin with which k are reached, or else
            # the lowest that there is.
            chosen = counted.join(F.broadcast(need), "q").withColumn(
                "upto", F.sum("n").over(down)
            ).groupBy("q").agg(
                F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", "upto", "n")))
                .alias("reached"),
                F.min(F.struct("bin", "upto", "n")).alias("last"),
            ).select("q", F.coalesce("reached", "last").alias("at")).select(
                "q", "at.bin", "at.upto", "at.n").collect()
            for r in chosen:
                low[r.q] += r.bin * part
                above[r.q] += r.upto - r.n
            width = part
        # Where there are fewer than k, the k-th value is the lowest that occurs.
        candidates.mapInArrow(
            _winners(shared, low, np.maximum(0, k - above)),
            "q long, vec_id long, row long, score long",
        ).join(
            F.broadcast(spark.createDataFrame(
                list(enumerate(asked.column("__id").to_pylist())), "q long, query_id long")), "q"
        ).withColumn(
            "rank", F.row_number().over(
                Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row"))
        ).where(F.col("rank") <= k).select(
            "query_id", "rank",
            F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score",
        ).write.parquet(f"{path}/block={block}")
        shared.destroy()
    return spark.read.schema(schema).parquet(f"{path}/*")
