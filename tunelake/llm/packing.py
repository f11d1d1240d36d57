"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest permitted length; nothing is dropped.
Pieces are dealt at random into parts of bounded size. Each part runs best-fit decreasing on its
own, with thousands of pieces, so that a part wastes almost nothing against one global packing:

* a piece goes to the open bin whose free space it leaves smallest;
* if none has room, the bin size that is cheapest per expected token is opened: the size's cost,
  divided by the piece plus what the pieces still to come can fill of the rest;
* at the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunelake.llm.common import stored, word_count

LENGTHS = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence besides its tokens, in tokens: it makes few large bins cheaper than many.
OVERHEAD = 32


def cheapest(size: int, lengths: Sequence[int], overhead: int, to_come: np.ndarray) -> int:
    """The length to open for a piece; ``to_come[n]`` is the sum of coming pieces up to length n."""
    def unit_cost(length: int) -> float:
        room = length - size
        filled = size + min(room, int(to_come[min(room, len(to_come) - 1)]))
        return (length + overhead) / max(1, filled)  # only empty pieces may be left

    return min((x for x in lengths if x >= size), key=lambda x: (unit_cost(x), x))


def pack(sizes: np.ndarray, lengths: Sequence[int], overhead: int) -> tuple[list[int], list[int],
                                                                          list[int]]:
    """Best-fit for pieces that come in descending size: the bin and offset of each, and the final
    length of each bin."""
    lengths = sorted(lengths)
    by_size = np.bincount(sizes, minlength=lengths[-1] + 1)
    free: list[tuple[int, int]] = []  # open bins as (room, bin), ascending
    used: list[int] = []
    bins, offsets = [], []
    opened: list[int] = []
    to_come, fresh = np.zeros(1), -1
    for n, size in enumerate(sizes.tolist()):
        by_size[size] -= 1
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, number = free.pop(at)
        else:
            if fresh < 0 or n - fresh >= 64:  # the sums change slowly
                to_come, fresh = np.cumsum(by_size * np.arange(len(by_size))), n
            room, number = cheapest(size, lengths, overhead, to_come), len(used)
            used.append(0)
            opened.append(room)
        bins.append(number)
        offsets.append(used[number])
        used[number] += size
        if room > size:
            insort(free, (room - size, number))
    final = [lengths[bisect_left(lengths, x)] for x in used]
    return bins, offsets, final


def documents(docs: DataFrame, size: Column, row_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, copies): rows that agree in id and size give the same pieces, so they are
    counted."""
    rows = docs.select(F.col(row_id).alias("doc_id"), size.alias("size"))
    return rows.groupBy("doc_id", "size").agg(F.count("*").alias("copies"))


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """``documents`` cut to at most ``longest`` tokens: doc_id, size, copies, piece, start, n_tokens.
    An empty document is one piece of no tokens."""
    return docs.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), _last_piece(longest)))
                       .alias("piece")).select(
        "doc_id", "size", "copies", "piece",
        (F.col("piece") * longest).alias("start"),
        F.least(F.col("size") - F.col("piece") * longest, F.lit(longest)).alias("n_tokens"),
    )


def _last_piece(longest: int) -> Column:
    return F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / longest)


def dealt(cut: DataFrame, parts: int, together: int) -> DataFrame:
    """``pieces`` dealt to parts by what they are, at most ``together`` copies of one at a time: doc_id,
    piece, start, n_tokens, ``__part`` and ``__n``, the number of copies dealt there at once."""
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"),
                                 F.floor((F.col("copies") - 1) / together)))
    rows = cut.select("*", chunk.alias("__chunk"))
    number = F.xxhash64("doc_id", "size", "piece", "__chunk")
    return rows.select(
        "doc_id", "piece", "start", "n_tokens",
        F.pmod(number, F.lit(parts)).cast("int").alias("__part"),
        F.least(F.col("copies") - F.col("__chunk") * together, F.lit(together)).alias("__n"),
    )


def packed(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    size: str | None = None,
    lengths: Sequence[int] = LENGTHS,
    overhead: int = OVERHEAD,
    part_rows: int = 5_000,
) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start and n_tokens (in the document), bin_id,
    bin_offset (where the piece begins in its bin), bin_length (one of ``lengths``) and bin_used.

    ``size`` names a column of token counts; without it, tokens are the words of ``text``. Null and
    empty texts are pieces of no tokens and occupy a bin without using it up. Ties in size go by
    doc_id and piece. A part has about ``part_rows`` pieces. Repeated rows are packed once each. What
    goes where depends on ids and sizes alone, not on the split of the scan. Ids may be of any type
    that can be grouped by and are returned as they are. An empty table gives an empty result; other
    columns are not looked at.
    """
    tokens = F.coalesce(F.col(size).cast("bigint"), F.lit(0)) if size else word_count(text)
    longest = max(lengths)
    # Counting tokens reads all text; what it gives is narrow and used twice.
    counted = stored(documents(docs, tokens, row_id), "sizes")
    total = counted.agg(F.sum(F.col("copies") * (_last_piece(longest) + 1))).first()[0] or 0
    parts = max(1, -(-total // part_rows))
    rows = dealt(pieces(counted, longest), parts, max(1, part_rows // 10))
    id_type = counted.schema["doc_id"].dataType
    columns = ["doc_id", "piece", "start", "n_tokens"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition holds whole parts, one after the other, each in descending size.
        held: list[pa.RecordBatch] = []
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                yield from placed(table, current)

        for batch in batches:
            part = batch.column("__part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if part[a] != current:
                    yield from done()
                    held, current = [], int(part[a])
                held.append(batch.slice(a, b - a))
        yield from done()

    def placed(table: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
        sizes = table.column("n_tokens").to_numpy().astype(np.int64)
        bins, offsets, final = pack(sizes, lengths, overhead)
        bins = np.array(bins)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        out = table.select(columns)
        out = out.append_column("bin_id", pa.array([f"{part}-{b}" for b in bins]))
        out = out.append_column("bin_offset", pa.array(offsets, pa.int64()))
        out = out.append_column("bin_length", pa.array(np.array(final)[bins], pa.int64()))
        out = out.append_column("bin_used", pa.array(used[bins], pa.int64()))
        yield from out.combine_chunks().to_batches()

    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(
        "piece long, start long, n_tokens long, bin_id string, bin_offset long, bin_length long, "
        "bin_used long")])
    return (
        rows.repartition("__part")
        .select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))).alias("__copy"))
        .sortWithinPartitions("__part", F.desc("n_tokens"), "doc_id", "piece")
        .select("doc_id", "piece", "start", F.col("n_tokens").cast("long"), "__part")
        .mapInArrow(solve, schema)
    )
