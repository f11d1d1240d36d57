"""Mixing sources to target weights.

The words of a source, documents in a random but fixed order, form one stream, which is cut into
blocks of fixed length. The mix is a sequence of slots, one block each, dealt to output shards. How
many slots of each source a shard gets is a multinomial draw, conditioned on the sources' totals:
the slots are split between the left and the right half of the shards, and so on down to single
shards, every split drawn with a seed of its own (a multivariate hypergeometric draw, which is what
a multinomial becomes once its totals are given). So a shard finds its counts, and the ordinals of
its slots, by walking from the root to its leaf: nothing is exchanged, and a repeated task draws
the same.

The n-th slot of a source takes the block that a keyed permutation of the block numbers gives for
n. Each pass over a source (epoch) has its own permutation and uses each block once, so
no word is used more often than the number of passes begun. The last slot of a source is cut so
that its words come out at the target. Slots and blocks meet in a join on (source, block).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunelake.llm.common import SIZE_WORD, filled, fresh, numbered, small_batches, stored, word_count

WEIGHTS = (3.0, 1.0, 2.0)
#: numpy draws a split up to this many slots; above, ``hypergeometric`` does.
NUMPY_SLOTS = 500_000_000


# --- pseudorandom permutations of 0..n-1 ----------------------------------------------------------


def _round(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _feistel(x: np.ndarray, half: int, keys: Sequence[int], back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_round(left, key) & mask), left
        else:
            left, right = right, left ^ (_round(right, key) & mask)
    return (left << np.uint64(half)) | right


def permuted(index: np.ndarray, n: int, key: Sequence[int], back: bool = False) -> np.ndarray:
    """Where a permutation of 0..n-1 chosen by ``key`` sends each index (or, ``back``, whence it
    comes): a Feistel network over the next even power of two, walked until it falls below n."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    keys = np.random.default_rng(list(key)).integers(0, 2**63, 4).tolist()
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _feistel(out[todo], half, keys, back)
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


# --- targets and slots ----------------------------------------------------------------------------


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float
            ) -> list[float]:
    """``share`` of all sizes by weight (repeating); none above ``cap`` times its size, and what is
    cut off goes to the others by weight until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        whole = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / whole > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / whole
            break
        for i in over:
            out[i] = cap * sizes[i]
            open_.remove(i)
        left -= sum(out[i] for i in over)
    return out


@dataclass(frozen=True)
class Source:
    number: int
    words: int
    target: float
    blocks: int
    slots: int
    last_take: int  # words that the last slot takes of its block


def planned(number: int, words: int, target: float, block: int, seed: int) -> Source:
    """The slots whose words add up to the target, rounded."""
    blocks, want = -(-words // block), round(target)
    if not words or not want:
        return Source(number, words, target, blocks, 0, 0)
    epochs, rest = divmod(want, words)
    if not rest:
        last = permuted(np.array([blocks - 1]), blocks, (seed, number, epochs - 1))[0]
        return Source(number, words, target, blocks, epochs * blocks,
                      words - last * block if last == blocks - 1 else block)
    short_at = int(permuted(np.array([blocks - 1]), blocks, (seed, number, epochs), True)[0])
    short_by = blocks * block - words

    def upto(r: int) -> int:
        return r * block - (short_by if short_at < r else 0)

    r = -(-rest // block)
    if upto(r) < rest:
        r += 1
    return Source(number, words, target, blocks, epochs * blocks + r, rest - upto(r - 1))


def _log_factorials(m: int, k: int) -> float:
    """log(m! / k!), also of very large numbers near each other."""
    if min(m, k) < 1000:
        return math.lgamma(m + 1) - math.lgamma(k + 1)
    d = k - m
    # The difference of two Stirling series, without their large equal parts.
    return d - d * math.log(m) - (k + 0.5) * math.log1p(d / m) + (1 / m - 1 / k) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` things drawn from ``good`` and ``bad`` ones are good, for numbers of any size:
    rejection from a hat around the mode, which holds for every log-concave distribution."""
    if not good or not n:
        return 0
    if not bad or n == good + bad:
        return min(good, n)
    low, high = max(0, n - bad), min(good, n)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))

    def log_ratio(k: int) -> float:
        return (_log_factorials(mode, k) + _log_factorials(good - mode, good - k)
                + _log_factorials(n - mode, n - k) + _log_factorials(bad - n + mode, bad - n + k))

    whole = good + bad
    variance = n * (good / whole) * (bad / whole) * ((whole - n) / max(1, whole - 1))
    # No more than the mode's probability may be in the hat; the normal density is near it.
    top = min(1.0, 0.95 / math.sqrt(2 * math.pi * variance + 1))
    w = 1 + top / 2
    while True:
        u, v, accept, sign = rng.random(), rng.random(), rng.random(), rng.random() < 0.5
        far = u > w / (1 + w)
        e = -math.log(1 - v) if far else 0.0
        y = (w + e) / top if far else v * w / top
        x = round(y)
        k = mode - x if sign else mode + x
        if low <= k <= high and math.log(1 - accept) - e <= log_ratio(k):
            return k


def split(rng: np.random.Generator, counts: np.ndarray, n: int, limit: int) -> np.ndarray:
    """How many of each count are among ``n`` drawn: a chain of draws, one count at a time."""
    if counts.sum() < limit:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out, rest = np.zeros(len(counts), np.int64), int(counts.sum())
    for i, count in enumerate(counts.tolist()):
        rest -= count
        out[i] = hypergeometric(rng, count, rest, n)
        n -= int(out[i])
    return out


def shard_counts(shard: int, n_shards: int, per_shard: int, slots: np.ndarray, seed: int,
                 limit: int = NUMPY_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in a shard, and the ordinal of the first of each."""
    counts, first = slots.astype(np.int64), np.zeros(len(slots), np.int64)
    low, high = 0, n_shards
    while high - low > 1:
        middle = (low + high) // 2
        n_left = (middle - low) * per_shard
        left = split(np.random.default_rng([seed, low, high]), counts, n_left, limit)
        if shard < middle:
            counts, high = left, middle
        else:
            counts, first, low = counts - left, first + left, middle
    return counts, first


# --- the mix ------------------------------------------------------------------------------------


def _dealt(sized: DataFrame, chunks: int, chunk_rows: int) -> DataFrame:
    """Rows with the chunk they are dealt to, by id and text alone, and their ``__copy`` number there.
    Rows that agree in both can change places. If they are more than ``chunk_rows``, they are
    numbered (in parts, by the stored row number) and every ``chunk_rows`` of them dealt anew."""
    rows = sized.where("__size > 0").select("__row", "__sid", "__size", "__key")
    same = ["__sid", "__key"]
    hot = rows.groupBy(*same).count().where(F.col("count") > chunk_rows).select(*same)
    part = F.pmod(F.xxhash64("__row"), F.lit(256)).alias("__part")
    many = stored(rows.join(hot, same).select("*", part), "copies")
    before = Window.partitionBy(*same).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = many.groupBy(*same, "__part").count().select(
        *same, "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(*same, "__part").orderBy("__row")
    many = many.withColumn("__n", F.row_number().over(inside) - 1).join(
        firsts, [*same, "__part"]).withColumn("__copy", F.col("__first") + F.col("__n"))
    few = rows.join(hot, same, "left_anti").withColumn("__copy", F.lit(0).cast("long"))
    chunk = F.pmod(F.xxhash64("__key", F.floor(F.col("__copy") / chunk_rows)), F.lit(chunks))
    columns = ["__row", "__sid", "__size", "__key", "__copy"]
    return few.select(*columns).unionByName(many.select(*columns)).withColumn("__chunk", chunk)


def _spans(sized: DataFrame, block: int, chunk_rows: int) -> DataFrame:
    """Each row's place in its source's stream: ``__from`` (0 at the start of the stream). Rows are
    dealt to chunks at random; chunk totals give the chunks' places, so no source is in one task."""
    rows = sized.count()
    chunks = max(64, -(-rows // chunk_rows))
    dealt = _dealt(sized, chunks, chunk_rows)
    before = Window.partitionBy("__sid").orderBy("__chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__sid", "__chunk").agg(F.sum("__size").alias("__sum")).select(
        "__sid", "__chunk", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__sid", "__chunk").orderBy("__key", "__copy", "__row").rowsBetween(
        Window.unboundedPreceding, -1)
    return dealt.join(offsets, ["__sid", "__chunk"]).select(
        "__row", "__sid", "__size",
        (F.col("__base") + F.coalesce(F.sum("__size").over(within), F.lit(0))).alias("__from"),
    )


def _pieces(spans: DataFrame, block: int) -> DataFrame:
    """What each block holds of each row: ``__word`` (first word, from 0 in the row), ``__n`` words
    and ``__at`` (their place in the block)."""
    last = F.col("__from") + F.col("__size") - 1
    start = F.col("__block") * block
    begin = F.greatest(F.col("__from"), start)
    end = F.least(last + 1, start + block)
    return spans.select(
        "*", F.explode(F.sequence(F.floor(F.col("__from") / block), F.floor(last / block)))
        .alias("__block"),
    ).select("__sid", "__block", "__row", (begin - F.col("__from")).alias("__word"),
             (end - begin).alias("__n"), (begin - start).alias("__at"))


def _slots(spark, sources: list[Source], block: int, per_shard: int, seed: int) -> DataFrame:
    """One row per slot: ``shard``, ``slot``, ``__sid``, ``epoch``, ``__block``, ``__take``."""
    slots = np.array([s.slots for s in sources], np.int64)
    total = int(slots.sum())
    n_shards = max(1, -(-total // per_shard))
    # The last shard may be short: slots of an extra source that nobody sees fill it up.
    filled = np.append(slots, n_shards * per_shard - total)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"].tolist():
                counts, first = shard_counts(shard, n_shards, per_shard, filled, seed)
                parts = []
                for s in sources:
                    n = np.arange(counts[s.number]) + first[s.number]
                    epoch = n // max(1, s.blocks)
                    to = np.zeros(len(n), np.int64)
                    for e in np.unique(epoch).tolist():
                        here = epoch == e
                        to[here] = permuted(n[here] % s.blocks, s.blocks, (seed, s.number, e))
                    take = np.where(n == s.slots - 1, s.last_take, block)
                    parts.append((np.full(len(n), s.number), epoch, to, take))
                columns = [np.concatenate(x) for x in zip(*parts)]
                slot = np.random.default_rng([seed, 1, shard]).permutation(len(columns[0]))
                yield pd.DataFrame(dict(zip(
                    ("shard", "slot", "__sid", "epoch", "__block", "__take"),
                    (np.full(len(slot), shard), slot, *columns))))

    return spark.range(0, n_shards if total else 0, 1, 1 + n_shards // 64
                       ).mapInPandas(
        draw, "shard long, slot long, __sid int, epoch long, __block long, __take long")


@dataclass(frozen=True)
class Mix:
    """``rows``: each row's ``__row``, ``__id``, ``size``, ``source_size`` and ``target``.
    ``spans``: what the mix takes: ``shard``, ``slot``, ``position`` (of the span's first word in
    the slot), ``epoch``, ``__row``, ``start`` (word, from 0 in the row) and ``n_words``."""

    rows: DataFrame
    spans: DataFrame


def mixed(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    row_id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    block: int = 128,
    per_shard: int = 512,
    chunk_rows: int = 10_000,
    seed: int = 7,
    place: str | None = None,
) -> Mix:
    """The mix of all ``docs``. Sources go by code point, null last (null is a source of its own),
    and weigh ``weights``, repeating.

    Sizes are words; null and empty texts have none and are never taken. A source without words has
    the target 0. Repeated rows are rows of their own. What is taken depends on ids, sources and
    texts alone, not on the order or the split of the scan. An empty table gives empty results. Extra
    columns are not looked at. The driver holds one line per source and nothing per document.
    """
    spark = docs.sparkSession
    sized = stored(docs.select(
        (F.col(place) if place else F.monotonically_increasing_id()).alias("__row"),
        F.col(row_id).alias("__id"),
        F.col(source).cast("string").alias("__source"), word_count(text).alias("__size"),
        F.xxhash64(F.col(row_id).cast("string"), filled(text)).alias("__key"),
    ), "sizes")
    found = sized.groupBy("__source").agg(F.sum("__size").alias("words")).collect()
    found.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))
    wanted = targets([r.words for r in found], weights, share, cap)
    plan = [planned(i, r.words, t, block, seed) for i, (r, t) in enumerate(zip(found, wanted))]
    table = spark.createDataFrame(
        [(r["__source"], i, r.words, t) for i, (r, t) in enumerate(zip(found, wanted))],
        "__source string, __sid int, source_size long, target double",
    )
    # One line per source, which weights have to be given for: small enough to send to all tasks.
    rows = sized.alias("d").join(
        F.broadcast(table.alias("s")), F.expr("d.__source <=> s.__source")
    ).select("d.__row", "d.__id", "s.__sid", "d.__size", "d.__key", "s.source_size", "s.target")
    pieces = _pieces(_spans(rows, block, chunk_rows), block)
    slots = _slots(spark, plan, block, per_shard, seed)
    # Spark takes the slots for small, as it doesn't see what a shard becomes; they grow with the
    # table and must not be broadcast.
    spans = slots.hint("merge").join(pieces, ["__sid", "__block"]).where("__at < __take").select(
        "shard", "slot", F.col("__at").alias("position"), "epoch", "__row",
        F.col("__word").alias("start"),
        F.least(F.col("__n"), F.col("__take") - F.col("__at")).alias("n_words"),
    )
    return Mix(rows.drop("__key").withColumnRenamed("__size", "size"), spans)


def taken(mix: Mix) -> DataFrame:
    """``mix.rows`` with ``taken``: the words that the mix takes of the row, repeats counted."""
    sums = mix.spans.groupBy("__row").agg(F.sum("n_words").alias("taken"))
    return mix.rows.join(sums, "__row", "left").withColumn(
        "taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: for each pass over its source, a
    row whose text is what that pass takes of it (whole documents as they are, parts as runs of
    their words; ``n_chars``, if there, is counted anew)."""
    small_batches(docs.sparkSession)
    columns = docs.columns
    row, got = fresh(docs, "__row"), fresh(docs, "__mix")
    docs = numbered(docs, row)
    mix = mixed(docs, text, place=row, **options)
    parts = mix.spans.groupBy("__row", "epoch").agg(
        F.sum("n_words").alias("words"),
        F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("parts"),
    ).join(mix.rows.select("__row", "size"), "__row").select(
        F.col("__row").alias(row),
        F.struct("parts", (F.col("words") == F.col("size")).alias("whole")).alias(got))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        import re

        word = re.compile(r"[^ \t-\r]+")
        out = []
        for one, runs in zip(texts, spans):
            joined: list[list[int]] = []
            for run in runs:
                a, b = run["start"], run["start"] + run["n_words"]
                if joined and joined[-1][1] == a:
                    joined[-1][1] = b
                else:
                    joined.append([a, b])
            at = [m.span() for m in word.finditer(one)]
            out.append(" ".join(one[at[a][0]:at[b - 1][1]] for a, b in joined))
        return pd.Series(out)

    assert SIZE_WORD == r"[^\x20\x09-\x0D]+"  # the pattern above, as Python writes it
    rows = docs.join(parts, row)
    # Two branches, so that whole texts don't pass through Python.
    kept = rows.where(F.col(got)["whole"])
    partial = rows.where(~F.col(got)["whole"]).withColumn(
        text, cut(F.col(text), F.col(got)["parts"]))
    out = kept.unionByName(partial)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
