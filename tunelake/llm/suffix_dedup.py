"""Removal of passages that repeat anywhere, by suffix arrays over shards.

A byte is removed if some ``length``-byte string that covers it also starts somewhere else.

Where could that be? Every string of ``length`` bytes has an anchor: the smallest hash of the
``window``-byte pieces in it. Equal strings have equal anchors, so only strings with the same
anchor have to be compared, and only anchors that occur twice matter. The starts of a text that
share an anchor are contiguous; with the bytes they need they form a context. So:

1. each text is cut into contexts; (anchor, place, hash of the context) go out, no text;
2. anchors that occur twice (maybe within one context) are kept. Equal contexts of an anchor are one, with a count; a count of
   two means that all its starts repeat;
3. anchors with different contexts are dealt to shards of bounded size; a shard's contexts are one
   text, whose suffix array is made by induced sorting; where the permuted common prefix with a
   neighbour reaches ``length``, the start repeats;
4. the starts go back to their texts as ranges, and each text is cut once.

Anchors with very many different contexts are split by a second anchor, so that no shard gets them
all. A line that many texts share, shorter than ``length``, can hold both anchors; contexts that are
too many even so are not searched, but their starts counted by the digest of their ``length`` bytes.
Only texts with a repeated anchor travel: a bitmap of fixed size keeps back most others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import among, batches_of, filled, numbered, small_batches, stored
from tunelake.llm.suffix_array import common_prefixes, suffix_array

LENGTH, WINDOW = 200, 72
#: Bytes of contexts in a shard, about.
SHARD_BYTES = 1 << 20
#: An anchor with more different contexts is split by a second anchor.
MANY = 2000
_TABLES = np.random.default_rng(21).integers(1, 2**63, (2, 256), dtype=np.uint64)
_MULT = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


def window_hashes(data: np.ndarray, width: int, which: int) -> np.ndarray:
    """A hash of each ``width``-byte piece, put together from pieces of 1, 2, 4, ... bytes."""
    n = len(data) - width + 1
    out, used = None, 0
    piece, power, size = _TABLES[which][data], _MULT[which], 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                part = piece[used:used + n]
                out = part.copy() if out is None else out * power + part
                used += size
            if used == width:
                break
            piece = piece[:-size] * power + piece[size:]
            power, size = power * power, 2 * size
        out ^= out >> np.uint64(31)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))


def contexts(data: np.ndarray, length: int, width: int, which: int = 0
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a text's starts (places that have ``length`` bytes): anchor, first start,
    number of starts, and whether the anchor occurs again within (so that the context may repeat in
    itself), for each run of starts with the same anchor."""
    n = len(data) - length + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    hashes = window_hashes(data, width, which)
    least, size, span = hashes, 1, length - width + 1
    while 2 * size <= span:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[:n], least[span - size:span - size + n])
    change = least[1:] != least[:-1]
    first = np.flatnonzero(np.r_[True, change])
    # The anchor stays behind and the next start still has one of the same value.
    again = np.r_[(hashes[:n - 1] == least[:-1]) & ~change, False]
    return least[first], first, np.diff(np.r_[first, n]), np.logical_or.reduceat(again, first)


def _anchored(texts: DataFrame, length: int, width: int) -> DataFrame:
    """``__row``, ``start``, ``n``, ``anchor``, ``context``, ``loops``: step 1."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 200):
            rows, starts, counts, anchors, hashes, loops = [], [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                anchor, first, n, loop = contexts(
                    np.frombuffer(data, np.uint8), length, width)
                if not len(anchor):
                    continue
                rows.append(np.full(len(anchor), row))
                starts.append(first)
                counts.append(n)
                anchors.append(anchor)
                loops.append(loop)
                hashes.append(np.fromiter(
                    (xxhash.xxh3_64_intdigest(data[a:b]) for a, b in
                     zip(first.tolist(), (first + n + (length - 1)).tolist())),
                    np.uint64, len(first)))
            if rows:
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(np.concatenate(x).view(np.int64)) for x in
                      (rows, starts, counts, anchors, hashes)),
                    pa.array(np.concatenate(loops)),
                ], ["__row", "start", "n", "anchor", "context", "loops"])

    return texts.mapInArrow(
        cut, "__row long, start long, n long, anchor long, context long, loops boolean"
    ).select("__row", F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"),
             "anchor", "context", "loops")


def _pieces(wanted: DataFrame, texts: DataFrame, length: int, width: int) -> DataFrame:
    """The bytes of the contexts wanted: ``shard`` key, which context, and ``data``; those of an
    anchor with many contexts once more cut by a second anchor (``at``: place in the context)."""
    asked = wanted.groupBy("__row").agg(F.collect_list(
        F.struct("start", "n", "anchor", "context", "copies", "many")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("key", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()),
                          ("copies", pa.int64()), ("at", pa.int32()), ("data", pa.binary())])
        for batch in batches_of(batches, 100):
            out = []
            for text, asked_of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                for x in asked_of:
                    piece = data[x["start"]:x["start"] + x["n"] + length - 1]
                    same = {"anchor": x["anchor"], "context": x["context"],
                            "copies": x["copies"]}
                    if not x["many"]:
                        out.append(same | {"key": x["anchor"], "at": 0, "data": piece})
                        continue
                    second = contexts(np.frombuffer(piece, np.uint8), length, width, 1)
                    for anchor, first, n in zip(*(v.tolist() for v in second[:3])):
                        key = xxhash.xxh3_64_intdigest(
                            x["anchor"].to_bytes(8, "big", signed=True) + anchor.to_bytes(8))
                        out.append(same | {
                            "key": key - 2**64 if key >= 2**63 else key, "at": first,
                            "data": piece[first:first + n + length - 1]})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return texts.join(asked, "__row").select("__text", "asked").mapInArrow(
        fetch, "key long, anchor long, context long, copies long, at int, data binary")


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, its starts whose ``length`` bytes also start elsewhere in the pieces."""
    # Bytes of UTF-8 are below 245: 255 parts the pieces, 0 ends the text.
    joined = np.frombuffer(b"\xfe".join([*pieces, b""]), np.uint8) + np.uint8(1)
    text = np.r_[joined, np.uint8(0)].astype(np.uint8)
    sa = suffix_array(text, 256)
    before, common = common_prefixes(text, sa, length)
    long_ = np.flatnonzero(common >= length)
    flag = np.zeros(len(text), bool)
    flag[long_] = True
    flag[before[long_]] = True
    out, at = [], 0
    for p in pieces:
        out.append(np.flatnonzero(flag[at:at + len(p) - length + 1]))
        at += len(p) + 1
    return out


def _runs(places: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of consecutive places."""
    if not len(places):
        return [], []
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.r_[0, cut + 1]].tolist(), places[np.r_[cut, len(places) - 1]].tolist()


def _searched(pieces: DataFrame, shards: int, length: int) -> DataFrame:
    """(anchor, context, a, b): runs of repeated starts, counted within the context: step 3."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "context", "a", "b"]
        held: list[tuple] = []
        current, size = None, 0

        def done() -> pa.RecordBatch:
            out: list[list[int]] = [[], [], [], []]
            found = repeated_starts([h[-1] for h in held], length)
            for (anchor, context, copies, at, _), places in zip(held, found):
                if copies > 1:
                    continue  # all its starts repeat anyway
                a, b = _runs(places)
                out[0] += [anchor] * len(a)
                out[1] += [context] * len(a)
                out[2] += [x + at for x in a]
                out[3] += [x + at for x in b]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in
                       ("shard", "key", "anchor", "context", "copies", "at", "data"))
            for shard, key, *rest in zip(*columns):
                # A shard may be larger than meant: it is parted between keys (see ``_parted``).
                if held and (shard != current[0]
                             or key != current[1] and size > 2 * SHARD_BYTES):
                    yield done()
                    held, size = [], 0
                current = shard, key
                held.append(tuple(rest))
                size += len(rest[-1])
        if held:
            yield done()

    return pieces.withColumn(
        "shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    ).repartition("shard").sortWithinPartitions("shard", "key", "context", "at").mapInArrow(
        search, "anchor long, context long, a long, b long")


def _parted(pieces: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pieces whose key fits a shard, and those of keys that don't (None if there are none). One
    piece alone stays: it is no longer than its text."""
    sizes = pieces.groupBy("key").agg(
        F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("n"))
    # Stored, so that the joins below can split a large key.
    hot = stored(sizes.where((F.col("bytes") > SHARD_BYTES) & (F.col("n") > 1)).select("key"),
                 "hot-keys")
    if hot.isEmpty():
        return pieces, None
    return pieces.join(hot, "key", "left_anti"), pieces.join(hot, "key")


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """What ``_searched`` gives, for pieces of any number: a row for each start (one for a run of
    equal ones), and starts of equal digests are counted. Equal strings have equal anchors, so all
    of them are here."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "context", "copies", "a", "b", "digest"]
        for batch in batches_of(batches, 100):
            out: list[list] = [[], [], [], [], [], []]
            columns = (batch.column(c).to_pylist() for c in names[:3] + ["at", "data"])
            for anchor, context, copies, at, data in zip(*columns):
                last = None
                for i in range(len(data) - length + 1):
                    one = xxhash.xxh3_128_digest(data[i:i + length])
                    if one == last:
                        out[4][-1] = at + i
                        continue
                    last = one
                    for column, x in zip(out, (anchor, context, copies, at + i, at + i, one)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())],
                names)

    starts = stored(pieces.select("anchor", "context", "copies", "at", "data").mapInArrow(
        digest, "anchor long, context long, copies long, a long, b long, digest binary"), "starts")
    # Summed within each task first, and stored, so that the join can split a common string.
    twice = stored(starts.groupBy("digest").agg(F.sum(F.expr("b - a + 1")).alias("n")).where(
        "n > 1").select("digest"), "repeated-starts")
    return starts.where("copies = 1").join(twice, "digest").select("anchor", "context", "a", "b")


REMOVED = ("__row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
           "spans array<struct<start:long,end:long>>, kept binary")


def _cut(rows: DataFrame, length: int, with_text: bool) -> DataFrame:
    """Step 4: ``ranges`` are the repeated starts of each text (first, last)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([
            ("__row", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
            ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("kept", pa.binary())])
        for batch in batches_of(batches, 200):
            out = []
            for row, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data, spans = text.encode(), []
                for x in sorted((r["a"], r["b"] + length) for r in ranges):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append([*x])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                out.append({
                    "__row": row, "n_bytes": len(data), "n_removed": len(data) - len(left),
                    "n_spans": len(spans), "kept_sha256": hashlib.sha256(left).hexdigest(),
                    "spans": [{"start": a, "end": b} for a, b in spans],
                    "kept": left if with_text else None})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows.select("__row", "__text", "ranges").mapInArrow(cut, REMOVED)


def without_repeats(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    length: int = LENGTH,
    window: int = WINDOW,
    with_text: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: ``__id`` and ``REMOVED``: bytes, bytes removed, maximal removed
    runs (``spans``, in bytes), the SHA-256 of what is left and, ``with_text``, the bytes left
    themselves (a cut may fall within a character).

    Null counts as empty. Texts shorter than ``length`` bytes lose nothing. Repeated rows are texts
    like others, so long ones go as a whole, each. An empty table gives an empty result; other
    columns are not looked at. Strings are judged on the input, not on what is left, and never cross texts.
    """
    small_batches(docs.sparkSession)
    texts = numbered(docs.select(F.col(row_id).alias("__id"), filled(text).alias("__text")))
    anchored = stored(_anchored(texts.select("__row", "__text"), length, window), "anchors")
    twice = anchored.groupBy("anchor").agg(
        F.count("*").alias("times"), F.bool_or("loops").alias("loops")).where("times > 1 or loops")
    repeated = stored(anchored.join(twice.select("anchor"), "anchor"), "repeated")

    distinct = stored(repeated.groupBy("anchor", "context").agg(
        F.count("*").alias("copies"), F.min(F.struct("__row", "start", "n")).alias("one"),
        F.bool_or("loops").alias("loops")), "contexts")
    # An anchor's only context needs no search if it has copies, or can't repeat in itself.
    # Stored, so that the join below can split a common anchor.
    several = stored(distinct.groupBy("anchor").agg(
        F.count("*").alias("different"), F.bool_or(F.expr("loops and copies = 1")).alias("self")
    ).where("different > 1 or self"), "several")
    wanted = distinct.join(several, "anchor").select(
        "one.*", "anchor", "context", "copies", (F.col("different") > MANY).alias("many"))
    maybe = among(texts, repeated)
    pieces = stored(_pieces(wanted, maybe.where("__maybe").select("__row", "__text"), length,
                            window), "pieces")
    total = pieces.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    few, hot = _parted(pieces)
    found = _searched(few, max(64, -(-total // SHARD_BYTES)), length)
    if hot is not None:
        found = found.unionByName(_counted(hot, length))

    # Ranges of repeated starts, in the texts.
    whole = repeated.join(distinct.where("copies > 1").select("anchor", "context"),
                          ["anchor", "context"]).select(
        "__row", F.col("start").cast("long").alias("a"),
        (F.col("start") + F.col("n") - 1).cast("long").alias("b"))
    single = distinct.where("copies = 1").join(found, ["anchor", "context"]).select(
        F.col("one.__row").alias("__row"), (F.col("one.start") + F.col("a")).alias("a"),
        (F.col("one.start") + F.col("b")).alias("b"))
    ranges = stored(whole.unionByName(single).groupBy("__row").agg(
        F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")
    # Texts that can't have any are done where they are read; the others meet their ranges.
    touched = among(texts, ranges)
    none = F.lit(None)
    untouched = touched.where("not __maybe").select(
        "__row", F.octet_length("__text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("__text", 256).alias("kept_sha256"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        (F.col("__text").cast("binary") if with_text else none.cast("binary")).alias("kept"))
    changed = _cut(
        touched.where("__maybe").join(ranges, "__row", "left").select(
            "__row", "__text", F.coalesce("ranges", F.array()).alias("ranges")),
        length, with_text)
    done = untouched.unionByName(changed)
    return texts.select("__row", "__id").join(done, "__row")
