"""Similarity join on word n-grams: a MinHash LSH forest, verified exactly.

Two texts are linked if the Jaccard similarity of their sets of n-grams is at least the threshold.

* Texts with equal n-gram sets form a class; only one of each class goes on.
* A signature holds ``trees`` x ``depth`` minhashes. The minhashes of a tree, in order, are a path
  in a prefix trie; texts whose paths agree on the first k steps meet in a node ("bucket").
* The forest is searched from long prefixes to short ones. After each round, every link found
  weighs 1 / (its chance of being found so far); the sum estimates how many links there are. The
  prefix is shortened until links found / links estimated reaches the target recall, and a link at
  the threshold itself would be found with that probability.
* A pair is looked at in one bucket only: at the first tree whose prefix it shares, and not again
  in later rounds. In a bucket, signatures tell which pairs can reach the threshold (an estimate
  six standard errors below it is out); their n-gram sets are then compared exactly.

Pairs are never rows. Buckets are cut into blocks of ``block`` texts; a task compares two blocks and
returns, for each text, its number of links, and the links of a spanning forest, which are enough
to connect the texts. So large groups of near copies cost comparisons but no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import (
    among, batches_of, filled, fresh, narrowed, numbered, small_batches, spent, stored,
    without_rows,
)

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 16, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of the lower-case words (between white space).
    A text of fewer words is one gram; a text without words has the gram of nothing."""
    words = text.lower().split()
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(words))], np.uint64)
    known: dict[str, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter((known[w] for w in words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):  # a chain of bijections: equal only for equal words, in order
            out = (out ^ hashes[i:i + len(out)]) * _MIX
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return np.unique(out)


def minhashes(sets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """32-bit minhashes of one set, for each seed."""
    out = np.empty(len(seeds), np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(seeds), 8):
            mixed = (sets ^ seeds[at:at + 8, None]) * _MIX
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            out[at:at + 8] = (mixed >> np.uint64(32)).min(1)
    return out


def chance(similarity: np.ndarray | float, depth: int, trees: int = TREES):
    """Of finding a pair by prefixes of ``depth``."""
    return 1 - (1 - np.asarray(similarity) ** depth) ** trees


# --- comparing blocks -----------------------------------------------------------------------------


def fresh_pairs(a: np.ndarray, b: np.ndarray, tree: int, depth: int, before: int | None,
                threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of signatures ``a`` against ``b`` that share a bucket of ``tree`` at ``depth``: the pairs
    that belong to this bucket (no earlier tree, no round ``before`` has them) and may reach the
    threshold."""
    trees, steps = a.shape[1], a.shape[2]
    n = trees * steps
    out_i, out_j = [], []
    low = threshold - 6 * math.sqrt(threshold * (1 - threshold) / n)
    for i in range(len(a)):
        rest = b[i + 1:] if same else b
        if not len(rest):
            continue
        equal = rest == a[i]
        alike = equal.sum((1, 2)) >= low * n
        if not alike.any():
            continue
        some = np.flatnonzero(alike)
        # Length of the common prefix in each tree.
        common = np.cumprod(equal[some], axis=2).sum(2)
        first = (common >= depth).argmax(1) == tree
        if before is not None:
            first &= common.max(1) < before
        some = some[first]
        out_i.append(np.full(len(some), i))
        out_j.append(some + (i + 1 if same else 0))
    if not out_i:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(out_i), np.concatenate(out_j)


def similar(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]
            ) -> np.ndarray:
    """Exact Jaccard similarity of the pairs (left[i], right[j])."""
    out = np.zeros(len(i))
    for one in np.unique(i):
        here = np.flatnonzero(i == one)
        mine = left[one]
        others = [right[x] for x in j[here]]
        sizes = np.array([len(x) for x in others])
        flat = np.concatenate(others)
        at = np.searchsorted(mine, flat)
        hit = mine[np.minimum(at, len(mine) - 1)] == flat
        both = np.add.reduceat(hit, np.cumsum(sizes) - sizes)
        out[here] = both / (len(mine) + sizes - both)
    return out


class _Forest:
    """Union-find over texts, to return no more links than connect them."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _grouped(work: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], keys: list[str]
             ) -> Callable:
    """For mapInArrow over partitions sorted by ``keys``: a bounded group at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(k).to_numpy() for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for v in values:
                new[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(new), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(int(v[a]) for v in values)
                if key != current:
                    if held:
                        yield from work(current, pa.Table.from_batches(held))
                    current, held = key, []
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(current, pa.Table.from_batches(held))

    return run


def _signed(texts: DataFrame, n: int, seeds: np.ndarray) -> DataFrame:
    """``__row``, ``same`` (which sets are equal) and ``sig``. The sets themselves are larger than the
    texts and are not kept."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            sets = [grams(t, n) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([minhashes(s, seeds).tobytes() for s in sets], pa.binary()),
            ], ["__row", "same", "sig"])

    return texts.mapInArrow(sign, "__row long, same binary, sig binary")


def _sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``text_id`` and ``set``, the n-grams, of the wanted texts."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 256):
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([grams(t, n).tobytes() for t in
                                           batch.column(1).to_pylist()], pa.binary()),
            ], ["text_id", "set"])

    near = narrowed(texts.select(F.col("__row").alias("text_id"), "__text"), wanted, "text_id")
    return near.join(wanted, "text_id").select(
        "text_id", "__text").mapInArrow(read, "text_id long, set binary")


def _firsts(signed: DataFrame, places: DataFrame, classes: DataFrame) -> DataFrame:
    """``text_id`` and ``sig`` of the first row of each class. Only rows that may be copies move."""
    copies = stored(places.join(classes.where("copies > 1").select("same", "text_id"), "same").where(
        "__row <> text_id").select("__row"), "copies")
    marked = among(signed.select("__row", "sig"), copies)
    texts = stored(
        marked.where("NOT __maybe").unionByName(
            marked.where("__maybe").join(copies, "__row", "left_anti")
        ).select(F.col("__row").alias("text_id"), "sig"), "texts")
    spent(copies)
    return texts


def _blocked(members: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Each member of a group of ``size`` once for each pair of blocks that its block is in:
    ``bi`` <= ``bj``. Groups of up to ``block`` members are one block. Members go to blocks by
    hash."""
    n = F.ceil(F.col("size") / block).cast("int")
    mine = F.pmod(F.xxhash64("text_id", F.lit(3)), F.col("blocks")).cast("int")
    return members.withColumn("blocks", n).withColumn("mine", mine).select(
        *keys, "text_id", "mine",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(*keys, "text_id", "mine", F.least("mine", "other").alias("bi"),
             F.greatest("mine", "other").alias("bj"))


def _candidates(signed: DataFrame, depth: int, before: int | None, threshold: float, trees: int,
                steps: int, block: int) -> DataFrame:
    """Members of buckets that have pairs of their own to compare there: ``tree``, ``bucket``,
    ``part`` (connected members of the bucket) and ``text_id``."""
    prefix = F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.xxhash64(F.substring(F.col("sig"), t * steps * 4 + 1, F.lit(depth * 4)), t)))
    paths = signed.select("text_id", prefix.alias("tree", "bucket"))
    keys = ["tree", "bucket"]
    # Stored, so that the join with it has a plain exchange on either side and can split a large group.
    sizes = stored(paths.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    # Only paths that another text has too are moved to their buckets, and only texts that share a
    # bucket bring their signatures along.
    shared = stored(narrowed(paths, sizes, "bucket").join(sizes, keys), "shared")
    spent(sizes)
    members = _blocked(shared, keys, block).join(narrowed(signed, shared, "text_id"), "text_id")

    def compare(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, bucket, bi, bj = key
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(
            table.num_rows, trees, steps)
        ids, mine = table.column("text_id").to_numpy(), table.column("mine").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, mine, sigs = ids[order], mine[order], sigs[order]
        a, b = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
        i, j = fresh_pairs(sigs[a], sigs[b], tree, depth, before, threshold, bi == bj)
        if not len(i):
            return
        i, j = a[i], b[j]
        forest = _Forest()
        for x, y in zip(i.tolist(), j.tolist()):
            forest.join(x, y)
        some = np.unique(np.concatenate([i, j]))
        part = np.array([ids[forest.root(x)] for x in some.tolist()])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(some), tree)), pa.array(np.full(len(some), bucket)),
            pa.array(np.full(len(some), bi)), pa.array(np.full(len(some), bj)),
            pa.array(part), pa.array(mine[some].astype(np.int64)), pa.array(ids[some]),
        ], ["tree", "bucket", "bi", "bj", "part", "mine", "text_id"])

    keys = ["tree", "bucket", "bi", "bj"]
    found = stored(members.select(
        *(F.col(k).cast("long").alias(k) for k in keys), "mine", "text_id", "sig"
    ).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _grouped(compare, keys),
        "tree long, bucket long, bi long, bj long, part long, mine long, text_id long"),
        "candidates")
    spent(shared)
    return found


def _verified(found: DataFrame, signed: DataFrame, sets: DataFrame, classes: DataFrame, depth: int,
              before: int | None, threshold: float, trees: int, steps: int) -> DataFrame:
    """Links of a round, without a row per pair: kind 0 rows count the links (``n``, weighted with
    the copies of the linked texts) of ``a``; kind 1 rows are links a - b that connect; kind 2 rows
    have the number of links ``n`` at a similarity of ``b`` per mille."""
    repeated = classes.where("copies > 1").select("text_id", "copies")
    texts = narrowed(signed, sets, "text_id").join(sets, "text_id").join(
        repeated, "text_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    rows = found.join(texts, "text_id")
    keys = ["tree", "bucket", "bi", "bj", "part"]

    def verify(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, _, bi, bj, _ = key
        table = table.sort_by("text_id")
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(
            table.num_rows, trees, steps)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        ids, mine = table.column("text_id").to_numpy(), table.column("mine").to_numpy()
        copies = table.column("copies").to_numpy()
        a, b = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
        i, j = fresh_pairs(sigs[a], sigs[b], tree, depth, before, threshold, bi == bj)
        i, j = a[i], b[j]
        similarity = similar(i, j, sets, sets)
        good = similarity >= threshold
        i, j, similarity = i[good], j[good], similarity[good]
        if not len(i):
            return
        n = (np.bincount(i, weights=copies[j], minlength=len(ids))
             + np.bincount(j, weights=copies[i], minlength=len(ids))).astype(np.int64)
        forest, links = _Forest(), []
        for x, y in zip(i.tolist(), j.tolist()):
            if forest.join(x, y):
                links.append((int(ids[x]), int(ids[y])))
        level, count = np.unique(np.floor(similarity * 1000).astype(np.int64),
                                 return_counts=True)
        some = np.flatnonzero(n)
        columns = zip(
            (np.zeros(len(some), int), ids[some], np.zeros(len(some), int), n[some]),
            (np.ones(len(links), int), np.array([x for x, _ in links], int),
             np.array([y for _, y in links], int), np.zeros(len(links), int)),
            (np.full(len(level), 2), level, level, count),
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c).astype(np.int64)) for c in columns],
            ["kind", "a", "b", "n"])

    return rows.select(*keys, "mine", "text_id", "sig", "set", "copies").repartition(
        *keys).sortWithinPartitions(*keys).mapInArrow(
        _grouped(verify, keys), "kind long, a long, b long, n long")


# --- connected texts --------------------------------------------------------------------------------


def connected(links: DataFrame) -> DataFrame:
    """(text_id, root): the smallest text of each connected set, for texts that have a link.

    Hooks every root to the smallest root it is linked with, then halves all paths, until nothing
    changes: a few rounds, whatever the shape of the set. Each round is written to the shared
    folder.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(),
                  "links")
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("least"))
        .select(F.col("a").alias("text_id"), F.least("a", "least").alias("root")), "roots")
    while True:
        # The smallest root next to each root.
        over = both.join(labels.withColumnRenamed("text_id", "a"), "a").withColumnRenamed(
            "root", "ra").join(
            labels.select(F.col("text_id").alias("b"), F.col("root").alias("rb")), "b")
        hooks = over.where("rb < ra").groupBy(F.col("ra").alias("root")).agg(
            F.min("rb").alias("lower"))
        hooked = labels.join(hooks, "root", "left").select(
            "text_id", F.coalesce("lower", "root").alias("root"))
        up = hooked.select(F.col("text_id").alias("root"), F.col("root").alias("above"))
        now = stored(hooked.join(up, "root", "left").select(
            "text_id", F.least("root", F.coalesce("above", "root")).alias("root")), "roots")
        changed = now.join(labels.withColumnRenamed("root", "was"), "text_id").where(
            "root <> was").limit(1).count()
        spent(labels)
        labels = now
        if not changed:
            spent(both)
            return labels


# --- the join -------------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    n: int = WORDS,
    threshold: float = THRESHOLD,
    target: float = 0.999,
    trees: int = TREES,
    depth: int = DEPTH,
    block: int = 1024,
    seed: int = 3,
    place: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``__id``, ``__row`` (its place in the scan, or column ``place`` of a stored table), ``class_id`` (the
    smallest id of the rows it is connected with, by links or as copies), ``root`` (the place of the
    first of those rows: unlike ``class_id``, no two sets share it), ``class_size``, ``text_class`` (the smallest id of the rows with the same n-grams) and ``n_links`` (other rows
    at a similarity of the threshold or more, copies included).

    Null and empty texts have the empty n-gram set and are copies of each other. Texts shorter than
    ``n`` words are one n-gram. Repeated rows are copies. Null ids are never the smallest unless
    there is no other. An empty table gives an empty result; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    steps = depth
    seeds = np.random.default_rng(seed).integers(0, 2**63, trees * steps, dtype=np.uint64)
    columns = F.col(row_id).alias("__id"), filled(text).alias("__text")
    rows = docs.select(F.col(place).alias("__row"), *columns) if place else numbered(
        docs.select(*columns))
    signed = stored(_signed(rows.select("__row", "__text"), n, seeds), "signatures")
    ids = rows.select("__row", "__id")
    # Equal sets are one text from here on; the place of the first row is its number.
    places = stored(signed.select("__row", "same").join(ids, "__row"), "places")
    classes = stored(places.groupBy("same").agg(
        F.min("__row").alias("text_id"), F.count("*").alias("copies"),
        F.min("__id").alias("text_class")), "classes")
    texts = _firsts(signed, places, classes)
    spent(signed)

    results, before = None, None
    for level in range(depth, 0, -2):
        found = _candidates(texts, level, before, threshold, trees, steps, block)
        sets = stored(_sets(rows, found.select("text_id").distinct(), n), "sets")
        links = stored(_verified(found, texts, sets, classes, level, before, threshold, trees,
                                 steps), "links")
        spent(found, sets)
        results = links if results is None else results.unionByName(links)
        before = level
        # Links by similarity: at most a thousand lines, whatever the size of the table.
        seen = results.where("kind = 2").groupBy(F.col("a")).agg(F.sum("n").alias("n")).collect()
        count = sum(r.n for r in seen)
        likely = sum(r.n / float(chance((r.a + 0.5) / 1000, level, trees)) for r in seen)
        if (not count or count / likely >= target) and chance(threshold, level, trees) >= target:
            break
    spent(texts, *([] if place else [rows]))
    links = results.where("kind = 0").groupBy(F.col("a").alias("text_id")).agg(
        F.sum("n").alias("n"))
    roots = connected(results.where("kind = 1"))
    merged = classes.join(links, "text_id", "left").join(roots, "text_id", "left").select(
        "same", "text_id", "copies", "text_class", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("root", "text_id").alias("root"))
    whole = merged.groupBy("root").agg(
        F.min("text_class").alias("class_id"), F.sum("copies").alias("class_size"))
    of_text = merged.join(whole, "root")
    return places.join(of_text, "same").select(
        "__id", "__row", "class_id", "root", "class_size", "text_class",
        (F.col("n") + F.col("copies") - 1).alias("n_links"))


def without_near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", **options
                            ) -> DataFrame:
    """One row of each connected set stays: the smallest id's, of repeated rows the first."""
    row = fresh(docs, "__row")
    docs = numbered(docs, row)
    found = near_duplicates(docs, text, row_id, place=row, **options)
    # Only sets of more than one row can lose any.
    several = found.where("class_size > 1")
    first = several.where("__id <=> class_id").groupBy("root").agg(F.min("__row").alias("stays"))
    dropped = several.join(first, "root").where("__row <> stays")
    return without_rows(docs, dropped, row)
