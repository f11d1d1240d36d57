"""The trie of the prefixes that conversations share, from composable fingerprints.

A conversation is rebuilt from the head of another (its base) and its own turns after that head.
The rebuilt texts are never made. A run of turns has the fingerprint (length, sum of h(turn i) * B^i),
and two runs in sequence have (n + m, x + B^n * y): fingerprints of sequences form a monoid. So

* tasks fingerprint their own stretch of a conversation, and stretches are composed afterwards: a
  conversation may have any part of all turns;
* the prefix of a rebuilt conversation is composed of its base's head and of a difference of two
  of its own prefixes, moved to where it stands. This takes a few numbers per turn.

Conversations with equal fingerprints at a depth are members of one node. Every group is verified:
all members have to refer to the same last turn (by its 256-bit digest) and to the same parent
fingerprint, which makes them equal by induction; if not, everything is fingerprinted anew with
other bases. Two bases modulo 2^61 - 1 make that a matter of principle.

A node's name is its smallest member. The nodes of one name form a chain, and chains a tree, so sums
over subtrees are sums over chains, gathered in rounds of doubling distance, and sums along a chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelake.llm.common import filled, spent, stored, word_count

PRIME = (1 << 61) - 1
#: Turns of a chain, and ids of a node, that are summed or written together first.
CHUNK = 4096
HEAD = 3
NODE = ["depth", "f1", "f2"]


def bases(seed: int) -> tuple[int, int]:
    return tuple(int(x) for x in np.random.default_rng([seed, 12]).integers(2**32, PRIME - 1, 2))


def value(digest: bytes) -> tuple[int, int]:
    """Two numbers modulo PRIME that stand for a turn; not 0, which no turn has."""
    return (1 + int.from_bytes(digest[:8], "big") % (PRIME - 1),
            1 + int.from_bytes(digest[8:16], "big") % (PRIME - 1))


def powers(base: int, exponents: np.ndarray) -> list[int]:
    known: dict[int, int] = {}
    for e in np.unique(exponents).tolist():
        known[e] = pow(base, e, PRIME)
    return [known[e] for e in exponents.tolist()]


def composed(x: np.ndarray, n: np.ndarray, y: np.ndarray, base: int) -> list[int]:
    """The second numbers of (n, x) * (m, y), for each row."""
    return [(a + p * b) % PRIME
            for a, p, b in zip(x.tolist(), powers(base, n), y.tolist())]


# --- turns in order, with the fingerprints of what comes before ---------------------------------


def _stretches(base: tuple[int, int]):
    """For mapInArrow over rows sorted by conversation and turn: within the task's stretch of each
    conversation, each turn's number (from 1) and the fingerprint up to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, k, x, y, px, py = None, 0, 0, 0, 1, 1
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            for c, digest in zip(batch.column("conv").to_pylist(),
                                 batch.column("digest").to_pylist()):
                if c != conv:
                    conv, k, x, y, px, py = c, 0, 0, 0, 1, 1
                one, two = value(digest)
                x, y, k = (x + px * one) % PRIME, (y + py * two) % PRIME, k + 1
                px, py = px * base[0] % PRIME, py * base[1] % PRIME
                for column, v in zip(out, (k, x, y)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("digest"), batch.column("words"),
                 pa.array(np.full(batch.num_rows, part, np.int64)),
                 *(pa.array(c, pa.int64()) for c in out)],
                ["conv", "digest", "words", "part", "k", "x1", "x2"])

    return run


def _offsets(base: tuple[int, int]):
    """What precedes each stretch of a conversation; a line per stretch."""
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        n, x, y, rows = 0, 0, 0, []
        for part, k, one, two in zip(frame["part"].tolist(), frame["k"].tolist(),
                                     frame["x1"].tolist(), frame["x2"].tolist()):
            rows.append((key[0], part, n, x, y))
            x = (x + pow(base[0], n, PRIME) * one) % PRIME
            y = (y + pow(base[1], n, PRIME) * two) % PRIME
            n += k
        return pd.DataFrame(rows, columns=["conv", "part", "n0", "y1", "y2"])

    return run


def ordered_turns(turns: DataFrame, conv: str, order: str, role: str, text: str,
                  base: tuple[int, int]) -> DataFrame:
    """``conv``, ``n`` (the turn's place, from 1), ``digest`` of its role and text, ``words`` and the
    fingerprint ``x1``, ``x2`` of the turns up to it."""
    role_, text_ = filled(role), filled(text)
    digest = F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    # Rows go to tasks by range, equal rows also by their number: a conversation of any size, and
    # any number of equal turns, spread over tasks. What the ranges are, only this table knows.
    rows = stored(turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(order).alias("place"),
        digest.alias("digest"), word_count(text).alias("words"),
        F.monotonically_increasing_id().alias("salt")), "references")
    by = [F.asc("conv"), F.asc_nulls_first("place"), F.asc("digest"), F.asc("salt")]
    local = stored(
        rows.repartitionByRange(*by).sortWithinPartitions(*by)
        .select("conv", "digest", "words").mapInArrow(
            _stretches(base), "conv long, digest binary, words long, part long, k long, x1 long, "
                              "x2 long"), "stretches")
    totals = local.groupBy("conv", "part").agg(
        F.max("k").alias("k"), F.max_by("x1", "k").alias("x1"), F.max_by("x2", "k").alias("x2"))
    # Conversations in several stretches: at most two per task, whatever the number of turns.
    several = totals.groupBy("conv").agg(F.count("*").alias("m")).where("m > 1")
    offsets = totals.join(several, "conv").groupBy("conv").applyInPandas(
        _offsets(base), "conv long, part long, n0 long, y1 long, y2 long")

    @F.pandas_udf("x1 long, x2 long")
    def moved(n0: pd.Series, y1: pd.Series, y2: pd.Series, x1: pd.Series, x2: pd.Series
              ) -> pd.DataFrame:
        n = n0.to_numpy()
        return pd.DataFrame({"x1": composed(y1.to_numpy(), n, x1.to_numpy(), base[0]),
                             "x2": composed(y2.to_numpy(), n, x2.to_numpy(), base[1])})

    zero = F.lit(0).cast("long")
    at = moved(*(F.coalesce(c, zero) for c in ("n0", "y1", "y2")), F.col("x1"), F.col("x2"))
    out = stored(local.join(offsets, ["conv", "part"], "left").select(
        "conv", (F.col("k") + F.coalesce("n0", zero)).alias("n"), "digest", "words",
        at.alias("at")).select("conv", "n", "digest", "words", "at.x1", "at.x2"), "turns")
    spent(rows, local)
    return out


# --- rebuilt conversations ------------------------------------------------------------------------


def rebuilt(turns: DataFrame, base_of: Column, head_of: Column, base: tuple[int, int]
            ) -> DataFrame:
    """One row per turn of each rebuilt conversation, and one for each as a whole at depth 0:
    ``conv``, ``depth``, ``f1``, ``f2`` (the prefix that ends there), ``p1``, ``p2`` (the one before
    it), ``digest``, ``words`` and ``last``."""
    zero = F.lit(0).cast("long")
    turn = F.struct("n", "x1", "x2", "digest", "words")
    # One line per conversation, with its first turns: at most HEAD of them.
    convs = stored(turns.groupBy("conv").agg(
        F.max("n").alias("size"),
        F.sort_array(F.collect_list(F.when(F.col("n") <= HEAD, turn))).alias("head"),
    ).withColumn("base", base_of).withColumn("h", F.when(head_of.between(0, HEAD), head_of).otherwise(
        F.raise_error(f"a head has 0 to {HEAD} turns").cast("int"))), "conversations")
    heads = convs.select(F.col("conv").alias("base"), F.col("head").alias("lent"))
    convs = convs.join(heads, "base", "left").withColumn(
        "lent", F.slice(F.coalesce("lent", F.array().cast(convs.schema["head"].dataType)), F.lit(1),
                        F.col("h"))
    ).withColumn("lent_n", F.size("lent").cast("long")).withColumn(
        "length", F.col("lent_n") + F.greatest(zero, F.col("size") - F.col("h")))
    end = F.when(F.col("lent_n") > 0, F.element_at("lent", -1))
    own = F.when((F.col("h") > 0) & (F.col("size") >= F.col("h")),
                 F.get("head", F.col("h") - 1))
    convs = convs.select(
        "conv", "h", "lent", "lent_n", "length",
        F.coalesce(end["x1"], zero).alias("a1"), F.coalesce(end["x2"], zero).alias("a2"),
        F.coalesce(own["x1"], zero).alias("y1"), F.coalesce(own["x2"], zero).alias("y2"))
    one = F.explode("lent").alias("t")
    lent = convs.select("conv", "length", one).select(
        "conv", F.col("t.n").alias("depth"), "length", "t.digest", "t.words", zero.alias("shift"),
        F.col("t.x1").alias("a1"), F.col("t.x2").alias("a2"), zero.alias("x1"), zero.alias("x2"),
        zero.alias("y1"), zero.alias("y2"))
    # Nothing but the turns may be large here: a conversation has one line on the other side.
    rest = turns.join(convs, "conv").where("n > h").select(
        "conv", (F.col("lent_n") + F.col("n") - F.col("h")).alias("depth"), "length", "digest",
        "words", (F.col("lent_n") - F.col("h")).alias("shift"), "a1", "a2", "x1", "x2", "y1", "y2")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {c: batch.column(c).to_pylist()
                   for c in ("depth", "shift", "digest", "a1", "a2", "x1", "x2", "y1", "y2")}
            values = [value(d) for d in got["digest"]]
            columns = {}
            for i in (0, 1):
                moves = powers(base[i], np.array(got["shift"], np.int64))
                places = powers(base[i], np.array(got["depth"], np.int64) - 1)
                f = [(a + m * (x - y)) % PRIME for a, m, x, y in zip(
                    got[f"a{i + 1}"], moves, got[f"x{i + 1}"], got[f"y{i + 1}"])]
                columns[f"f{i + 1}"] = f
                columns[f"p{i + 1}"] = [(a - p * v[i]) % PRIME
                                        for a, p, v in zip(f, places, values)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("depth"),
                 *(pa.array(columns[c], pa.int64()) for c in ("f1", "f2", "p1", "p2")),
                 batch.column("digest"), batch.column("words"),
                 pa.array([d == n for d, n in zip(got["depth"],
                                                  batch.column("length").to_pylist())], pa.bool_())],
                ["conv", "depth", "f1", "f2", "p1", "p2", "digest", "words", "last"])

    schema = ("conv long, depth long, f1 long, f2 long, p1 long, p2 long, digest binary, "
              "words long, last boolean")
    whole = convs.select(
        "conv", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("p1"),
        zero.alias("p2"), F.lit(b"").alias("digest"), zero.alias("words"),
        (F.col("length") == 0).alias("last"))
    return lent.unionByName(rest).mapInArrow(compose, schema).unionByName(whole)


# --- nodes ----------------------------------------------------------------------------------------


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and conversation: the ids of a node as lines of up to CHUNK."""
    names = [*NODE, "first", "ids"]
    key, ids, out = None, [], []

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if n == "ids" else pa.int64())
             for n, c in zip(names, zip(*rows))], names)

    for batch in batches:
        for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv"))):
            if ids and (node != key or len(ids) == CHUNK):
                out.append((*key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = node
            ids.append(conv)
        if len(out) >= 1000:
            yield batch_of(out)
            out = []
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
    if out:
        yield batch_of(out)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of those lines in order: the digest of each node's, a line at a time in memory."""
    names = [*NODE, "ends_sha256"]
    key, digest, out = None, None, []
    for batch in batches:
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if node != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if key:
        out.append((*key, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if n == "ends_sha256" else pa.int64())
             for n, c in zip(names, zip(*out))], names)


def ends(rows: DataFrame) -> DataFrame:
    """The digest of the ids of the conversations that end in each node. One digest is one pass
    over its ids; they come as few long lines."""
    by = [*NODE, "conv"]
    lines = rows.where("last").select(*by).repartitionByRange(*by).sortWithinPartitions(
        *by).mapInArrow(_joined_ids, "depth long, f1 long, f2 long, first long, ids string")
    return lines.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        _digested, "depth long, f1 long, f2 long, ends_sha256 string")


def chain_totals(chains: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` over each chain and all chains below it. ``chains`` has ``conv``, ``up``
    (the chain that it hangs on, null at the top) and the values. In round k each chain knows the
    sum up to a distance below 2^k, and hands it to the chain 2^k above."""
    now = chains
    while True:
        gained = now.where("up is not null").groupBy(F.col("up").alias("conv")).agg(
            *(F.sum(v).alias(f"more_{v}") for v in values))
        above = now.where("up is not null").select(F.col("conv").alias("up"),
                                                   F.col("up").alias("next"))
        after = stored(now.join(gained, "conv", "left").join(above, "up", "left").select(
            "conv", F.col("next").alias("up"),
            *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0).cast("long"))).alias(v)
              for v in values)), "chains")
        if now is not chains:
            spent(now)
        now = after
        if now.where("up is not null").isEmpty():
            return now


def below(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Sums of ``values`` from each node of a chain to the chain's end: sums of chunks of CHUNK
    depths first, then within chunks, so that a long chain is not one task's."""
    chunked = nodes.withColumn("chunk", F.floor(F.col("depth") / CHUNK))
    later = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(
        Window.unboundedPreceding, -1)
    within = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    sums = chunked.groupBy("conv_id", "chunk").agg(
        *(F.sum(v).alias(f"chunk_{v}") for v in values)
    ).select("conv_id", "chunk", *(F.coalesce(F.sum(f"chunk_{v}").over(later), F.lit(0)).alias(
        f"later_{v}") for v in values))
    return chunked.join(sums, ["conv_id", "chunk"]).select(
        *(c for c in nodes.columns if c not in values),
        *((F.sum(v).over(within) + F.col(f"later_{v}")).alias(v) for v in values))


def default_base(conv: Column) -> Column:
    return conv - conv % 20


def default_head(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")


def prefix_nodes(
    turns: DataFrame,
    conv: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    base_of=default_base,
    head_of=default_head,
    seed: int = 1,
    base_pairs=bases,
) -> DataFrame:
    """One row per distinct sequence of first turns: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``.

    ``base_of`` and ``head_of`` give, from the id, whose first turns a conversation begins with, and
    how many (0 to 3; its own as many first turns go). Turns go by ``order``, null first, ties by a
    digest of role and text; null role and text are empty. Repeated rows are turns of their own. Rows without an
    id are no conversation and take no part. Other columns are not looked at. An empty table gives
    an empty result, without a root.
    """
    tokens = ["n_leaves", "saved_tokens"]
    while True:
        base = base_pairs(seed)
        ordered = ordered_turns(turns, conv, order, role, text, base)
        rows = stored(rebuilt(ordered, base_of(F.col("conv")), head_of(F.col("conv")), base),
                      "rebuilt")
        one = F.struct("digest", "p1", "p2")
        found = stored(rows.groupBy(*NODE).agg(
            F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
            F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
            (F.min(one) == F.max(one)).alias("verified")), "nodes")
        if found.where("not verified").isEmpty():
            break
        spent(ordered, rows, found)
        seed += 1
    parent = [(F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2")]
    children = found.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")
    ).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    nodes = found.where("depth > 0").join(
        found.select(*parent, F.col("conv_id").alias("parent_conv_id")), ["depth", "p1", "p2"]
    ).unionByName(found.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    nodes = nodes.join(children, NODE, "left").join(ends(rows), NODE, "left")
    nodes = stored(nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "nodes")
    spent(ordered, rows, found)
    chains = stored(nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("up"),
        *(F.sum(v).alias(v) for v in tokens)), "chains")
    totals = chain_totals(
        chains.select(F.col("conv_id").alias("conv"), "up", *tokens), tokens)
    hung = chains.select(F.col("conv_id").alias("conv"), F.col("up").alias("conv_id"),
                         (F.col("top") - 1).alias("depth")).where("conv_id is not null")
    grafted = hung.join(totals.select("conv", *tokens), "conv").groupBy("conv_id", "depth").agg(
        *(F.sum(v).alias(f"hung_{v}") for v in tokens))
    whole = nodes.join(grafted, ["conv_id", "depth"], "left").select(
        *(c for c in nodes.columns if c not in tokens),
        *((F.col(v) + F.coalesce(f"hung_{v}", zero)).alias(v) for v in tokens))
    return below(whole, tokens).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256")
