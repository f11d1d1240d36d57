"""Left lookups from a large fact to a dimension, safe against hot keys.

A dimension made from tables that together stay under ``spark.sql.autoBroadcastJoinThreshold`` is
broadcast, and the fact does not shuffle. Any other dimension is joined through a shuffle in which
hot keys are salted: a key holding the share f of the fact is spread over f * ``HOT_SHARE`` parts,
and its one dimension row is repeated for each. So no part is larger than 1/``HOT_SHARE`` of the
fact, and all repeated dimension rows together are at most twice ``HOT_SHARE``, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.session import checkpoint_root

HOT_SHARE = 20_000
#: Groups of keys that are counted first, to find where a hot key can be.
KEY_GROUPS = 65_536
#: What a key takes in a broadcast besides its own bytes, about.
ROW_BYTES = 32


def fits_broadcast(dim: DataFrame) -> bool:
    """True if the tables that ``dim`` is made from are together small enough to broadcast by the
    session's threshold. (A join's own estimate is the product of its sides, which says nothing
    about a lookup on a unique key.)"""
    conf = dim.sparkSession._jsparkSession.sessionState().conf()
    leaves = dim._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size <= conf.autoBroadcastJoinThreshold()


def hot_keys(fact: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys holding at least 1/``share`` of the fact, and the number of parts to spread each over:
    at most ``share`` rows. Groups of keys, by hash, are counted first, which shuffles at most
    ``KEY_GROUPS`` rows per task, however many keys there are. Only the keys of a group that holds
    that much itself can be hot: these are counted one by one."""
    keyed = fact.where(f"{key} is not null").select(
        key, F.expr(f"pmod(xxhash64({key}), {KEY_GROUPS})").alias("__group"))
    groups = keyed.groupBy("__group").agg(F.expr("count(*) as n"))
    weight, total = F.expr(f"n * {share}"), groups.agg(F.expr("sum(n)")).scalar()
    full = groups.where(weight >= total).select("__group")
    counts = keyed.join(F.broadcast(full), "__group", "left_semi").groupBy(key).agg(
        F.expr("count(*) as n"))
    return counts.where(weight >= total).select(
        F.col(key).alias("__hot_key"), F.ceil(weight / total).cast("int").alias("__parts")
    )


def in_parts(fact: DataFrame, hot: DataFrame, key: str, spread: str) -> DataFrame:
    """``fact`` with ``__part``, which deals the rows of each key that ``hot_keys`` gave over its parts,
    by a hash of ``spread``, and those without a key over all."""
    return fact.join(hot, F.expr(f"{key} = __hot_key"), "left").withColumn(
        "__part",
        F.expr(f"""case when {key} is null then pmod(xxhash64({spread}), {HOT_SHARE})
                        when __parts is null then 0
                        else pmod(xxhash64({spread}), __parts) end"""),
    ).drop("__hot_key", "__parts")


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    spread: str | None = None,
    keys_of: DataFrame | None = None,
) -> DataFrame:
    """``fact LEFT JOIN dim USING key``, with the key column taken from ``dim``: it is NULL where
    the dimension has no such row. ``key`` must be unique in ``dim``.

    ``spread`` names a column, or several with commas, that vary among the fact's rows of one key;
    it is used to salt hot keys. Leave it out for a fact already reduced to few rows per key. Which keys are hot is
    counted in ``keys_of``, by default the fact itself; a fact made by joins should name the plain
    table it comes from.
    """
    attributes = [c for c in dim.columns if c != key]
    clash = set(fact.columns) & set(attributes)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    output = [*(c for c in fact.columns if c != key), f"__dim_key as {key}", *attributes]
    small = fits_broadcast(dim)
    dim = dim.withColumnRenamed(key, "__dim_key")

    if small or spread is None:
        dim = F.broadcast(dim) if small else dim
        return fact.join(dim, F.expr(f"{key} = __dim_key"), "left").selectExpr(*output)

    hot = F.broadcast(hot_keys(fact if keys_of is None else keys_of, key))
    salted = in_parts(fact, hot, key, spread)
    repeated = dim.join(hot, F.expr("__dim_key = __hot_key"), "left").selectExpr(
        "__dim_key", *attributes,
        "explode(sequence(0L, coalesce(__parts, 1) - 1L)) as __dim_part",
    )
    return salted.join(
        repeated, F.expr(f"{key} = __dim_key and __part = __dim_part"), "left"
    ).selectExpr(*output)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent row, with the number of child rows each. Keys are counted
    before the join, so a hot key travels as one row per task. NULL keys are not orphans."""
    counts = (
        child.where(f"{child_key} is not null").groupBy(child_key)
        .agg(F.expr("count(*) as n_rows"))
    )
    known = parent.selectExpr(f"{parent_key} as __parent")
    return counts.join(known, F.expr(f"{child_key} = __parent"), "left_anti")


def known_key(fact: DataFrame, dim: DataFrame, key: str, spread: str) -> DataFrame:
    """``fact`` with ``key`` set to NULL where ``dim`` has no such row.

    With a dimension too large to broadcast, it first finds the fact's orphan keys: usually none,
    as the data tests ask for, and then the fact needs no join. They are written to the shared
    folder and broadcast if they are small by the session's threshold; otherwise the fact shuffles.
    """
    keys = dim.select(key)
    if not fits_broadcast(keys):
        checkpoint_root(fact.sparkSession)
        strays = orphans(fact, dim, key, key).selectExpr(f"{key} as __stray").checkpoint()
        size = f"coalesce(sum(octet_length(cast(__stray as string)) + {ROW_BYTES}), 0)"
        n_bytes = strays.agg(F.expr(size)).first()[0]
        if not n_bytes:
            return fact
        conf = fact.sparkSession._jsparkSession.sessionState().conf()
        if n_bytes <= conf.autoBroadcastJoinThreshold():
            marked = fact.join(F.broadcast(strays), F.expr(f"{key} = __stray"), "left")
            return marked.selectExpr(
                *(f"if(__stray is null, {c}, null) as {c}" if c == key else c
                  for c in fact.columns)
            )
    return lookup(fact, keys, key, spread).select(*fact.columns)
