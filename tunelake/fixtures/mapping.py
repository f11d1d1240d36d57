"""The supplied TPC-H-like tables read as raw listening tables.

Two event facts share the same dimensions: ``events`` (one row per event) and, for volume,
``lineitem`` with its order. Parts play the tracks, brands the artists, (brand, size) the albums and
customers the users. Ids keep their type; the models do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunelake.functions.measures import completed, skipped
from tunelake.operators.lookups import hot_keys, lookup
from tunelake.plans.staging import stage
from tunelake.schemas import AGE_GROUPS, DEVICE_TYPES

# What stands for a platform, a device and a subscription. MACHINERY stays outside
# the accepted subscriptions, so the data tests have something to find.
EVENT_PLATFORM = {
    "click": "ios", "view": "android", "purchase": "web", "signup": "chromecast", "error": "alexa",
}
FLAG_PLATFORM = {"A": "ios", "N": "android", "R": "web"}
STATUS_DEVICE = {"O": "mobile", "F": "desktop"}
SEGMENT_SUBSCRIPTION = {
    "AUTOMOBILE": "free", "BUILDING": "premium", "FURNITURE": "family", "HOUSEHOLD": "student",
}
EVENT_DURATION_MS, LINE_DURATION_MS = 100_000, 50_000

_LONG, _STR, _INT, _DBL, _TS = (
    T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType(),
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TABLES = {
    "region": _schema(r_regionkey=_INT, r_name=_STR),
    "nation": _schema(n_nationkey=_INT, n_name=_STR, n_regionkey=_INT),
    "customer": _schema(
        c_custkey=_LONG, c_name=_STR, c_nationkey=_INT, c_acctbal=_DBL, c_mktsegment=_STR),
    "supplier": _schema(s_suppkey=_LONG, s_name=_STR, s_nationkey=_INT, s_acctbal=_DBL),
    "part": _schema(
        p_partkey=_LONG, p_name=_STR, p_brand=_STR, p_type=_STR, p_size=_INT, p_retailprice=_DBL),
    "orders": _schema(
        o_orderkey=_LONG, o_custkey=_LONG, o_orderstatus=_STR, o_totalprice=_DBL, o_orderdate=_TS,
        o_orderpriority=_STR),
    "lineitem": _schema(
        l_orderkey=_LONG, l_partkey=_LONG, l_suppkey=_LONG, l_linenumber=_INT, l_quantity=_DBL,
        l_extendedprice=_DBL, l_discount=_DBL, l_tax=_DBL, l_returnflag=_STR, l_linestatus=_STR,
        l_shipdate=_TS),
    "events": _schema(
        event_id=_LONG, ts=_TS, user_id=_LONG, event_type=_STR, value=_DBL, props=_STR),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _translate(column: str, names: dict[str, str]) -> str:
    cases = " ".join(f"when '{value}' then '{name}'" for value, name in names.items())
    return f"case {column} {cases} else lower({column}) end"


def _pick(values: list[str], index: str) -> str:
    choices = ", ".join(f"'{value}'" for value in values)
    return f"element_at(array({choices}), cast({index} % {len(values)} + 1 as int))"


def _plays(df: DataFrame, played_seconds: str, duration_ms: int, **columns: str) -> DataFrame:
    """Add the raw columns that follow from the seconds played, and the given ones."""
    return df.selectExpr(
        *(f"{sql} as {name}" for name, sql in columns.items()),
        f"cast(rint({played_seconds} * 1000) as int) as ms_played",
        f"{duration_ms} as track_duration_ms",
    ).selectExpr(
        "*",
        f"{completed('ms_played', 'track_duration_ms')} as completed",
        f"{skipped('ms_played', 'track_duration_ms')} as skipped",
    )


def stream_events(events: DataFrame) -> DataFrame:
    """``events`` as the raw event table: ``value`` is seconds played of a 100-second track."""
    return _plays(
        events, "value", EVENT_DURATION_MS,
        event_id="event_id",
        user_id="user_id",
        # props is {"k": n}; a pattern reads it several times faster than a JSON parser.
        track_id="""try_cast(regexp_extract(props, '"k" *: *([0-9]+)', 1) as bigint)""",
        started_at="ts",
        device_type=_pick(DEVICE_TYPES, "event_id"),
        platform=_translate("event_type", EVENT_PLATFORM),
        shuffle_mode="event_id % 5 < 2",
        offline_mode="event_id % 20 = 0",
    )


def line_events(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """``lineitem`` with its order as the raw event table: quantity is seconds of a 50-second
    track. Line keys repeat in the data, so this fact has no usable primary key."""
    order = orders.selectExpr("o_orderkey as l_orderkey", "o_custkey", "o_orderdate")
    # What a line alone tells is worked out before the lookup: less to carry than what it is made of.
    facts = lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        "l_tax > 0.04D as shuffle_mode", "l_discount = 0D as offline_mode",
        f"{_translate('l_linestatus', STATUS_DEVICE)} as device_type",
        f"{_translate('l_returnflag', FLAG_PLATFORM)} as platform",
        "l_suppkey", "l_extendedprice", "l_shipdate",
    )
    lines = lookup(
        facts, order, "l_orderkey",
        spread="l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate",
        keys_of=lineitem,
    )
    return _plays(
        lines.where("l_orderkey is not null"), "l_quantity", LINE_DURATION_MS,
        event_id="concat_ws('-', l_orderkey, l_linenumber)",
        user_id="o_custkey",
        track_id="l_partkey",
        started_at="o_orderdate",
        device_type="device_type",
        platform="platform",
        shuffle_mode="shuffle_mode",
        offline_mode="offline_mode",
    )


def line_keys(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables that tell which keys of the line events are hot, without joining all lines with their
    orders. A user's orders stand for the lines, except that an order with very many lines
    (a hot key itself) counts with each of them."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    owners = orders.join(
        F.broadcast(hot_keys(lineitem, "l_orderkey")), F.expr("o_orderkey = __hot_key"))
    long_orders = lineitem.join(
        F.broadcast(owners.select("o_orderkey", "o_custkey")), F.expr("l_orderkey = o_orderkey"))
    of_orders = orders.selectExpr("o_custkey as user_id")
    return {
        "track_id": lineitem.selectExpr("l_partkey as track_id"),
        "user_id": of_orders.unionByName(long_orders.selectExpr("o_custkey as user_id")),
    }


def users(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey as user_id",
        "c_name as username",
        "concat(lower(c_name), '@example.com') as email",
        "cast(c_nationkey as string) as country",
        f"{_translate('c_mktsegment', SEGMENT_SUBSCRIPTION)} as subscription_type",
        f"{_pick(AGE_GROUPS, 'c_custkey')} as age_group",
        "date_add(date'2023-01-01', cast(c_custkey % 365 as int)) as joined_at",
        "cast(c_custkey % 1000000 + 1 as int) as popularity_rank",
    )


def tracks(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey as track_id",
        "p_name as title",
        "p_brand as artist_id",
        "concat_ws('-', p_brand, p_size) as album_id",
        "cast(rint(p_retailprice * 100) as int) as duration_ms",
        "p_type as genre",
        "cast(2000 + p_partkey % 26 as int) as release_year",
        "p_partkey % 7 = 0 as explicit",
        "p_size + 60 as tempo_bpm",
        "p_size / 50D as energy_score",
        "cast(p_partkey % 1000000 + 1 as int) as popularity_rank",
    )


def artists(part: DataFrame) -> DataFrame:
    return part.groupBy("p_brand").agg(
        F.expr("count(*) as n"), F.expr("min(p_partkey) as first"), F.expr("min(p_type) as genre")
    ).selectExpr(
        "p_brand as artist_id",
        "p_brand as name",
        "genre",
        "cast(n % 25 as string) as country",
        "cast(n as int) as monthly_listeners",
        "date_add(date'2015-01-01', cast(first % 3650 as int)) as created_at",
        "cast(substring(p_brand, 7) as int) as popularity_rank",
    )


def albums(part: DataFrame) -> DataFrame:
    return part.groupBy("p_brand", "p_size").agg(
        F.expr("cast(count(*) as int) as num_tracks"), F.expr("min(p_type) as genre")
    ).selectExpr(
        "concat_ws('-', p_brand, p_size) as album_id",
        "concat('Album ', p_size) as title",
        "p_brand as artist_id",
        "date_add(date'2000-01-01', p_size) as release_date",
        "num_tracks",
        "genre",
    )


RAW_TABLES = {
    "artists": (artists, ["part"]),
    "albums": (albums, ["part"]),
    "tracks": (tracks, ["part"]),
    "users": (users, ["customer"]),
    "stream_events": (stream_events, ["events"]),
}


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    build, sources = RAW_TABLES[name]
    return build(*(table(spark, sf_dir, source) for source in sources))


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five raw tables, with ``events`` as the event fact."""
    return {name: raw_table(spark, sf_dir, name) for name in RAW_TABLES}


def staged(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Staged models over the raw tables, or over the named ones."""
    return stage({name: raw_table(spark, sf_dir, name) for name in names or RAW_TABLES})


def staged_lines(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Staged models with ``lineitem`` as the event fact. The joined fact isn't stored: each reduction
    takes a few of its columns, and reading those is less work than writing all."""
    lines = line_events(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    others = [name for name in names or RAW_TABLES if name != "stream_events"]
    raw = {name: raw_table(spark, sf_dir, name) for name in others}
    return stage(raw | {"stream_events": lines})
