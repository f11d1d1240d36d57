"""Landed JSON pages: each record of a file is one page ``{data: [...], page, …}``."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.schemas import EVENTS, LINEAGE, PRIMARY_KEY, RAW, envelope
from tunelake.session import scratch_path


def typed(records: DataFrame, table: str) -> DataFrame:
    """Landed records with the raw table's types and its lineage columns, which stay NULL."""
    present = set(records.columns)
    return records.selectExpr(*(
        f"cast({f.name if f.name in present else 'null'} as {f.dataType.simpleString()})"
        f" as {f.name}"
        for f in RAW[table].fields
    ))


def landed_pages(
    spark: SparkSession,
    path: str,
    table: str,
    days: Iterable[date] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """The pages below ``path``; of events, which land in a folder per day, only those of ``days``
    are opened. A malformed page stops the load."""
    reader = spark.read.schema(envelope(table)).option("mode", "FAILFAST")
    reader = reader.option("multiLine", multiline)
    if days is None:
        return reader.json(path)
    folders = [f"{path}/date={day.isoformat()}" for day in days]
    return reader.option("basePath", path).json(folders)


def page_facts(pages: DataFrame) -> DataFrame:
    """What a page says of itself, without its records; -1 records if it has no ``data``."""
    return pages.selectExpr(
        "date", "page", "coalesce(size(data), -1) as records", "total", "has_more")


def incomplete(facts: DataFrame, table: str) -> DataFrame:
    """What is missing or wrong, one row per table or, for events, per day: a page without ``data``,
    a gap between pages, a last page that says there are more, or a number of records that isn't
    the announced ``total``. A page of a dimension must not occur twice; one of events may."""
    each = facts.groupBy("date", "page").agg(
        F.expr("max(records) as n"), F.expr("min(records) as low"),
        F.expr("count(*) as copies"), F.expr("max(total) as total"),
        F.expr("min(total) as least"), F.expr("bool_or(coalesce(has_more, true)) as more"),
    )
    groups = each.groupBy("date").agg(
        F.expr("count_if(low < 0 or low <> n or page is null) as bad"),
        F.expr("max(page) - min(page) + 1 - count(page) as gaps"),
        F.expr("count_if(not more) as ends"), F.expr("max_by(more, page) as goes_on"),
        F.expr("sum(n) as records"), F.expr("max(total) as total"),
        F.expr("min(least) as least"), F.expr("max(copies) as copies"),
    )
    repeated = "false" if table == EVENTS else "copies > 1"
    return groups.where(
        f"bad > 0 or gaps <> 0 or ends <> 1 or goes_on or total is null or total <> least "
        f"or records <> total or {repeated}"
    )


def read_pages(
    spark: SparkSession,
    path: str,
    table: str,
    days: Iterable[date] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """All records of all pages below ``path``, or of those of ``days``. The pages are parsed once,
    into the shared folder, and have to be complete: otherwise, or if a day has no pages at all,
    there is an error and no frame."""
    days = None if days is None else list(days)
    pages = landed_pages(spark, path, table, days, multiline)
    copy = scratch_path(spark, "pages")
    pages.write.parquet(copy)
    pages = spark.read.schema(pages.schema).parquet(copy)
    wrong = incomplete(page_facts(pages), table).limit(5).collect()
    if days is not None:
        # No more than the days asked for.
        found = {str(r[0]) for r in pages.select("date").distinct().collect()}
        absent = sorted({day.isoformat() for day in days} - found)
        if absent:
            raise ValueError(f"the pages of {table} below {path} lack the days {absent}")
    if wrong or (days is None and pages.isEmpty()):
        raise ValueError(f"the pages of {table} below {path} are not complete: {wrong or 'none'}")
    return typed(pages.selectExpr("inline(data)"), table)


def extra_fields(
    spark: SparkSession,
    path: str,
    table: str,
    days: Iterable[date] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Fields of landed records that the table's schema lacks: ``date`` (the folder, NULL without
    one), ``key`` (the record's primary key), ``field`` and ``value``, a variant. The text is read
    without a schema, so nothing of a record is lost."""
    reader = spark.read.option("wholetext", multiline)
    if days is None:
        text = reader.text(path)
    else:
        folders = [f"{path}/date={day.isoformat()}" for day in days]
        text = reader.option("basePath", path).text(folders)
    day = "cast(date as string)" if "date" in text.columns else "cast(null as string)"
    known = ", ".join(f"'{f.name}'" for f in RAW[table].fields if f.name not in LINEAGE)
    return text.where("trim(value) <> ''").selectExpr(
        f"{day} as date",
        "explode(variant_get(parse_json(value), '$.data', 'array<map<string, variant>>')) as record",
    ).selectExpr(
        "date", f"cast(record['{PRIMARY_KEY[table]}'] as string) as key",
        f"explode(map_filter(record, (k, v) -> k not in ({known}))) as (field, value)",
    )


def field_types(extra: DataFrame) -> DataFrame:
    """field, type, records: the type that fits all values of a field, and how many records have it."""
    return extra.groupBy("field").agg(
        F.expr("schema_of_variant_agg(value) as type"), F.expr("count(*) as records"))


def stream_pages(spark: SparkSession, path: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """The records of the pages that arrive below ``path``, as a stream. A page without ``data``
    stops it; whether pages are missing is not looked at (see ``merge_complete_days`` for that)."""
    reader = spark.readStream.schema(envelope(table)).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    data = "coalesce(data, raise_error('a landed page has no data'))"
    return typed(reader.json(path).selectExpr(f"inline({data})"), table)


def write_pages(
    records: DataFrame,
    path: str,
    page: str,
    page_size: int,
    day: str | None = None,
    days: Iterable[date] = (),
) -> None:
    """Land records as pages. ``page`` is an expression that puts each record on a page (pages are
    numbered anew, from 0); more than ``page_size`` records on one are an error, which bounds a group.
    With ``day``, an expression for the record's day, each day has a folder and pages of its own;
    those of ``days`` that have no records get an empty page."""
    iso = {"timestamp_ntz": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "date": "yyyy-MM-dd"}
    fields = ", ".join(
        f'date_format({name}, "{iso[kind]}") as {name}' if kind in iso else name
        for name, kind in records.dtypes
    )
    group = f"cast(cast({day} as date) as string)" if day else "cast(null as string)"
    rows = records.selectExpr(
        f"{group} as date", f"cast({page} as int) as page", f"struct({fields}) as record")
    pages = rows.groupBy("date", "page").agg(F.collect_list("record").alias("data"))
    # One line per page: its number, and what its table or day has in all.
    of_day = "over (partition by date order by page)"
    whole = "over (partition by date)"
    numbers = rows.groupBy("date", "page").agg(F.expr("count(*) as n")).selectExpr(
        "date as d", "page as p", f"row_number() {of_day} - 1 as number",
        f"cast(sum(n) {whole} as int) as total", f"count(*) {whole} as pages")
    too_many = f"concat('page ', page, ' has more than {page_size} records')"
    pages = pages.join(numbers, F.expr("date <=> d and page <=> p")).selectExpr(
        "date",
        f"if(size(data) <= {page_size}, data, raise_error({too_many})) as data",
        "number as page", f"{page_size} as page_size", "total", "number + 1 < pages as has_more",
    )
    if days:
        spark = records.sparkSession
        empty = spark.createDataFrame([(d.isoformat(),) for d in days], "date string").join(
            numbers.selectExpr("d as date"), "date", "left_anti").selectExpr(
            "date", f"cast(array() as {pages.schema['data'].dataType.simpleString()}) as data",
            "0 as page", f"{page_size} as page_size", "0 as total", "false as has_more")
        pages = pages.unionByName(empty)
    if day:
        pages.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").json(path)
    else:
        pages.drop("date").write.mode("overwrite").json(path)
