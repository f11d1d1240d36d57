"""Data tests. A test is a query for failing rows; it passes when there are none.

The ``*_failures`` functions return those rows, :func:`outcome` counts them, and
:func:`column_checks` counts the NULLs and strange values of many columns in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tunelake.operators.lookups import orphans


def duplicate_failures(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number; NULLs are ignored."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.expr("count(*) as n_rows"))
    return counts.where("n_rows > 1")


def orphan_failures(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Keys without a parent row, with their number of child rows; NULLs are ignored."""
    return orphans(child, parent, column, field)


def range_failures(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows outside [low, high]; NULLs are ignored."""
    return df.where(out_of_range(column, low, high))


def out_of_range(column: str, low: float, high: float) -> str:
    return f"{column} < {low} or {column} > {high}"


def value_conditions(not_null: list[str], accepted: dict[str, list[str]]) -> list[tuple]:
    """(column, test, condition of a failing row) of checks of single values."""
    return [(c, "not_null", f"{c} is null") for c in not_null] + [
        (c, "accepted_values", f"{c} not in ({', '.join(map(repr, values))})")
        for c, values in accepted.items()
    ]


class Watched:
    """A frame that counts its failing rows while it is written, so that the tests need no scan of
    their own. ``conditions`` are (column, test, condition of a failing row).

    Spark may count the rows of a task again that it has to repeat. Where nothing fails the count
    is nought all the same; a count above that is only a sign to look (see ``failing``)."""

    def __init__(self, df: DataFrame, conditions: list[tuple]):
        self.conditions = conditions
        self._seen = Observation()
        counts = [F.count_if(F.expr(failed)).alias(f"n{i}")
                  for i, (_, _, failed) in enumerate(conditions)]
        self.df = df.observe(self._seen, *counts) if conditions else df

    def failing(self) -> list[tuple]:
        """(column, test) of the conditions that a row met. To be asked once the frame is written."""
        counts = self._seen.get if self.conditions else {}
        # A frame known to be empty is not executed, and nothing is counted.
        return [(c, test) for i, (c, test, _) in enumerate(self.conditions) if counts.get(f"n{i}")]


def group_sum_failures(
    df: DataFrame, group: str, column: str, low: float, high: float
) -> DataFrame:
    """Groups whose total, rounded to a whole number, is outside [low, high]."""
    totals = df.groupBy(group).agg(F.expr(f"round(sum({column}), 0) as total"))
    return totals.where(f"total not between {low} and {high}")


def outcome(failures: DataFrame, column: str, test: str, count: str = "count(*)") -> DataFrame:
    """One row (column, test, n_failed)."""
    return failures.agg(F.expr(f"cast(coalesce({count}, 0) as bigint) as n_failed")).selectExpr(
        f"'{column}' as column", f"'{test}' as test", "n_failed"
    )


def column_checks(
    df: DataFrame, not_null: list[str], accepted: dict[str, list[str]]
) -> DataFrame:
    """One row (column, test, n_failed) per check, from a single pass over the frame: the number of
    NULLs, and the number of different values outside a list (NULLs are ignored there). Only what
    fails leaves a task, counted per value."""
    checks = [(c, test, failed, c if test == "accepted_values" else "null")
              for c, test, failed in value_conditions(not_null, accepted)]
    # An explode per row only of what fails; a check is known by its number.
    rows = ", ".join(
        f"if({failed}, struct({i} as check, cast({value} as string) as value), null)"
        for i, (_, _, failed, value) in enumerate(checks)
    )
    per_value = df.selectExpr(f"explode(array_compact(array({rows}))) as f").groupBy(
        "f.check", "f.value").agg(F.expr("count(*) as n"))
    counts = per_value.groupBy("check").agg(
        F.expr("sum(n) as n_rows"), F.expr("count(value) as n_values"))
    names = ", ".join(f"struct({i} as check, '{c}' as column, '{t}' as test)"
                      for i, (c, t, _, _) in enumerate(checks))
    known = df.sparkSession.range(1).selectExpr(f"inline(array({names}))")
    return known.join(counts, "check", "left").selectExpr(
        "column", "test",
        "coalesce(if(test = 'not_null', n_rows, n_values), 0) as n_failed",
    )


def suite(results: dict[str, list[DataFrame]]) -> DataFrame:
    """All results as (model, column, test, n_failed, passed)."""
    frames = [
        frame.selectExpr(f"'{model}' as model", "*", "n_failed = 0 as passed")
        for model, frames in results.items()
        for frame in frames
    ]
    return reduce(DataFrame.unionByName, frames)
