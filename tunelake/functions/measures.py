"""Numeric expressions used across the models, as SQL text for ``selectExpr`` and ``F.expr``.

Doubles are divided by double literals throughout, so no measure turns into a decimal.
"""

from __future__ import annotations


def round_half(x: str, digits: int) -> str:
    """Round half away from zero by scaling. ``round(double, n)`` rounds the shortest decimal text
    instead, which differs on halves that a double cannot hold, and it goes through a decimal
    object per row; this stays primitive arithmetic."""
    scaled, scale = f"abs(({x}) * {10**digits}D)", f"{10**digits}D"
    up = f"cast({scaled} - floor({scaled}) >= 0.5D as int)"
    return f"sign({x}) * (floor({scaled}) + {up}) / {scale}"


def percent_played(ms_played: str, duration_ms: str) -> str:
    """Share of the track that was played, 0-100 with one decimal; NULL for a zero duration."""
    share = f"try_divide(cast({ms_played} as double), cast({duration_ms} as double)) * 100D"
    return round_half(share, 1)


def seconds(duration_ms: str) -> str:
    return round_half(f"cast({duration_ms} as double) / 1000D", 1)


def hours(total_ms: str) -> str:
    return f"{total_ms} / 1000D / 3600D"


def rate_pct(part: str, whole: str) -> str:
    return round_half(f"{part} * 100D / {whole}", 2)


def tenths(percent: str) -> str:
    """A one-decimal percentage as a whole number. Sums of these are exact, so an average does not
    depend on the order in which partitions or retried tasks arrive."""
    return f"cast(rint({percent} * 10D) as bigint)"


def mean_of_tenths(total: str, rows: str) -> str:
    return f"try_divide(cast({total} as double), {rows} * 10D)"


def matches(column: str, value: str, weight: str = "1") -> str:
    """``weight`` where the column holds ``value``, else 0."""
    return f"case when {column} = '{value}' then {weight} else 0 end"


def completed(ms_played: str, duration_ms: str) -> str:
    return f"{ms_played} >= {duration_ms} * 0.8D"


def skipped(ms_played: str, duration_ms: str) -> str:
    return f"{ms_played} < {duration_ms} * 0.3D"
