"""Scalar scoring expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyscope.constants import RISK_SCALES


def mapped(col: Column, mapping: Mapping[str, float], default=None) -> Column:
    """Look a string up in a small constant map."""
    out = None
    for key, value in mapping.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(F.lit(default))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def risk_level(score: Column, scale: str = "utility") -> Column:
    medium, high, critical = RISK_SCALES[scale]
    return (
        F.when(score >= critical, "critical").when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
    )


def ratio(a: Column, b: Column) -> Column:
    """Division that gives null for a zero or missing divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; null for a constant side (``corr`` raises there in ANSI mode)."""
    both = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), both)


def flags(*pairs: tuple[Column, str]) -> Column:
    """Array of the texts whose condition is true, in the given order."""
    return F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]), lambda x: x.isNotNull())


def date_parts(ts: Column) -> dict[str, Column]:
    """Monday=0 weekday, hour, month, weekend and business-hours flags; 0, 12, 1 without a date."""
    weekday = F.coalesce(F.weekday(ts), F.lit(0))
    hour = F.coalesce(F.hour(ts), F.lit(12))
    return {
        "day_of_week": weekday,
        "hour": hour,
        "month": F.coalesce(F.month(ts), F.lit(1)),
        "is_weekend": weekday.isin(5, 6).cast("int"),
        "is_business_hours": hour.between(9, 17).cast("int"),
    }


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def clipped(text: Column, n: int, ellipsis: bool = True) -> Column:
    short = F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(short, F.lit("..."))).otherwise(text) if ellipsis else short


def title_case(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def elapsed_seconds(start: Column, end: Column, now: Column | None = None) -> Column:
    stop = F.coalesce(end, now if now is not None else F.current_timestamp())
    return (F.unix_micros(stop) - F.unix_micros(start)) / F.lit(1e6)


def sanitized(text: Column) -> Column:
    from tallyscope.constants import DANGEROUS_CHARACTERS

    return F.trim(F.translate(text, DANGEROUS_CHARACTERS, ""))
