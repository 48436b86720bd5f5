"""Scalars: coercion, times, sanitising, hash-derived numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal notation only: Spark's cast alone would take "1d" for 1.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(c: Column, kind: str = "string") -> Column:
    """c as a double; text that is no finite number is null. kind: c's type; what is a number needn't go through text."""
    if kind in ("double", "bigint", "int", "smallint", "tinyint") or kind.startswith("decimal"):
        value = c.cast("double")
        return F.when(F.abs(value) < float("inf"), value)  # NaN is the greatest of all
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def timestamp(c: Column, formats: tuple[str, ...]) -> Column:
    """c as a timestamp, by the first format that fits; null if none does."""
    text = c.cast("string")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def category(c: Column, unknown: str = "UNKNOWN") -> Column:
    return F.coalesce(c.cast("string"), F.lit(unknown))


def account(c: Column, missing: str | None = "nan") -> Column:
    return c.cast("string") if missing is None else F.coalesce(c.cast("string"), F.lit(missing))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with their fraction."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def time_parts(ts: Column) -> dict[str, Column]:
    """Hour, day of the week (Monday is 0) and day of the month; of no time 0, 0 and 1."""
    return {
        "hour": F.coalesce(F.hour(ts), F.lit(0)).cast("double"),
        "dow": F.coalesce(F.weekday(ts), F.lit(0)).cast("double"),
        "dom": F.coalesce(F.day(ts), F.lit(1)).cast("double"),
    }


def finite(c: Column) -> Column:
    """c, or 0 where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def hash_unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first eight hex digits of md5(parts, joined by |): the same in every engine."""
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def inverse_sqrt(degree: Column) -> Column:
    return F.when(degree > 0, 1 / F.sqrt(degree.cast("double"))).otherwise(F.lit(0.0))
