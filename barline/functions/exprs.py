"""Column helpers: rounding, safe ratios, windows by ticker."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int) -> Column:
    """Round the scaled binary value half away from zero; null for NaN and infinities."""
    x = col(c).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.round(x * 10.0**digits) / 10.0**digits)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or either is null."""
    b = col(b).cast("double")
    return F.when(b != 0, col(a).cast("double") / b)


def change(a: Column | str, b: Column | str) -> Column:
    """a / b - 1, null where b is zero."""
    return ratio(a, b) - 1


def pct(c: Column | str) -> Column:
    return rnd(col(c) * 100, 2)


def by_date(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("date")


def chain(pairs: list[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(table: dict, key: Column | str, default: object = None) -> Column:
    """Value of a small fixed table at key."""
    key = col(key)
    return chain([(key == k, v) for k, v in table.items()], default)
