"""Small column expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often ``use`` names it: an expression is repeated wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fixed(x: Column | str, digits: int = 4) -> Column:
    """Half-up rounding by plain double arithmetic, so any engine can repeat it bit for bit."""
    scale = float(10**digits)
    return F.floor(col(x) * scale + 0.5).cast("double") / F.lit(scale)


def steady(x: Column | str, digits: int = 4) -> Column:
    """``fixed`` for sums and means: differences from the order of addition are rounded away first."""
    return fixed(fixed(x, 9), digits)


def trim_ws(x: Column | str) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def collapse_ws(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def is_blank(x: Column | str) -> Column:
    return ~F.coalesce(col(x).rlike(r"(?U)\S"), F.lit(False))


def falsy_or(x: Column, default: Column) -> Column:
    """``x or default`` for strings and numbers: null, '' and 0 give the default."""
    return F.when(x.isNotNull() & (x.cast("string") != "") & (x.cast("string") != "0") & (x.cast("string") != "0.0"), x).otherwise(default)


def round_half_up(x: Column) -> Column:
    """JavaScript rounding."""
    return F.floor(x + 0.5)
