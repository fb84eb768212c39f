"""Small scalar functions: number formats, rounding modes, clocks and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column, places: int = 0) -> Column:
    return F.format_number(c, places)


def percent(share: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(share * 100, places), F.lit("%"))


def money(c: Column, sign: str = "$") -> Column:
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit(sign), F.format_number(F.abs(c), 2))


def milliseconds(seconds: Column) -> Column:
    return F.concat(F.format_number(seconds * 1000, 0), F.lit(" ms"))


def seconds(c: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(c, places), F.lit("s"))


def half_up(c: Column, places: int = 2) -> Column:
    return F.round(c, places)


def half_even(c: Column, places: int = 2) -> Column:
    """Ties to the even neighbour, as data frames round."""
    return F.bround(c, places)


def iso_time(c: Column | None = None) -> Column:
    """A time (now by default) as ISO text in UTC; the session's zone is UTC."""
    return F.date_format(c if c is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stable_id(*keys: Column, length: int = 32) -> Column:
    """An id that the keys fix: a hash instead of a random UUID, so reruns agree."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[k.cast("string") for k in keys]), 256), 1, length)


def squares(*cs: Column) -> Column:
    out = cs[0] * cs[0]
    for c in cs[1:]:
        out = out + c * c
    return out

