"""Half-year periods written YYYY/1 or YYYY/2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD = r"^\p{Nd}{4}/[12]$"


def period_index(period: Column) -> Column:
    """year * 2 + half - 1; anything else than a period is an error, null stays null. Sort and compare by this alone."""
    checked = F.when(period.isNull() | period.rlike(PERIOD), period).otherwise(F.raise_error(F.concat(F.lit("not a period: "), period)).cast("string"))
    return F.substring(checked, 1, 4).cast("int") * 2 + F.substring(checked, 6, 1).cast("int") - 1


def is_period(period: Column) -> Column:
    return F.coalesce(period.rlike(PERIOD), F.lit(False))


def semester_difference(start: Column, end: Column) -> Column:
    return period_index(end) - period_index(start)


def format_period(year: Column, half: Column) -> Column:
    return F.concat_ws("/", year.cast("string"), half.cast("string"))
