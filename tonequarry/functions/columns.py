"""Column functions that keep pandas' rules for missing values: NaN and infinity become null at every boundary."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_if_not_finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinity as nulls in all floating columns: the boundary of every reader and writer."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*(null_if_not_finite(F.col(n)).alias(n) if n in floating else F.col(n) for n in df.columns))


def label(code: Column, names: Mapping, default: str | None = None) -> Column:
    """A code's name from a fixed mapping, or the default."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    found = F.create_map(*pairs)[code]
    return F.coalesce(found, F.lit(default)) if default is not None else found


def at_least(c: Column, least: float) -> Column:
    """Clipped from below; a null stays null (greatest() alone would give the bound)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(least).cast("double")))


def clipped(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is zero: pandas' infinity, which no later step keeps."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return F.try_divide(F.lit(100.0) * a, b.cast("double"))


def log_floor(c: Column, least: float) -> Column:
    return F.log(at_least(c, least))


def number(c: Column) -> Column:
    return c.try_cast("double")


def to_date(c: Column, pattern: str | None = None) -> Column:
    return F.try_to_date(c, pattern) if pattern else c.try_cast("date")


def month_start(d: Column) -> Column:
    return F.trunc(d, "MONTH")


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "QUARTER")


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "QUARTER"), 2))


def previous_quarter_end(d: Column) -> Column:
    """The last day of the quarter before that of the date, even for a quarter's last day."""
    return F.date_sub(F.trunc(d, "QUARTER"), 1)


def ends_quarter(d: Column) -> Column:
    return F.month(d).isin(3, 6, 9, 12)


def accession_of(filename: Column) -> Column:
    return F.nullif(F.regexp_extract(filename, r"(\d{10}-\d{2}-\d{6})", 1), F.lit(""))


def normal_p(t: float) -> float:
    """Two-sided, of a t statistic under the normal distribution."""
    return math.erfc(abs(t) / math.sqrt(2))
