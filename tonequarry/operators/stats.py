"""Descriptive statistics, winsorizing, agreement measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.functions.columns import clipped
from tonequarry.operators import selection


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, value)`` of several columns, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns)))
    return df.select(pairs.alias("x")).select("x.variable", "x.value")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: n, mean, median, sample deviation, least and largest of what isn't missing. ``df`` is made once."""
    with selection.stored(df.select(*(F.col(c).cast("double").alias(c) for c in columns))) as kept:
        rows = long_form(kept, columns).where("value IS NOT NULL AND NOT isnan(value)")
        rest = selection.saved(rows.groupBy("variable").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max")))
        half = selection.quantiles(kept, {c: F.col(c) for c in columns}, [0.5]).select("variable", F.col("cuts")[0].alias("median"))
    return rest.join(half, "variable").select("variable", "n", "mean", "median", "sd", "min", "max")


def quantiles(df: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(p, value)``. ``df`` is made once."""
    with selection.stored(df.select(F.col(column).cast("double").alias("x"))) as kept:
        found = selection.quantiles(kept, {"x": F.col("x")}, at).select(F.posexplode("cuts").alias("i", "value"))
    return found.select(F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("p"), "value")


def winsorize(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """Columns clipped to their quantiles, over all rows or within groups.

    The cuts are found by selection and joined back: one row, or one for each group, null ones too.
    """
    cuts = selection.quantiles(df, {c: F.col(c) for c in columns}, [low, high], by)
    at = "__cuts"
    cuts = cuts.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.map_from_entries(F.collect_list(F.struct("variable", "cuts"))).alias(at))
    if by:
        same = F.lit(True)
        for c in by:
            same = same & df[c].eqNullSafe(cuts[f"__{c}"])
        joined = df.join(cuts, same, "left")
    else:
        joined = df.join(F.broadcast(cuts), how="cross")  # one row
    held = lambda c: F.when(F.col(at)[c].isNotNull(), clipped(F.col(c), F.col(at)[c][0], F.col(at)[c][1])).otherwise(F.col(c))
    return joined.select(*(held(c).alias(c) if c in columns else F.col(c) for c in df.columns))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the rows that have a value, and their share in percent."""
    rows = long_form(df, columns)
    return rows.groupBy("variable").agg(F.count("value").alias("n"), F.try_divide(100.0 * F.count("value"), F.count("*")).alias("pct"))


def agreement(df: DataFrame, mine: str, theirs: str, near: Sequence[float] = (0.02, 0.05)) -> DataFrame:
    """Relative difference where the other figure is positive: mean, median and shares within bounds."""
    d = F.when(F.col(theirs) > 0, (F.col(mine) - F.col(theirs)) / F.col(theirs))
    rows = df.select(d.alias("d")).where("d IS NOT NULL")
    found = rows.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), *(F.avg((F.abs("d") <= x).cast("double")).alias(f"within_{round(100 * x)}") for x in near))
    both = found.crossJoin(F.broadcast(selection.median(rows, "d")))  # one row each
    return both.select("n", "mean", "median", *found.columns[2:])


def size_check(df: DataFrame, mine: str, theirs: str) -> DataFrame:
    """Ratios of sizes: how many are near one, far below and far above."""
    rows = df.where(F.col(theirs) > 0).select((F.col(mine) / F.col(theirs)).alias("r")).where("r IS NOT NULL")
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.col("r").between(0.95, 1.05)).alias("good"), F.count_if(F.col("r") < 0.5).alias("low"), F.count_if(F.col("r") > 1.5).alias("high"), F.avg("r").alias("mean"))
    return found.crossJoin(F.broadcast(selection.median(rows, "r"))).select("n", "good", "low", "high", "median", "mean")  # one row each


def funnel(df: DataFrame, flags: Sequence[str], all_rows: str = "all") -> DataFrame:
    """Rows left after each filter in order, from flag columns: one aggregation, whatever the number of filters."""
    kept, counts = F.lit(True), [F.count("*").alias("c0")]
    for i, f in enumerate(flags, 1):
        kept = kept & F.coalesce(F.col(f), F.lit(False))
        counts.append(F.count_if(kept).alias(f"c{i}"))
    steps = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("filter"), F.col(f"c{i}").alias("n")) for i, n in enumerate([all_rows, *flags])))
    return df.agg(*counts).select(F.explode(steps).alias("x")).select("x.step", "x.filter", "x.n")
