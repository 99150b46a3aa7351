"""Row-level relational operators: deduplication by a total order, sets, samples, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by a total order; Spark drops later rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str], total: str = "TOTAL") -> DataFrame:
    """Counts by two columns, absent pairs being zero, with row totals; the values are named, so one job is enough."""
    wide = df.groupBy(row).pivot(column, list(values)).count().na.fill(0, list(values))
    return wide.withColumn(total, sum((F.col(v) for v in values), F.lit(0)))


def coverage(mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Sizes of two key sets, of what they share and what only one has, and the share of theirs found: one pass."""
    both = mine.select(key).distinct().withColumn("a", F.lit(1)).join(theirs.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    counts = both.agg(F.count_if(a).alias("n_mine"), F.count_if(b).alias("n_theirs"), F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("only_mine"), F.count_if(b & ~a).alias("only_theirs"))
    return counts.withColumn("recall_pct", F.round(F.try_divide(100.0 * F.col("n_both"), F.col("n_theirs")), 6))


def breakdown(mine: DataFrame, theirs: DataFrame, by: str) -> DataFrame:
    """Counts of both sides by a column, absent ones being zero, and their difference."""
    both = count_by(mine, by, "mine").join(count_by(theirs, by, "theirs"), by, "full_outer").na.fill(0, ["mine", "theirs"])
    return both.withColumn("diff", F.col("mine") - F.col("theirs"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum, by a seeded hash of the key."""
    return first_by(df, [stratum], [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], n)


def upsert(state: DataFrame, changes: DataFrame, key: str, keep: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The state after changes: the latest change of a key replaces its row, but for the columns in ``keep``."""
    latest = first_by(changes, [key], order)
    fixed = state.select(key, *(F.col(c).alias(f"__{c}") for c in keep))
    renewed = latest.join(fixed, key, "left").select(*((F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in keep else F.col(c)) for c in state.columns))
    return state.join(latest.select(key), key, "left_anti").select(*state.columns).unionByName(renewed)
