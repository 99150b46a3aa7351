"""Links between entities: interval joins, nearest-year joins, as-of joins and range lookups, all as equi-joins."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonequarry.operators.rows import first_by


def valid_on(left: DataFrame, history: DataFrame, on: str, date: str, start: str, end: str, conditions: Column | None = None, open_end: str = "2099-12-31", how: str = "left") -> DataFrame:
    """Interval-valid attributes: an equi-join whose condition also holds the date range and further conditions.

    The conditions stand in the join, so unmatched rows survive; an open end stands for a fixed far day.
    """
    h = history.withColumnRenamed(on, "__on")
    inside = (left[on] == h["__on"]) & (left[date] >= h[start]) & (left[date] <= F.coalesce(h[end], F.lit(open_end).cast("date")))
    return left.join(h, inside if conditions is None else inside & conditions, how).drop("__on")


#: Days of a bucket of time: what hot keys are split by.
BUCKET_DAYS = 366


def day_number(c: Column) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def last_before(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, payload: Sequence[str], reach: int, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """``left`` with ``name``: the struct of ``payload`` of the latest right row of the same key, at or before its day.

    It is looked for in the row's own bucket of ``reach`` days and the one before: a row at most ``reach`` days earlier is
    found, an older one perhaps. Rows of both sides are dealt by (key, bucket) together and sorted; each left row takes
    what the last right row before it says: nothing is joined, and no match is listed before the choice. Left rows
    without a key or day stay, with null. Of right rows of one day the last by ``ties`` counts.
    """
    width = max(int(reach), 1)
    left_bucket = F.floor(day_number(F.col(at)) / width)
    alone = F.col(by).isNull() | F.col(at).isNull()
    asking = left.select(F.struct(*left.columns).alias("row"), F.col(by).alias("key"), F.when(alone, F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in left.columns)), F.lit(1024))).otherwise(left_bucket).alias("bucket"), F.col(at).alias("at"), F.lit(1).alias("kind"))
    own = F.floor(day_number(F.col(right_at)) / width)
    found = right.where(F.col(by).isNotNull() & F.col(right_at).isNotNull()).select(F.struct(*payload).alias("held"), F.col(by).cast(left.schema[by].dataType).alias("key"), F.explode(F.array(own, own + 1)).alias("bucket"), F.col(right_at).alias("at"), F.lit(0).alias("kind"), *(F.col(t).alias(f"tie{i}") for i, t in enumerate(ties)))
    rows = asking.unionByName(found, allowMissingColumns=True)
    order = Window.partitionBy("key", "bucket").orderBy("at", "kind", *(f"tie{i}" for i in range(len(ties)))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last("held", ignorenulls=True).over(order)
    return rows.withColumn("held", latest).where("kind = 1").select("row.*", F.when(F.col("key").isNotNull() & F.col("at").isNotNull(), F.col("held")).alias(name))


def segments(history: DataFrame, on: str, start: str, end: str, ties: Sequence[str] = (), open_end: str = "2099-12-31", days: int = BUCKET_DAYS) -> DataFrame:
    """``(on, day, winner, holds)``: from ``day`` on, the one of a key's intervals that holds and began last, or null.

    Overlapping and nested intervals are cut into disjoint segments by one sweep for each (key, bucket of days), so a
    key's history isn't one task. Of intervals that began on one day the first by ``ties`` wins. A null end is open up
    to ``open_end``; intervals without a key or start, and those that end before they start, hold nothing.
    """
    last = F.coalesce(F.col(end), F.lit(open_end).cast("date"))
    sound = history.where(F.col(on).isNotNull() & F.col(start).isNotNull() & (F.col(start) <= last))
    low, high = day_number(F.col(start)), day_number(last)
    bucket = F.explode(F.sequence(F.floor(low / days), F.floor(high / days))).alias("bucket")
    rows = sound.select(F.col(on).alias("key"), low.cast("int").alias("low"), high.cast("int").alias("high"), F.struct(*history.columns).alias("row"), *(F.col(t).alias(f"tie{i}") for i, t in enumerate(ties)), bucket)
    first = F.col("bucket") * days
    cut = rows.select("key", "bucket", F.greatest("low", first).alias("from"), F.least("high", first + days - 1).alias("to"), "row", F.struct(-F.col("low"), *(f"tie{i}" for i in range(len(ties)))).alias("rank"))
    # The points at which what holds may change: each start, and each day after an end.
    points = cut.select("key", "bucket", F.explode(F.array("from", F.col("to") + 1)).alias("point")).distinct()
    spans = cut.groupBy("key", "bucket").agg(F.array_sort(F.collect_list(F.struct("rank", "from", "to", "row"))).alias("held"))  # what overlaps one bucket of one key
    swept = points.join(spans, ["key", "bucket"])
    holds = F.get(F.filter("held", lambda h: (h["from"] <= F.col("point")) & (F.col("point") <= h["to"])), F.lit(0))
    return swept.select(F.col("key").alias(on), F.date_add(F.lit("1970-01-01").cast("date"), F.col("point").cast("int")).alias("day"), holds["row"].alias("winner"), holds.isNotNull().cast("int").alias("holds"))


def ended(history: DataFrame, end: str, last: datetime.date | None) -> DataFrame:
    """``history`` without the days after ``last``, that of the last row asking: open ends need no segments beyond it."""
    return history.withColumn(end, F.least(end, F.lit(last).cast("date")))


def latest_valid(left: DataFrame, history: DataFrame, on: str, key: str, date: str, start: str, end: str, ties: Sequence[str] = ()) -> DataFrame:
    """Of all intervals that hold a row's date, the one that began last; rows that none holds go."""
    held = segments(history, on, start, end, ties)
    found = last_before(left, held, on, date, "day", ["winner"], BUCKET_DAYS, "__held", ["holds"]).where("__held.winner IS NOT NULL")
    return found.select(*left.columns, *(F.col(f"__held.winner.{c}").alias(c) for c in history.columns if c != on))


def nearest_year(left: DataFrame, right: DataFrame, on: str, key: str, year: str, candidate: str, ties: Sequence[Column] = ()) -> DataFrame:
    """Of a key's rows on the right, the one whose year is nearest to that before the row's; ties go to the later year.

    Unmatched rows stay, with nulls.
    """
    found = left.join(right, on, "left")
    distance = F.abs(F.col(candidate) - (F.col(year) - 1))
    return first_by(found, [key], [distance.asc_nulls_last(), F.col(candidate).desc_nulls_last(), *ties])


def linked(filings: DataFrame, primary: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``filings(accession, cik, date_filed, filing_year)`` with gvkey, permno and where they are from.

    ``primary(cik, gvkey, permno, fyear)`` is asked first; for what it lacks, the interval ``history(cik, gvkey,
    linkdt, linkenddt)`` gives the gvkey and the primary table its permno.
    """
    base = filings.select("accession", "cik", "date_filed", "filing_year")
    sound = primary.where("gvkey IS NOT NULL AND permno IS NOT NULL AND fyear IS NOT NULL").select("cik", "gvkey", "permno", "fyear")
    ties = [F.col("gvkey").asc_nulls_last(), F.col("permno").asc_nulls_last()]
    out = nearest_year(base, sound, "cik", "accession", "filing_year", "fyear", ties).drop("fyear")
    if history is not None:
        missing = out.where("gvkey IS NULL").select(*base.columns)
        second = latest_valid(missing, history, "cik", "accession", "date_filed", "linkdt", "linkenddt", ["gvkey"])
        second = second.select("accession", "filing_year", F.col("gvkey").cast("long").alias("gvkey"))
        hop = nearest_year(second, sound.select("gvkey", "permno", "fyear"), "gvkey", "accession", "filing_year", "fyear", [F.col("permno").asc_nulls_last()])
        hop = hop.select("accession", F.col("gvkey").alias("__gvkey"), F.col("permno").alias("__permno"))
        out = out.join(hop, "accession", "left")
        source = F.when(F.col("gvkey").isNotNull(), "compustat").when(F.col("__gvkey").isNotNull(), "comphist").otherwise("none")
        permno = F.when(F.col("gvkey").isNotNull(), F.col("permno")).otherwise(F.col("__permno"))
        return out.select(*base.columns, F.coalesce("gvkey", "__gvkey").alias("gvkey"), permno.alias("permno"), source.alias("match_source"))
    return out.withColumn("match_source", F.when(F.col("gvkey").isNotNull(), "compustat").otherwise("none"))


def as_of(left: DataFrame, right: DataFrame, by: str, key: str, at: str, payload: Sequence[str], days: int, null_stops: str) -> DataFrame:
    """Attributes of the latest row at or before a row's time, at most ``days`` earlier.

    An exact match is taken as it is unless its ``null_stops`` column is null; then, and without one, the latest row
    counts even if that column is null there: older rows never stand in for it. No match is listed before the choice.
    """
    found = last_before(left, right, by, at, at, [at, *payload], days, "__x")
    near = F.datediff(F.col(at), F.col("__x")[at]) <= days
    stands = near & (F.col("__x")[null_stops].isNotNull() | (F.col("__x")[at] == F.col(at)))
    return found.select(*left.columns, *(F.when(stands, F.col("__x")[c]).alias(c) for c in payload))


def dense_ranges(ranges: DataFrame, low: str, high: str, value: str, order: str) -> DataFrame:
    """``(code, value)`` for every code of ordered ranges; a later range overwrites an earlier one.

    The table is as long as the codes are many (10,000 at most for industry codes), whatever the data's size.
    """
    codes = ranges.select(F.explode(F.sequence(low, high)).alias("code"), value, order)
    return codes.groupBy("code").agg(F.max_by(value, order).alias(value))


def range_lookup(df: DataFrame, code: Column, dense: DataFrame, value: str, default: int, most: int = 9999) -> DataFrame:
    """The range's value for a code, clipped to -1..most, or the default: an equi-join with a table of bounded size."""
    if dense.limit(most + 3).count() > most + 2:
        raise ValueError("the dense table is longer than its codes")
    keyed = df.withColumn("__code", F.least(F.greatest(code.cast("int"), F.lit(-1)), F.lit(most)))
    table = dense.select(F.col("code").cast("int").alias("__code"), F.col(value).alias("__value"))
    return keyed.join(F.broadcast(table), "__code", "left").withColumn(value, F.coalesce("__value", F.lit(default))).drop("__code", "__value")
