"""Exact quantiles by distributed selection.

A sketch of bounded size (``percentile_approx``) tells between which two values each wanted rank lies; a second reading
counts the rows below (above, past the median) and each value between them, which gives the value of the rank itself. Where a rank isn't between
its two values, or too many values are, the ranks are found by their bits, whatever the values:

Doubles become integers of the same order. Their upper 16 bits are counted, which tells where each wanted rank lies;
the rows there are counted by their next 16 bits, and so on until so few are left in a rank's place that they can be
listed, or all bits are known, as for a value that many rows share. All counts are summed in the tasks first. No task
holds more than 65,536 counts for each place, or ``LISTED`` rows, whatever the number of rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one place that are listed and sorted at once.
LISTED = 1 << 18
#: A sketch's ranks are off by at most one part in so many: of a whole table, and of each of several groups.
SHARP, COARSE = 10_000, 1_000
#: Groups whose bounds are broadcast, at most.
FEW_GROUPS = 1 << 12
#: Bits by which the rows of a place are told apart at once.
STEP = 16


def ordered_bits(v: Column) -> Column:
    """A long for each double that isn't NaN, in the order of the doubles; both zeros are equal.

    Exponent and fraction are found by exact divisions by powers of two; the logarithm's guess is at most one off.
    """
    a = F.abs(v)
    guess = F.floor(F.log2(a)).cast("int")
    of = lambda e: a / F.pow(F.lit(2.0), e)
    e = F.when(of(guess) >= 2, guess + 1).when(of(guess) < 1, guess - 1).otherwise(guess)
    fraction = ((of(e) - 1) * float(1 << 52)).cast("long")
    size = (
        F.when(a == 0, F.lit(0).cast("long"))
        .when(a == float("inf"), F.lit(2047 << 52))
        .when(a < 2.0**-1022, (a / F.lit(2.0**-1074)).cast("long"))
        .otherwise((e + 1023).cast("long") * F.lit(1 << 52) + fraction)
    )
    return F.when(v < 0, -size).otherwise(size)


def saved(df: DataFrame) -> DataFrame:
    """A table of counts or of a few columns with its lineage cut, in the folder that the session names for that.

    Without one: with a local master in a temporary folder, as in tests; on a cluster it is cached, lineage and all.
    """
    return df.cache() if _folder(df) is None else df.checkpoint(eager=True)


def _folder(df: DataFrame) -> str | None:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if context.master.split("[")[0] != "local":
                return None
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df``, made once and written by column in the folder of ``saved``, for results that are made inside; then it goes."""
    folder = _folder(df)
    if folder is None:
        yield df
        return
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    yield df.sparkSession.read.schema(df.schema).parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _places(rows: DataFrame, by: list[str], shift: int, wanted: Column) -> DataFrame:
    """``(by, place, n, ranks)``: the places that hold a wanted rank; ``ranks`` are (as asked, within the place)."""
    counts = rows.groupBy(*by, F.shiftright("bits", shift).alias("place"), *([] if shift == 64 - STEP else ["ranks"])).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*by) if shift == 64 - STEP else Window.partitionBy(*by, F.shiftright("place", STEP))
    counts = counts.withColumn("before", F.sum("n").over(own.orderBy("place")) - F.col("n")).withColumn("all", F.sum("n").over(own))
    ranks = F.filter(wanted, lambda r: (r["within"] >= F.col("before")) & (r["within"] < F.col("before") + F.col("n")))
    ranks = F.transform(ranks, lambda r: F.struct(r["rank"].alias("rank"), (r["within"] - F.col("before")).alias("within")))
    total = ["all"] if shift == 64 - STEP else []
    return counts.select(*by, "place", "n", ranks.alias("ranks"), *total).where(F.size("ranks") > 0)


def _matching(rows: DataFrame, places: DataFrame, by: list[str], shift: int) -> DataFrame:
    """The rows of some places, with the places' columns; null groups match."""
    p = places.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("place").alias("__place"), "ranks")
    same = F.shiftright(rows["bits"], shift) == p["__place"]
    for c in by:
        same = same & rows[c].eqNullSafe(p[f"__{c}"])
    return rows.join(p, same).drop(*(f"__{c}" for c in by))


def _by_bits(df: DataFrame, columns: dict[str, Column], at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """As ``quantiles``, by the bits of the values alone: two to five readings."""
    keys = [*by, "variable"]
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("variable"), c.cast("double").alias("value")) for n, c in columns.items())))
    rows = df.select(*by, pairs.alias("x")).select(*by, "x.variable", "x.value").where("value IS NOT NULL AND NOT isnan(value)")
    rows = rows.select(*keys, "value", ordered_bits(F.col("value")).alias("bits"))
    low = [F.floor((F.col("all") - 1) * F.lit(float(p))).cast("long") for p in at]
    asked = F.array_distinct(F.flatten(F.array(*(F.array(i, F.least(i + 1, F.col("all") - 1)) for i in low))))
    shift = 64 - STEP
    places = saved(_places(rows, keys, shift, F.transform(asked, lambda r: F.struct(r.alias("rank"), r.alias("within")))))
    totals = places.select(*keys, F.col("all").alias("n")).distinct()
    found = None
    while True:
        few = places.where(F.col("n") <= LISTED)
        listed = _matching(rows, few, keys, shift).groupBy(*keys, "__place", "ranks").agg(F.sort_array(F.collect_list("value")).alias("values"))
        one = listed.select(*keys, F.explode("ranks").alias("r"), "values").select(*keys, "r.rank", F.get("values", F.col("r.within").cast("int")).alias("value"))
        found = one if found is None else found.unionByName(one)
        many = places.where(F.col("n") > LISTED)
        if many.isEmpty():
            break
        if shift == 0:  # all bits are the same
            same = _matching(rows, many, keys, 0).groupBy(*keys, "__place", "ranks").agg(F.max("value").alias("value"))
            found = found.unionByName(same.select(*keys, F.explode("ranks").alias("r"), "value").select(*keys, "r.rank", "value"))
            break
        inside = _matching(rows, many, keys, shift).drop("__place")
        shift -= STEP
        places = saved(_places(inside, keys, shift, F.col("ranks")))
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of"))
    pairs = totals.alias("t").join(values.alias("v"), [F.col(f"t.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys]).select(*(F.col(f"t.{k}") for k in keys), "n", "of")

    def cut(p: float) -> Column:
        i = _rank(p)
        return _between(F.col("of")[i], F.col("of")[F.least(i + 1, F.col("n") - 1)], p)

    return pairs.select(*keys, "n", F.array(*map(cut, at)).alias("cuts"))


def _rank(p: float) -> Column:
    """The rank at or below a quantile, among ``n``."""
    return F.floor((F.col("n") - 1) * F.lit(float(p))).cast("long")


def _between(a: Column, b: Column, p: float) -> Column:
    """pandas' linear rule between the values of two ranks."""
    t = (F.col("n") - 1) * F.lit(float(p)) - _rank(p)
    return F.when(a == b, a).when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)


def quantiles(df: DataFrame, columns: dict[str, Column], at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., variable, n, cuts)``: for each column the quantiles ``at``, between two rows by pandas' linear rule.

    Nulls and NaN don't count; a column without a value has no row. Equal to pandas to the last digit. ``df`` is read
    twice, or more often where the sketch doesn't do: give it a stored table. One, two and three rows, ties of any
    number, infinities and groups with a null key are fine.
    """
    sharp, of, places = COARSE if by else SHARP, list(columns), range(len(columns))
    rows = df.select(*by, *(F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"__v{i}") for i, c in enumerate(columns.values())))
    asked = sorted({min(1.0, max(0.0, p + side * 2 / sharp)) for p in at for side in (-1, 1)})
    sketch = lambda i: F.struct(F.count(f"__v{i}").alias("n"), F.percentile_approx(f"__v{i}", asked, sharp).alias("marks")).alias(f"__m{i}")
    marks = saved(rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(*map(sketch, places)))
    few = not by or marks.count() <= FEW_GROUPS
    same = F.lit(True)
    for c in by:
        same = same & rows[c].eqNullSafe(marks[f"__{c}"])
    both = rows.join(F.broadcast(marks) if few else marks, same)

    def asks(i: int, k: int, p: float) -> tuple[Column, Column]:
        """Whether a row counts, and as what: rows on the nearer side of the two values by number alone, those on the other not."""
        v, m = F.col(f"__v{i}"), F.col(f"__m{i}")
        low, high = p - 2 / sharp, p + 2 / sharp
        whole = m["n"] <= 10 * sharp  # so few that each value is counted
        over = F.lit(True) if low <= 0 else whole | (v >= m["marks"][asked.index(low)])
        under = F.lit(True) if high >= 1 else whole | (v <= m["marks"][asked.index(high)])
        near, far = (over, under) if p > 0.5 else (under, over)
        return v.isNotNull() & near, F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), m["n"].alias("n"), F.when(far, v).alias("value"))

    pairs = [asks(i, k, p) for i in places for k, p in enumerate(at)]
    some = F.lit(0)  # by number, so that no part of it goes below the join, where columns would be made once more
    for counts, _ in pairs:
        some = some + F.when(counts, 1).otherwise(0)
    each = F.filter(F.array(*(F.when(counts, x) for counts, x in pairs)), lambda x: x.isNotNull())
    counts = both.where(some > 0).select(*by, F.explode(each).alias("x")).select(*by, "x.*").groupBy(*by, "i", "k", "n", "value").agg(F.count("*").alias("rows"))
    own = Window.partitionBy(*by, "i", "k")
    upper = F.element_at(F.array(*(F.lit(p > 0.5) for p in at)), F.col("k") + 1)  # counted from above
    passed = F.sum("rows").over(own.orderBy(F.asc_nulls_first(F.when(upper, -F.col("value")).otherwise(F.col("value")))))
    counts = counts.withColumn("upto", F.when(upper, F.col("n") - passed + F.col("rows")).otherwise(passed)).withColumn("values", F.count("*").over(own))
    rank = F.element_at(F.array(*map(_rank, at)), F.col("k") + 1)
    holds = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("rows") <= r), F.col("value")))
    pairs = counts.groupBy(*by, "i", "k", "n").agg(F.max("values").alias("values"), holds(rank).alias("a"), holds(F.least(rank + 1, F.col("n") - 1)).alias("b"))
    cuts = [F.max(F.when(F.col("k") == k, _between(F.col("a"), F.col("b"), p))) for k, p in enumerate(at)]
    sound = F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("values") <= LISTED)) & (F.count("*") == len(at))
    found = saved(pairs.groupBy(*by, "i", "n").agg(F.array(*cuts).alias("cuts"), sound.alias("sound")))
    wanted = marks.agg(*(F.count_if(F.col(f"__m{i}.n") > 0).alias(f"m{i}") for i in places)).first()
    if found.where("sound").count() < sum(wanted):
        return saved(_by_bits(df, columns, at, by))
    return found.select(*by, F.element_at(F.array(*map(F.lit, of)), F.col("i") + 1).alias("variable"), "n", "cuts")


def median(df: DataFrame, column: str) -> DataFrame:
    """``(median)``: one row, null without a value."""
    found = quantiles(df, {"x": F.col(column)}, [0.5])
    return found.agg(F.max(F.col("cuts")[0]).alias("median"))

