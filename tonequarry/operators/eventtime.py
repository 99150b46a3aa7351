"""Event time: trading-day numbers, event days and all window variables from running sums.

A trading day is the number of a security's row among those with a return. A filing's event day is the first row on or
after its date. What a window holds is the difference of two running sums, so each filing looks up a handful of days,
however long its windows are. Bars and filings are dealt by security once, together, and sorted by date: running sums
give each filing its place; its lookups then stand among the bars, sorted by day, and take the values of the bar before
them. There is no join, and bars are read and moved once. A security's rows are as many as the days that it was traded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Offsets from the event day: the first of the time before, the last of it, of the event, and of the time after.
FIRST, PRE, EVENT, LAST = -257, -6, 3, 255
#: Relative size below which a deviation is the noise of sums, and below which a direction is.
STILL, NOISE = 1e-6, 1e-8
LEAST_BEFORE, LEAST_ROWS = 65, 60
#: Bytes of stored input for each task that sorts securities' rows.
PART_BYTES = 4 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by security to as many tasks as the files that they come from ask for, if that is more than usual.

    So what a task sorts doesn't grow with the input, as far as there are securities.
    """
    spark, files = rows.sparkSession, rows.inputFiles()
    if not files:
        return rows
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    parts = size // PART_BYTES
    return rows.repartition(parts, "permno") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows


def trading_days(bars: DataFrame) -> DataFrame:
    """Rows with a return, numbered from 1 by date within each security."""
    w = Window.partitionBy("permno").orderBy("date")
    return dealt(bars.where("ret IS NOT NULL AND NOT isnan(ret)")).withColumn("td", F.row_number().over(w))


def event_days(filings: DataFrame, days: DataFrame) -> DataFrame:
    """``(accession, permno, date_filed, before, n_days)``: the security's rows strictly before the filing's date, and all.

    The event day is the next one. One running count over both tables, sorted together: no join by inequality.
    """
    rows = filings.where("permno IS NOT NULL").select("permno", F.col("date_filed").alias("date"), F.lit(0).alias("kind"), "accession")
    bars = days.select("permno", "date", F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["accession"].dataType).alias("accession"))
    whole = Window.partitionBy("permno")
    counted = rows.unionByName(bars).withColumn("before", F.sum("kind").over(whole.orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counted = counted.withColumn("n_days", F.sum("kind").over(whole))
    return counted.where("kind = 0").select("accession", "permno", F.col("date").alias("date_filed"), "before", "n_days")


def looked_up(filings: DataFrame, days: DataFrame, columns: dict[str, Column], sums: dict[str, Column], slots: dict[str, tuple[int, list[str]]], centred: dict[str, Column] | None = None) -> DataFrame:
    """``(permno, accession, before, n_days)`` of the filings with a few days' values: ``slots`` is name to (day, names).

    A slot's day is counted from ``before``, the security's last day before the filing.
    ``columns`` are of the days themselves and ``sums`` run up to and with the day, nulls being zero; ``centred`` are
    columns less the security's mean, which sums may use, with the mean as ``m_<name>``. A day before the first has
    nulls; days after the last are the last.
    """
    centred = centred or {}
    asking = filings.where("permno IS NOT NULL").select("permno", F.col("date_filed").alias("date"), F.lit(0).alias("kind"), "accession")
    bars = days.select("permno", "date", F.lit(1).alias("kind"), *(c.alias(n) for n, c in {**columns, **centred}.items()), *(c.alias(n) for n, c in sums.items() if not centred))
    rows = dealt(asking.unionByName(bars, allowMissingColumns=True))
    whole = Window.partitionBy("permno")
    order = whole.orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if centred:
        rows = rows.select("*", *(F.avg(n).over(whole).alias(f"m_{n}") for n in centred)).select("*", *((F.col(n) - F.col(f"m_{n}")).alias(f"d_{n}") for n in centred))
        rows = rows.select("*", *(c.alias(n) for n, c in sums.items()))
    placed = rows.select("permno", "kind", "accession", *columns, *(f"m_{n}" for n in centred), F.sum("kind").over(order).alias("before"), F.sum("kind").over(whole).alias("n_days"), *(F.coalesce(F.sum(n).over(order), F.lit(0)).alias(n) for n in sums))
    names = list(slots)
    wanted = sorted({c for _, some in slots.values() for c in some})
    lookup = F.array(*(F.struct(F.least(F.col("before") + day, F.col("n_days")).cast("long").alias("td"), F.lit(i).alias("slot")) for i, (day, _) in enumerate(slots.values())))
    itself = F.array(F.struct(F.col("before").alias("td"), F.lit(-1).alias("slot")))
    values = F.when(F.col("kind") == 1, F.struct(*wanted)).alias("values")
    each = placed.select("permno", "accession", "before", "n_days", values, F.explode(F.when(F.col("kind") == 0, lookup).otherwise(itself)).alias("x"))
    each = each.select("permno", "accession", "before", "n_days", "values", "x.td", "x.slot")
    by_day = whole.orderBy("td", "slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = each.withColumn("values", F.last("values", ignorenulls=True).over(by_day)).where("slot >= 0")
    held = [F.max(F.when(F.col("slot") == names.index(n), F.col(f"values.{c}"))).alias(f"{n}_{c}") for n, (_, some) in slots.items() for c in some]
    return found.groupBy("permno", "accession", "before", "n_days").agg(*held)


def _between(column: str, low: str, high: str) -> Column:
    """What a window adds up to: the running sum at its end less that before its start."""
    return F.coalesce(F.col(f"{high}_{column}"), F.lit(0)) - F.coalesce(F.col(f"{low}_{column}"), F.lit(0))


def checks(filings: DataFrame, days: DataFrame) -> DataFrame:
    """``(accession, ev_ok, pre_post_ok, price_before)`` of ``filings(accession, permno, date_filed)`` with a security.

    The event window is offsets 0 to 3, all with a volume; before it, offsets -257 to -6 and after it 4 to 255 need 60
    rows with a volume each, and 65 rows must lie before the event day.
    """
    sums = {"n_vol": (F.col("vol").isNotNull() & (F.col("vol") >= 0)).cast("int")}
    before = F.col("before")
    slots = {
        "first": (FIRST, ["n_vol"]),
        "pre": (PRE + 1, ["n_vol"]),
        "eve": (0, ["n_vol", "price"]),
        "event": (1 + EVENT, ["n_vol"]),
        "last": (1 + LAST, ["n_vol"]),
    }
    found = looked_up(filings, days, {"price": F.abs("prc")}, sums, slots)
    ok = _between("n_vol", "eve", "event") == 1 + EVENT
    both = ok & (before >= LEAST_BEFORE) & (_between("n_vol", "first", "pre") >= LEAST_ROWS) & (_between("n_vol", "event", "last") >= LEAST_ROWS)
    return found.select("accession", ok.alias("ev_ok"), both.alias("pre_post_ok"), F.col("eve_price").alias("price_before"))


@F.pandas_udf(T.DoubleType())
def _intercept(moments: pd.Series) -> pd.Series:
    """The intercept of an OLS fit from (mean y, means x, cov(x, y), cov(x, x) upper triangle)."""
    out, k = np.full(len(moments), np.nan), 3
    use = np.array([m is not None and not any(v is None or v != v for v in m) for m in moments], bool)
    if not use.any():
        return pd.Series(out)
    m = np.stack(moments[use].to_list()).astype("f8")
    y, x, xy = m[:, 0], m[:, 1 : 1 + k], m[:, 1 + k : 1 + 2 * k]
    c = np.zeros((len(m), k, k))
    upper = np.triu_indices(k)
    c[:, upper[0], upper[1]] = m[:, 1 + 2 * k :]
    c = c + np.triu(c, 1).transpose(0, 2, 1)
    # Differences of running sums leave noise where a factor is constant or one is a combination of others.
    scale = np.sqrt(np.maximum(np.diagonal(c, axis1=1, axis2=2), 0))
    still = scale <= STILL * np.maximum(1e-9, np.abs(x))
    scale = np.where(still, 1.0, scale)
    unit = np.where(still[:, :, None] | still[:, None, :], 0.0, c / scale[:, :, None] / scale[:, None, :])
    whole = np.linalg.matrix_rank(unit, tol=NOISE, hermitian=True) == k
    found = np.full(len(m), np.nan)
    if whole.any():
        slopes = np.linalg.solve(c[whole], xy[whole][:, :, None])[:, :, 0]
        found[whole] = y[whole] - (slopes * x[whole]).sum(1)
    for i in np.flatnonzero(~whole):  # the least-norm solution over intercept and slopes
        own = unit[i] * np.outer(scale[i], scale[i])
        full = np.block([[np.ones((1, 1)), x[i][None, :]], [x[i][:, None], own + np.outer(x[i], x[i])]])
        found[i] = (np.linalg.pinv(full, rcond=NOISE**2, hermitian=True) @ np.append(y[i], np.where(still[i], 0, xy[i]) + x[i] * y[i]))[0]
    out[use] = found
    return pd.Series(out)


FACTORS = ("mktrf", "smb", "hml")


VARIABLES = ("excret", "size_b", "turnover", "alpha")


def variables(filings: DataFrame, days: DataFrame, nasdaq: int = 3, halved_until: str = "2001-12-31", wanted: Sequence[str] = VARIABLES) -> DataFrame:
    """``(accession, excret, size_b, turnover, alpha)``, or the ``wanted`` of them; what can't be computed is null.

    excret: compounded return over offsets 0..3 less the market's, in percent; a null market return makes it null.
    size_b: price times shares the day before. turnover: volume before the event over shares the day before, halved
    for one exchange up to a day; a null volume makes it null. alpha: the intercept on three factors, a year's worth.
    Moments are taken about each security's own means, so that differences of running sums lose no digits. What is
    not wanted costs nothing: no sum of it runs.
    """
    before = F.col("before")
    event = F.col("n_days") >= before + 1 + EVENT
    columns, sums, centred, at = {}, {}, {}, {}
    out: dict[str, Column] = {}

    def held(slot: str, day: int, *names: str) -> None:
        at[slot] = (day, [*at.get(slot, (day, []))[1], *names])

    if "excret" in wanted:
        columns |= {"grown": 1 + F.col("ret"), "market": 1 + F.col("vwretd")}
        grown, market = F.lit(1.0), F.lit(1.0)
        for o in range(1 + EVENT):
            held(f"day{o}", 1 + o, "grown", "market")
            grown, market = grown * F.col(f"day{o}_grown"), market * F.col(f"day{o}_market")
        out["excret"] = F.when(event, (grown - market) * 100).alias("excret")
    if "size_b" in wanted:
        columns["size"] = F.abs("prc") * F.col("shrout") / 1000
        held("eve", 0, "size")
        out["size_b"] = F.when(event, F.col("eve_size")).alias("size_b")
    if "turnover" in wanted:
        halved = F.when((F.col("exchcd") == nasdaq) & (F.col("date") <= F.lit(halved_until).cast("date")), F.col("vol") / 2).otherwise(F.col("vol"))
        columns |= {"shares": F.abs("shrout"), "no_vol": F.col("vol").isNull().cast("int"), "halved": halved}
        sums |= {"n_null": F.col("no_vol"), "volume": F.col("halved")}
        held("eve", 0, "shares")
        held("pre", PRE + 1, "n_null", "volume")
        held("start", -252, "n_null", "volume")
        # With fewer than 257 days before, the window would start before the first one.
        start = F.when(before >= 257, before - 252).otherwise(before + FIRST)
        n_span = F.greatest(F.least(before + PRE + 1, F.col("n_days")), F.lit(0)) - F.greatest(start, F.lit(0))
        since = lambda c: F.coalesce(F.col(f"pre_{c}"), F.lit(0)) - F.when(before >= 257, F.coalesce(F.col(f"start_{c}"), F.lit(0))).otherwise(0)
        traded = event & (before >= LEAST_ROWS) & (n_span >= LEAST_ROWS) & (since("n_null") == 0) & (F.col("eve_shares") > 0)
        out["turnover"] = F.when(traded, since("volume") / (F.col("eve_shares") * 1e6)).alias("turnover")
    if "alpha" in wanted:
        complete = F.lit(True)
        for c in ("ret", *FACTORS, "rf"):
            complete = complete & F.col(c).isNotNull()
        centred = {"y": F.when(complete, F.col("ret") - F.col("rf"))} | {f"x{i}": F.when(complete, F.col(c)) for i, c in enumerate(FACTORS)}
        series = ["y", "x0", "x1", "x2"]
        pairs = [("y", f"x{i}") for i in range(3)] + [(f"x{i}", f"x{j}") for i in range(3) for j in range(i, 3)]
        moved = {"n_complete": F.col("y").isNotNull().cast("int")}
        moved |= {f"s_{c}": F.col(f"d_{c}") for c in series} | {f"s_{a}_{b}": F.col(f"d_{a}") * F.col(f"d_{b}") for a, b in pairs}
        sums |= moved
        held("first", FIRST, *moved)
        held("pre", PRE + 1, *moved, *(f"m_{c}" for c in series))
        n = _between("n_complete", "first", "pre")
        mean = {c: _between(f"s_{c}", "first", "pre") / n for c in series}
        covariances = [_between(f"s_{a}_{b}", "first", "pre") / n - mean[a] * mean[b] for a, b in pairs]
        moments = F.array(*(mean[c] + F.col(f"pre_m_{c}") for c in series), *covariances)
        out["moments"] = F.when(event & (before >= LEAST_ROWS) & (n >= LEAST_ROWS), moments).alias("moments")
    found = looked_up(filings, days, columns, sums, at, centred).select("accession", *out.values())
    if "alpha" in wanted:
        found = found.withColumn("alpha", _intercept("moments") * 252)
        found = found.withColumn("alpha", F.when(~F.isnan("alpha"), F.col("alpha")))
    return found.select("accession", *(v for v in VARIABLES if v in wanted))


def gap_filter(filings: DataFrame, days: int = 180, by: str = "cik", date: str = "date_filed", ties: tuple[str, ...] = ("accession",)) -> DataFrame:
    """Rows whose predecessor, kept or not, is absent or at least so many days earlier: one pass."""
    w = Window.partitionBy(by).orderBy(date, *ties)
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    return filings.withColumn("__gap", gap).where(f"__gap IS NULL OR __gap >= {int(days)}").drop("__gap")
