"""Quantiles by selection against pandas, to the last digit."""

import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonequarry.operators import selection, stats

AT = [0.0, 0.01, 0.25, 0.37, 0.5, 0.75, 0.99, 1.0]


def test_bits_keep_the_order(spark):
    rng = random.Random(1)
    values = [s * math.ldexp(1 + f, e) for e in range(-1074, 1024) for s in (1, -1) for f in (0.0, rng.random(), 1 - 2.0**-52)]
    values += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)] + [0.0, -0.0, math.inf, -math.inf, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 0.1, 1 / 3]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.ordered_bits(F.col("v")).alias("b"))
    got = df.collect()
    want = [int.from_bytes(struct.pack(">d", abs(r.v)), "big") * (-1 if r.v < 0 else 1) for r in got]
    assert [r.b for r in got] == want


@pytest.mark.parametrize("listed", [1, 5, 1 << 14])
def test_quantiles_equal_pandas(spark, monkeypatch, listed):
    monkeypatch.setattr(selection, "LISTED", listed)
    rng = np.random.default_rng(2)
    frames = [rng.normal(size=n) for n in (1, 2, 3, 10, 1000)]
    frames += [np.round(rng.normal(size=400), 1), np.full(300, 7.5), np.repeat([1.0, -1.0, 0.0], 50), 10.0 ** rng.uniform(-300, 300, 200), np.array([np.nan, 4.0, np.nan])]
    rows = [(None if g == 4 else g, float(v)) for g, f in enumerate(frames) for v in f] + [(99, None), (99, float("nan"))]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    got = {r.g: r for r in selection.quantiles(df, {"x": F.col("x")}, AT, ["g"]).collect()}
    assert len(got) == len(frames)
    for g, f in enumerate(frames):
        s = pd.Series(f)
        r = got[None if g == 4 else g]
        assert r.n == s.notna().sum() and r.cuts == [s.quantile(p) for p in AT], g
    whole = selection.quantiles(df, {"x": F.col("x"), "y": -F.col("x")}, AT).collect()
    s = pd.Series([x for _, x in rows], dtype=float)
    assert {r.variable: r.cuts for r in whole} == {"x": [s.quantile(p) for p in AT], "y": [(-s).quantile(p) for p in AT]}


def test_many_ties_are_counted_not_listed(spark, monkeypatch):
    monkeypatch.setattr(selection, "LISTED", 10)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 2.5).otherwise(F.col("id") % 7).alias("x"))
    want = df.toPandas().x
    assert selection.quantiles(df, {"x": F.col("x")}, AT).first().cuts == [want.quantile(p) for p in AT]


def test_winsorize_and_describe(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"q": rng.integers(0, 3, 300), "a": rng.normal(size=300), "b": rng.normal(size=300)})
    p.loc[5, "a"] = np.nan
    df = spark.createDataFrame(p).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).withColumn("q", F.when(F.col("q") > 0, F.col("q")))
    got = stats.winsorize(df, ["a", "b"]).toPandas()
    for c in "ab":
        assert sorted(got[c].dropna()) == sorted(p[c].dropna().clip(p[c].quantile(0.01), p[c].quantile(0.99)))
    by = stats.winsorize(df, ["a"], by=["q"]).toPandas()
    want = p.groupby("q").a.transform(lambda s: s.clip(s.quantile(0.01), s.quantile(0.99)))
    assert sorted(by.a.dropna()) == sorted(want.dropna()) and len(by) == 300
    d = {r.variable: r for r in stats.describe(df, ["a", "b"]).collect()}
    assert d["a"].median == p.a.median() and d["a"].n == 299 and d["b"].sd == pytest.approx(p.b.std())
    empty = df.where("false")
    assert stats.describe(empty, ["a"]).collect() == [] and stats.winsorize(empty, ["a"]).collect() == []
    assert stats.size_check(empty, "a", "b").first().n == 0


def test_no_task_grows_with_the_input(spark):
    """No percentile buffer in the plan; the largest exchange holds counts."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    plan = stats.winsorize(df, ["x"])._jdf.queryExecution().toString()
    assert "percentile" not in plan


def test_a_table_is_read_twice_and_described_from_one_making(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return float(x * x % 1009)

    df = spark.range(1000).select(seen("id").alias("x"), F.col("id").alias("y"))
    values = pd.Series([float(i * i % 1009) for i in range(1000)])
    assert selection.quantiles(df, {"x": F.col("x")}, [0.25, 0.5]).first().cuts == [values.quantile(0.25), values.quantile(0.5)]
    assert made.value == 2000
    made.value = 0
    assert {r.variable: r.median for r in stats.describe(df, ["x", "y"]).collect()} == {"x": values.median(), "y": 499.5}
    assert [r.value for r in stats.quantiles(df, "x", [0.5]).collect()] == [values.median()]
    assert made.value == 2000


def test_a_large_table_needs_no_bits(spark, monkeypatch):
    monkeypatch.setattr(selection, "_by_bits", None)
    monkeypatch.setattr(selection, "SHARP", 100)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_021 / 3).alias("x"))
    want = df.toPandas().x
    at = [0.0, 0.003, 0.37, 0.5, 0.99, 1.0]
    assert selection.quantiles(df, {"x": F.col("x")}, at).first().cuts == [want.quantile(p) for p in at]
