"""Done keys by a filter and an exact join, against sets."""

import re

import pytest
from pyspark.sql import functions as F

from tonequarry.operators import membership


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("work_type,done_type", [("int", "bigint"), ("string", "string"), ("date", "date"), ("double", "double"), ("decimal(9,2)", "decimal(9,2)"), ("string", "int")])
def test_rows_are_those_of_the_sets(spark, work_type, done_type):
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))
    one = lambda t, c: (day if t == "date" else c.cast(t)).alias("k")
    work = spark.range(300).select(one(work_type, F.col("id")), F.col("id").alias("__filter"), F.lit(1).alias("key"))
    work = work.union(work.limit(5)).union(work.limit(2).withColumn("k", F.lit(None).cast(work_type)))
    done = spark.range(0, 500, 3).select(one(done_type, F.col("id")))
    done = done.union(done.limit(3)).union(done.limit(1).withColumn("k", F.lit(None).cast(done_type)))
    rows = [tuple(r) for r in work.collect()]
    third = lambda r: r[0] is not None and r[1] % 3 == 0
    assert sorted(map(str, map(tuple, membership.todo(work, done, "k").collect()))) == sorted(str(r) for r in rows if not third(r))
    assert sorted(map(str, map(tuple, membership.known(work, done, "k").collect()))) == sorted(str(r) for r in rows if third(r))


def test_empty_sides(spark):
    some, none = spark.range(3).withColumnRenamed("id", "k"), spark.range(0).withColumnRenamed("id", "k")
    assert membership.todo(some, none, "k").count() == 3 and membership.known(some, none, "k").count() == 0
    assert membership.todo(none, some, "k").count() == 0 == membership.known(none, some, "k").count()


@pytest.mark.parametrize("n", [20, 20_000])
def test_false_hits_are_few(spark, n):
    done = spark.range(n).select(F.concat(F.lit("done-"), "id").alias("k"))
    work = spark.range(50_000).select(F.concat(F.lit("new-"), "id").alias("k"))
    hits, misses = membership.possible(work, done, "k")
    assert hits.count() < 500 and hits.count() + misses.count() == 50_000
    assert membership.possible(done, done, "k")[1].count() == 0


def test_too_many_keys_are_joined(spark, monkeypatch):
    monkeypatch.setattr(membership, "MOST_KEYS", 2)
    some = spark.range(5).withColumnRenamed("id", "k")
    assert membership.possible(some, some, "k") is None and membership.todo(some, some, "k").count() == 0


def test_only_possible_rows_are_shuffled(spark, no_broadcast):
    work, done = spark.range(1000).select(F.col("id").alias("k")), spark.range(0, 1000, 2).select(F.col("id").alias("k"))
    plan = membership.todo(work, done, "k")._jdf.queryExecution().executedPlan().toString()
    # Filter's groups, the possible rows and the done keys are dealt; the rest of the work goes by.
    assert len(re.findall(r"Exchange hashpartitioning\(k#", plan)) == 2
    assert plan.count("LeftAnti") == 1 and plan.count("BroadcastHashJoin") == 2
