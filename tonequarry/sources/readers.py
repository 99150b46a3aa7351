"""Readers with fixed schemas. A schema is a contract: a missing column fails, it isn't dropped."""

from __future__ import annotations

import contextlib
import sqlite3
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tonequarry.functions.batches import narrow_batches
from tonequarry.functions.columns import accession_of, finite, label
from tonequarry.functions.text import clean_body, opened
from tonequarry.sources import archives

# Form types and their families.
FAMILIES = {"10-K": "10K", "10-K405": "10K", "10-KSB": "10K", "10-K/A": "10KA", "10-K405/A": "10KA", "10-KSB/A": "10KA", "10-KT": "10KT", "10-KT/A": "10KT"}
EXTENDED_FAMILIES = FAMILIES | {"10-K-A": "10KA", "10-K405-A": "10KA", "10-KSB-A": "10KA", "10-KT-A": "10KT", "10KSB": "10K", "10KSB-A": "10KA"}
BASE_URL = "https://www.sec.gov/Archives/"


def contract(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The columns of a schema, cast to it; fails if one is absent."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if lost := [f.name for f in wanted if f.name not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(lost)}")
    return finite(df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted)))


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = finite(spark.read.parquet(path))
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed text table; words such as NULL or NA are words, not missing values."""
    df = spark.read.schema(schema).csv(path, header=True, nullValue="", enforceSchema=False, quote='"', escape='"')
    return df.select(*columns) if columns else df


def index_lines(lines: DataFrame) -> DataFrame:
    """A manifest from ``lines(value)`` of pipe-separated index files: five fields, the first one digits."""
    parts = F.split("value", r"\|")
    rows = lines.where(F.col("value").rlike(r"^\s*\d+\s*\|") & (F.size(parts) == 5)).select(*(F.trim(parts[i]).alias(n) for i, n in enumerate(("cik", "company_name", "form_type", "date_filed", "filename"))))
    rows = rows.select(F.col("cik").try_cast("long").alias("cik"), "company_name", "form_type", label(F.col("form_type"), FAMILIES).alias("form_family"), F.col("date_filed").try_cast("date").alias("date_filed"), "filename")
    rows = rows.where("cik IS NOT NULL AND form_family IS NOT NULL AND date_filed IS NOT NULL").where(F.col("filename").endswith(".txt"))
    rows = rows.withColumn("accession", accession_of(F.col("filename"))).where("accession IS NOT NULL")
    return rows.select("cik", "company_name", "accession", "form_type", "form_family", "date_filed", F.concat(F.lit(BASE_URL), "filename").alias("txt_url"), F.lit("pending").alias("status"))


def index_files(spark: SparkSession, path: str) -> DataFrame:
    return index_lines(spark.read.text(path))


def quarters(spark: SparkSession, first: int, last: int) -> DataFrame:
    """``(year, quarter)`` of a span of years."""
    return _quarters(spark.range(1).select(F.lit(first).alias("first"), F.lit(last).alias("last")))


def _quarters(span: DataFrame) -> DataFrame:
    years = span.where("first IS NOT NULL").select(F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("year"))
    return years.select("year", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("quarter"))


def missing_quarters(rows: DataFrame, date: str) -> DataFrame:
    """``(year, quarter)`` of the years that a table spans, without the quarters that it has: what is still to be fetched."""
    there = rows.select(F.year(date).alias("year"), F.quarter(date).alias("quarter")).distinct()
    span = there.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    return _quarters(span).join(there, ["year", "quarter"], "left_anti")


def filings(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, clean, ok, error)`` of compressed filings, one row per file; a bad file is a row with an error."""
    found = archives.bodies(spark, path)
    return found.select("path", "length", F.when(F.col("ok"), clean_body(F.col("body"))).alias("clean"), "ok", "error")


def range_lines(lines: DataFrame) -> DataFrame:
    """``(file, low, high, industry, name, line)`` from ``lines(file, line, value)`` of headers ``number name`` and ranges ``dddd-dddd``.

    A range belongs to the last header above it in its file; ranges above the first header and other lines are dropped.
    """
    digits = F.regexp_extract("value", r"^\s*(\d{4})-(\d{4})\b", 1), F.regexp_extract("value", r"^\s*(\d{4})-(\d{4})\b", 2)
    header = F.col("value").rlike(r"^\s*\d{1,2}\s+\S+")
    of = F.when(header, F.struct(F.regexp_extract("value", r"^\s*(\d{1,2})\s+(\S+)", 1).cast("int").alias("industry"), F.regexp_extract("value", r"^\s*(\d{1,2})\s+(\S+)", 2).alias("name")))
    above = F.last(of, ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = lines.select("file", "line", above.alias("of"), *(d.alias(n) for d, n in zip(digits, ("low", "high"), strict=True))).where("low <> '' AND of IS NOT NULL")
    return found.select("file", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), "of.industry", "of.name", "line")


def industry_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The ranges of stored files; their lines are numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return range_lines(whole)


def first_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """The first of several tables that exists."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name)
    raise ValueError(f"none of these tables exists: {', '.join(names)}")


def jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A remote query, in one read or in ``parts`` reads of ranges of a column whose bounds the source is asked for.

    Filters on the result go to the source. A source without rows is read at once.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column is None:
        return reader.option("query", query).load()
    low, high = reader.option("query", f"SELECT min({column}) AS low, max({column}) AS high FROM ({query}) q").load().first()
    whole = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", f"({query}) q")
    if low is None:
        return whole.load()
    return whole.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def databases(df: DataFrame, key: str, path: str, table: str = "rows", most: int = 1 << 16) -> None:
    """Rows as databases (SQLite), each made by the task that has them: ``(low, high, content)`` of at most ``most`` rows.

    They stand in a Parquet table, so any storage that executors share will do; no row passes through the driver.
    """
    names, at = df.columns, df.columns.index(key)

    def database(part: list[tuple]) -> pa.RecordBatch:
        keys = [r[at] for r in part if r[at] is not None]
        with contextlib.closing(sqlite3.connect(":memory:")) as base:
            quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
            base.execute(f'CREATE TABLE "{table}" ({quoted})')
            base.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', part)
            base.commit()
            content = base.serialize()
        return pa.RecordBatch.from_pydict({"low": pa.array([min(keys, default=None)], pa.int64()), "high": pa.array([max(keys, default=None)], pa.int64()), "content": pa.array([content], pa.binary())})

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for batch in batches:
            part += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(part) >= most:
                yield database(part[:most])
                del part[:most]
        if part:
            yield database(part)

    df.mapInArrow(made, "low long, high long, content binary").write.parquet(path)


def pulled(spark: SparkSession, path: str, query: str, schema: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """What ``query`` gives in each of the ``databases`` of a folder, or in those that may hold keys of a range.

    The databases do the work: only the rows that the query returns leave them. A query that needs rows of several
    databases at once isn't one for this.
    """
    found = spark.read.schema("low long, high long, content binary").parquet(path)
    if low is not None:
        found = found.where(F.col("high") >= low)
    if high is not None:
        found = found.where(F.col("low") <= high)
    found = narrow_batches(found)
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with contextlib.closing(sqlite3.connect(":memory:")) as base:
                    base.deserialize(content.as_py())
                    answer = base.execute(query)
                    while part := answer.fetchmany(1 << 14):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)

    return found.select("content").mapInArrow(asked, schema)


def by_year(read: object, first: int, last: int) -> DataFrame:
    """One read per year, joined by column names: bounds what one remote query returns."""
    out = None
    for year in range(first, last + 1):
        part = read(year)
        out = part if out is None else out.unionByName(part)
    return out
