"""Writers. A committer makes each write whole or absent; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonequarry.functions.columns import finite
from tonequarry.sources import files


def parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    finite(df).write.mode(mode).partitionBy(*by).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    finite(df).write.mode("overwrite").option("header", True).csv(path)


def exchangeable(df: DataFrame) -> DataFrame:
    """What formats without nullable integers and infinities can hold: integers as doubles, infinities as nulls."""
    return finite(df.select(*(F.col(n).cast("double").alias(n) if t in {"int", "smallint", "tinyint"} else F.col(n) for n, t in df.dtypes)))


def digest(content: str = "content") -> Column:
    """What a stored file is checked by."""
    return F.sha2(F.col(content), 256)


def texts(df: DataFrame, folder: str, name: str = "accession", text: str = "text", again: bool = True) -> None:
    """One text file for each row, written by the tasks; ``again`` as in ``files.write``."""
    files.write(df.select(F.concat(F.col(name).cast("string"), F.lit(".txt")).alias("name"), F.col(text).cast("string").alias("text")), folder, "name", "text", again)


def markdown(df: DataFrame, order: Sequence[str], title: str = "", digits: int = 4) -> DataFrame:
    """``(place, line)``: a result as the lines of a Markdown table, made by the tasks; ``place`` gives their order.

    A table's rows are numbered in one sorted task: it is meant for the few rows of a report. Ties keep no order.
    """
    head = ([f"## {title}", ""] if title else []) + ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    cell = lambda n, t: F.coalesce(F.format_string(f"%.{digits}f", F.col(n).cast("double")) if t in {"double", "float"} else F.col(n).cast("string"), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(n, t) for n, t in df.dtypes)), F.lit(" |"))
    place = F.row_number().over(Window.orderBy(*order)) + F.lit(len(head))
    body = df.select(place.cast("long").alias("place"), line.alias("line"))
    top = df.sparkSession.createDataFrame(list(enumerate(head, 1)), "place long, line string")
    return top.unionByName(body)
