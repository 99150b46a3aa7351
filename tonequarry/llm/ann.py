"""Approximate nearest neighbours by cross-polytope hashing.

A table's pseudo-rotation is three rounds of random signs and a fast Hadamard transform. A unit vector's bucket is the
signed axis nearest to its rotation. Every vector stands in one bucket of each table; a query probes, in each table,
the buckets of the axes nearest to its own rotation. What the probed buckets hold is ranked by the exact cosine. Equal
vectors are one entry with the smallest of their ids, so a vector that a third of the rows share costs one entry, and
buckets are dealt to blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonequarry.llm.common import saved, tidy

TABLES, PROBES, ROUNDS, SEED = 16, 4, 3, 20
#: Entries of a bucket and queries that meet in one group, at most on average.
ENTRIES, QUERIES = 8192, 2048
#: Every entry whose product is so near to the last one kept is scored, as ties go by id and the product's last digits
#: vary with the block; about so many pairs at once.
SLACK, PAIRS = 1e-9, 1 << 16


def hadamard(y: np.ndarray) -> np.ndarray:
    """Each row's normalised Hadamard transform; the width is a power of two."""
    n, d = y.shape
    step = 1
    while step < d:
        y = y.reshape(n, d // (2 * step), 2, step)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return y / np.sqrt(d)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Rows under a table's pseudo-rotation, padded with zeros to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng([SEED, table])
    for _ in range(ROUNDS):
        y = hadamard(y * rng.choice([-1.0, 1.0], d))
    return y


def axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The signed axes nearest to each row's rotation, nearest first; axis ``d + i`` is the negative of axis ``i``."""
    y = rotated(x, table)
    both = np.concatenate([y, -y], 1)
    probes = min(probes, both.shape[1])
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def matrix(column: Iterable[bytes], kind: str) -> np.ndarray:
    """Equally long vectors, stored as the bytes of ``kind`` (f4 or f8), as rows of doubles."""
    rows = [np.frombuffer(v, kind) for v in column]
    return np.stack(rows).astype("f8") if rows else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, vector)`` as doubles, of the commonest length, without nulls, zero vectors and what isn't finite."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(sound)
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (lengths["n"] if lengths else 0))


ENTRY = "tab int, code int, id long, vector binary"


def hashed(entries: DataFrame, tables: int, probes: int, kind: str) -> DataFrame:
    """``entries(id, vector binary)`` once for each table and probed axis."""
    names = [x.split()[0] for x in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = unit(matrix(part.column(1).to_pylist(), kind))
                for t in range(tables):
                    codes = axes(x, t, probes)
                    rows = pa.array(np.repeat(np.arange(len(x)), codes.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, "i4")), pa.array(codes.reshape(-1).astype("i4")), part.column(0).take(rows), part.column(1).take(rows)], names)

    return entries.select("id", "vector").mapInArrow(tidy(run), ENTRY)


def _probed(index: DataFrame, asked: DataFrame, keep: int, kind: str) -> DataFrame:
    """``(query, id, score)``: of each group of a bucket's block and a block of queries, each query's nearest entries."""
    sizes = {(r["tab"], r["code"]): r["count"] for r in index.groupBy("tab", "code").count().collect()}  # at most tables x 2 x width
    wants = {(r["tab"], r["code"]): r["count"] for r in asked.groupBy("tab", "code").count().collect()}
    plan = [(t, c, -(-n // ENTRIES), -(-wants[t, c] // QUERIES)) for (t, c), n in sizes.items() if (t, c) in wants]
    blocks = F.broadcast(index.sparkSession.createDataFrame(plan or [(-1, -1, 1, 1)], "tab int, code int, ni int, nq int"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    dealt_index = index.join(blocks, ["tab", "code"]).select("tab", "code", own("ni").alias("bi"), every("nq").alias("bq"), "id", "vector")
    dealt_asked = asked.join(blocks, ["tab", "code"]).select("tab", "code", every("ni").alias("bi"), own("nq").alias("bq"), "id", "vector")

    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(queries):
            return pd.DataFrame({"query": np.zeros(0, "i8"), "id": np.zeros(0, "i8"), "score": np.zeros(0)})
        v, q = (matrix(f["vector"], kind) for f in (entries, queries))
        near = unit(q) @ unit(v).T
        least = np.partition(near, -keep, axis=1)[:, -keep] - SLACK if keep < len(v) else np.full(len(q), -np.inf)
        most = np.cumsum((near >= least[:, None]).sum(1)) // PAIRS
        out = []
        for rows in np.split(np.arange(len(q)), np.flatnonzero(most[1:] != most[:-1]) + 1):
            who, best = np.nonzero(near[rows] >= least[rows, None])
            x, y = q[rows[who]], v[best]
            score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            some = pd.DataFrame({"query": queries["id"].to_numpy()[rows[who]], "id": entries["id"].to_numpy()[best], "score": score})
            out.append(some.sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(keep))
        return pd.concat(out)

    keys = ["tab", "code", "bi", "bq"]
    found = dealt_index.groupBy(*keys).cogroup(dealt_asked.groupBy(*keys)).applyInPandas(run, "query long, id long, score double")
    return found.groupBy("query", "id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, tables: int = TABLES, probes: int = PROBES, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest rows by cosine, the nearest first.

    Queries are the rows whose id is divisible by ``every``; a row isn't its own neighbour. Ties go to the smaller id.
    Vectors that are null, zero, of an odd length or hold null or non-finite components take no part; repeated rows
    count once; a query gets all candidates if there are fewer than ``k``. A query whose buckets hold too few is
    searched through all buckets of one table, which is exact.
    """
    rows = saved(usable(vectors, id_column, vector_column).distinct())
    # Of equal vectors the k + 1 smallest ids may be among a query's nearest.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    # Floats travel as such: they are the same numbers in half the bytes.
    kind = "f4" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "f8"
    packed = F.udf(lambda v: np.array(v, kind).tobytes(), "binary", useArrow=True)
    classes = saved(first.groupBy("vector").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("id", "ids", packed("vector").alias("packed"), "vector"))
    entries = classes.select("id", F.col("packed").alias("vector"))
    queries = saved(rows.where(F.pmod("vec_id", F.lit(every)) == 0).join(classes.select("id", F.col("vector")), "vector").select(F.col("vec_id").alias("query_id"), "id"))
    asked = saved(entries.join(queries.select("id").distinct(), "id"))
    found = _probed(hashed(entries, tables, 1, kind), hashed(asked, tables, probes, kind), k + 1, kind)

    def ranked(found: DataFrame) -> DataFrame:
        top = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
        spread = top.join(classes.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
        pairs = queries.withColumnRenamed("id", "query").join(spread, "query").where("vec_id <> query_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = saved(ranked(found))
    expected = min(k, rows.agg(F.countDistinct("vec_id")).first()[0] - 1)
    complete = out.groupBy("query_id").count().where(F.col("count") >= expected).select("query_id")
    lacking = saved(queries.join(complete, "query_id", "left_anti"))
    if expected > 0 and not lacking.isEmpty():
        again = asked.join(lacking.select("id").distinct(), "id", "left_semi")
        exact = ranked(_probed(hashed(entries, 1, 1, kind), hashed(again, 1, 1 << 30, kind), k + 1, kind))
        out = out.join(lacking, "query_id", "left_anti").unionByName(exact.join(lacking, "query_id", "left_semi"))
    return out
