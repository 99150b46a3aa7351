"""Merkle manifest of a table: a hash for each row, one tree for each part, one tree over the parts.

Leaves are hashed where the rows stand; only hashes move on. They are numbered by (part, id) with a range partitioning
and running counts, dealt to buckets of 8^4 consecutive leaves, and each bucket's levels are hashed by DuckDB in the
executor, on the bucket's Arrow table. Spark combines the buckets' roots level by level, hands each node's siblings down
again, eight children a node at most, and joins them to the buckets, where DuckDB makes the proof of each row.

No task holds more than a bucket of leaves, whatever the size of a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonequarry.llm.common import saved, tidy, width, written

#: Nodes that make one of the next level, levels of a bucket, and letters of a hash.
FAN, DEPTH, LETTERS = 8, 4, 64
#: Of the running counts' table (one row for each range and part) so many rows are broadcast, at most.
MOST_COUNTS = 100_000

SIDES = "array<struct<left:string,right:string>>"
#: A part's name as a key: the null part sorts first.
NONE, SOME = "-", "="


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its length in bytes before it, so that no two rows give the same letters."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: bool = False) -> DataFrame:
    """``(part, doc_id, leaf, changed)``: ``changed`` is the leaf of a row after tampering, null where it isn't tampered with."""
    columns = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = F.lit(None).cast("string")
    if tampered:
        hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
        changed = F.when(hit, leaf_of([*columns[:-1], lowered(docs["text"])]))
    part = F.when(docs["lang"].isNull(), F.lit(NONE)).otherwise(F.concat(F.lit(SOME), docs["lang"]))
    return docs.select(part.alias("part"), docs["doc_id"].cast("long").alias("doc_id"), leaf_of(columns).alias("leaf"), changed.alias("changed"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(part, ...)`` with ``rank``, from 0 by ``order`` within each part, and ``size``, the part's rows.

    Ranges of rows are sorted in tasks and written with their places; ranks are places and the rows of earlier ranges.
    Rows that are equal in all of ``order`` may come in any order, and are dealt to several tasks if they are many.
    """
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))
    sorted_rows = rows.withColumn("salt", salt).repartitionByRange(width(rows), "part", *order, "salt").sortWithinPartitions("part", *order, "salt").drop("salt")
    placed = written(sorted_rows.withColumn("at", F.monotonically_increasing_id()))
    slice_of = F.shiftright("at", 33)
    counts = placed.groupBy("part", slice_of.alias("slice")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("part")
    before = F.coalesce(F.sum("n").over(whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = saved(counts.select("part", "slice", "first", before.alias("before"), F.sum("n").over(whole).alias("size")))
    if counts.count() <= MOST_COUNTS:
        counts = F.broadcast(counts)
    numbered = placed.withColumn("slice", slice_of).join(counts, ["part", "slice"])
    return numbered.withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "slice", "first", "before")


@cache
def engine() -> duckdb.DuckDBPyConnection:
    """A task's own DuckDB: one thread, bounded memory, nothing on disk."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def levels_sql(levels: int) -> str:
    """CTEs ``run0 level1 run1 ...`` over ``level0(idx, hash)``: eight consecutive nodes as one text, and its hash."""
    out = []
    for j in range(levels):
        out.append(f"run{j} AS (SELECT idx // {FAN} AS idx, string_agg(hash, '' ORDER BY idx) AS s FROM level{j} GROUP BY ALL)")
        out.append(f"level{j + 1} AS (SELECT idx, sha256(s) AS hash FROM run{j})")
    return ", ".join(out)


def levels_of(size: int, depth: int) -> int:
    """Levels of a bucket in a part of so many leaves."""
    out = 0
    while size > 1 and out < depth:
        size, out = -(-size // FAN), out + 1
    return out


BUCKETS = "part string, idx long, m long, levels int, hash string, doc_ids array<long>, leaves array<string>, changed array<string>"


def buckets_of(numbered: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``BUCKETS``: one row for each bucket of leaves, with its root ``hash``; ``m`` is the number of the part's buckets."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        size = table.column("size")[0].as_py()
        levels = levels_of(size, depth)
        level0 = pa.table({"idx": pa.array(range(len(table)), pa.int64()), "hash": table.column("leaf")})  # noqa: F841
        con = engine()
        ctes = f"WITH {levels_sql(levels)}" if levels else ""
        root = con.sql(f"{ctes} SELECT hash FROM level{levels}").fetchall()[0][0]
        whole = lambda c: pa.array([table.column(c).to_pylist()], pa.list_(pa.int64() if c == "doc_id" else pa.string()))
        row = [[table.column("part")[0].as_py()], [table.column("bucket")[0].as_py()], [-(-size // FAN**depth)], [levels], [root]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        columns = [pa.array(v, k) for v, k in zip(row, kinds, strict=True)] + [whole("doc_id"), whole("leaf"), whole("changed")]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in BUCKETS.split(", ")])

    dealt = numbered.withColumn("bucket", F.expr(f"rank div {FAN**depth}"))
    return dealt.groupBy("part", "bucket").applyInArrow(build, BUCKETS)


def handed_down(nodes: DataFrame, apex: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(part, idx, sides, subroot, root)`` for ``nodes(part, idx, m, hash)``, m of them for each part.

    ``apex`` gives ``(part, sides, subroot, root)`` for the trees' tops ``(part, hash)``. On the way up eight nodes make
    one; on the way down each node passes what it knows on to its eight: no step gathers more, and none meets all nodes of
    a part.
    """
    levels, runs = [nodes.select("part", "idx", "m", "hash")], []
    most = levels[0].agg(F.max("m")).first()[0] or 0
    while most > 1:
        above = F.expr(f"idx div {FAN}")
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]), "")
        runs.append(saved(levels[-1].where("m > 1").groupBy("part", "m", above.alias("above")).agg(texts.alias("s"))))
        levels.append(runs[-1].select("part", F.col("above").alias("idx"), F.expr(f"(m + {FAN - 1}) div {FAN}").alias("m"), F.sha2("s", 256).alias("hash")))
        most = -(-most // FAN)
    tops = levels[0].where("m = 1").select("part", "hash")
    for level in levels[1:]:
        tops = tops.unionByName(level.where("m = 1").select("part", "hash"))
    tops = saved(apex(tops))
    known = None
    for j in reversed(range(len(levels))):
        own = levels[j].where("m = 1").select("part", "idx").join(tops, "part")
        if known is not None:
            parents = runs[j].drop("m").join(known.withColumnRenamed("idx", "above"), ["part", "above"])
            children = levels[j].where("m > 1").select("part", "idx", F.expr(f"idx div {FAN}").alias("above")).join(parents, ["part", "above"])
            at = (F.col("idx") % FAN * LETTERS).cast("int")
            side = F.struct(F.substring("s", F.lit(1), at).alias("left"), F.substring("s", at + LETTERS + 1, F.lit(FAN * LETTERS)).alias("right"))
            own = own.unionByName(children.select("part", "idx", F.concat(F.array(side), "sides").alias("sides"), "subroot", "root"))
        known = saved(own)
    return known


def over_parts(tops: DataFrame) -> DataFrame:
    """``(part, sides, subroot, root)``: the tree over the parts' own roots."""
    numbered = ranked(tops.select(F.lit("").alias("part"), F.col("part").alias("name"), "hash"), ["name"])
    nodes = saved(numbered.select("part", F.col("rank").alias("idx"), F.col("size").alias("m"), "hash", "name"))
    at_top = lambda x: x.select("part", F.array().cast(SIDES).alias("sides"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    known = handed_down(nodes, at_top)
    return nodes.select("idx", "name", "hash").join(known, "idx").select(F.col("name").alias("part"), "sides", F.col("hash").alias("subroot"), "root")


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs_of(buckets: DataFrame) -> DataFrame:
    """``PROOFS`` for each leaf of ``buckets`` with ``sides``, ``subroot`` and ``root`` joined: what its siblings and its
    own leaf, or its ``changed`` one, fold to."""
    names = [c.split()[0] for c in PROOFS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = engine()
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c: batch.column(c)[i]  # noqa: E731, B023
                ids, levels, sides = value("doc_ids").values, value("levels").as_py(), value("sides").as_py()
                at = pa.array(range(len(ids)), pa.int64())
                hashes, changed = value("leaves").values, value("changed").values
                level0 = pa.table({"idx": at, "hash": hashes})  # noqa: F841
                own = pa.table({"pos": at, "doc_id": ids, "leaf": hashes, "changed": changed})  # noqa: F841
                step, ctes = "SELECT pos, doc_id, leaf, coalesce(changed, leaf) AS f, '' AS p FROM own", []
                for j in range(levels):
                    place = f"(pos // {FAN**j}) % {FAN} * {LETTERS}"
                    sided = f"SELECT q.*, substr(s, 1, {place}) AS l, substr(s, {place} + {LETTERS + 1}) AS r FROM ({step}) q JOIN run{j} ON run{j}.idx = pos // {FAN ** (j + 1)}"
                    ctes.append(f"fold{j} AS (SELECT pos, doc_id, leaf, sha256(l || f || r) AS f, p || l || r AS p FROM ({sided}))")
                    step = f"SELECT * FROM fold{j}"
                params = []
                for side in sides:
                    step = f"SELECT pos, doc_id, leaf, sha256(? || f || ?) AS f, p || ? || ? AS p FROM ({step})"
                    params = [side["left"], side["right"]] * 2 + params
                within = f"WITH {levels_sql(levels)}, {', '.join(ctes)}" if levels else ""
                root, subroot = value("root").as_py(), value("subroot").as_py()
                out = con.sql(f"{within} SELECT doc_id, leaf, ? AS subroot, ? AS root, sha256(p) AS proof_sha256, f AS folded_root, f = ? AS verified FROM ({step}) ORDER BY pos", params=[subroot, root, root, *params])
                table = out.to_arrow_table().cast(pa.schema([(n, pa.bool_() if n == "verified" else pa.int64() if n == "doc_id" else pa.string()) for n in names]))
                yield from table.to_batches()

    return buckets.mapInArrow(tidy(run), PROOFS)


def manifest(docs: DataFrame, tampered: bool = False, depth: int = DEPTH) -> DataFrame:
    """``PROOFS`` for each row of ``docs(doc_id, source, lang, n_chars, text)``; other columns take no part.

    Null values are told from empty ones. Rows of a part go by id, null ids first and never tampered with, then by leaf;
    rows that repeat as a whole are leaves of their own. An empty table has no root and gives no rows.
    """
    numbered = ranked(written(leaves(docs, tampered)), ["doc_id", "leaf"])
    buckets = written(buckets_of(numbered, depth))
    known = handed_down(buckets.select("part", "idx", "m", "hash"), over_parts)
    return proofs_of(buckets.join(known, ["part", "idx"]))


def sql(levels: int = 7) -> str:
    """The same rows in DuckDB's SQL, for parts of up to 8^levels rows."""

    def tree(name: str, part: str) -> str:
        """``name``N(part, idx, m, hash) from ``name``0, ``name``r with all runs, and ``name``top."""
        out = []
        for j in range(levels):
            out.append(f"{name}r{j} AS (SELECT {part}, idx // 8 AS idx, m, string_agg(hash, '' ORDER BY idx) AS s FROM {name}{j} WHERE m > 1 GROUP BY {part}, idx // 8, m)")
            out.append(f"{name}{j + 1} AS (SELECT {part}, idx, (m + 7) // 8 AS m, sha256(s) AS hash FROM {name}r{j})")
        tops = " UNION ALL ".join(f"SELECT {part}, hash FROM {name}{j} WHERE m = 1" for j in range(levels + 1))
        return ", ".join([*out, f"{name}top AS ({tops})"])

    def fold(source: str, name: str, part: str) -> str:
        """``source``(..., part, idx, f, p) folded through the levels of a tree, as ``name``f."""
        out, last = [], source
        for j in range(levels):
            at = f"(x.idx // {8**j}) % 8 * 64"
            out.append(
                f"{name}f{j} AS (SELECT x.* EXCLUDE (f, p), CASE WHEN s IS NULL THEN f ELSE sha256(substr(s, 1, {at}) || f || substr(s, {at} + 65)) END AS f, "
                f"CASE WHEN s IS NULL THEN p ELSE p || substr(s, 1, {at}) || substr(s, {at} + 65) END AS p FROM {last} x LEFT JOIN {name}r{j} r ON r.{part} = x.{part} AND r.idx = x.idx // {8 ** (j + 1)})"
            )
            last = f"{name}f{j}"
        return ", ".join([*out, f"{name}f AS (SELECT * FROM {last})"])

    piece = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    whole = lambda text: "sha256(" + " || ".join(map(piece, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 of a number's digits, letter by letter and bit by bit.
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c0, a: list_reduce([xor(c0, a), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: {bit})), 4294967295)"
    return f"""
        WITH d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS part, {whole("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {whole(low)} END AS changed FROM documents),
        n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY part) AS m FROM d),
        a0 AS (SELECT part, idx, m, leaf AS hash FROM n), {tree("a", "part")},
        b0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY part) - 1 AS idx, count(*) OVER () AS m, hash, part FROM atop), {tree("b", "one")},
        x AS (SELECT doc_id, part, leaf, idx, coalesce(changed, leaf) AS f, '' AS p FROM n), {fold("x", "a", "part")},
        y AS (SELECT af.doc_id, af.leaf, b0.hash AS subroot, b0.idx, 0 AS one, f, p FROM af JOIN b0 USING (part)), {fold("y", "b", "one")}
        SELECT doc_id, leaf, subroot, (SELECT hash FROM btop) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT hash FROM btop) AS verified FROM bf"""
