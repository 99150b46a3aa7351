"""Interaction audit of document filters: what each filter removes in each order, and which filters agree.

Each row's failures are a bit mask. Four filters look at the row alone; the fifth, repetition of an earlier text, needs
the corpus: rows are routed by their text's xxhash to chains that keep each full text with the least id seen, so equal
hashes of different texts do no harm. Where two ids meet on one text the larger is known not to be the least and leaves
the chain at once, already in the task that read it: at most one row of each text goes from there through the shuffle,
and no group of copies is ever gathered. Masks are counted in vectors by part, merged by ``combineByKey``; every order's
figures follow from a part's 32 counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import tidy, width

LETTERS = "ABCDE"
REPEATED = 1 << LETTERS.index("E")
MASKS = 1 << len(LETTERS)
#: Fixed values of the filters: words; distinct words and capitals in percent; marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS, FOLLOWING = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Bytes of text that a task holds in chains before it passes them on, and that a task of the next step gets about.
HELD = 16 << 20
#: Bytes that are split into words at once, and parts that a task counts at once.
STEP, PARTS = 1 << 20, 4096
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def mask_of(data: bytes) -> int:
    """The failures of A to D. Words are what ASCII white space parts; letters are code points."""
    words, distinct, at = 0, set(), 0
    while at < len(data):
        cut = BLANK.search(data, at + STEP)
        end = cut.start() if cut else len(data)
        part = data[at:end].split()
        words += len(part)
        distinct.update(part)
        at = end
    capitals = len(data) - len(data.translate(None, CAPITALS))
    letters = len(data.translate(None, FOLLOWING))
    fails = (words < LEAST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * letters, MARKS.search(data) is not None)
    return sum(1 << k for k, f in enumerate(fails) if f)


class Chains:
    """Texts by hash, each with its mask, the least id seen and the rows of that id as counts by part."""

    def __init__(self):
        self.of: dict[int, list[list]] = {}
        self.held = 0

    def entry(self, key: int, text: bytes) -> list | None:
        return next((e for e in self.of.get(key, ()) if e[0] == text), None)

    def add(self, key: int, text: bytes, mask: int, doc_id: int, parts: dict[str, int]) -> tuple[int, dict[str, int]] | None:
        """Takes rows of one id; returns the id and rows that are now known not to be the least."""
        e = self.entry(key, text)
        if e is None:
            self.of.setdefault(key, []).append([text, mask, doc_id, parts])
            self.held += len(text) + 200
        elif doc_id == e[2]:
            for p, n in parts.items():
                e[3][p] = e[3].get(p, 0) + n
        elif doc_id > e[2]:
            return doc_id, parts
        else:
            out = e[2], e[3]
            e[2:] = [doc_id, parts]
            return out
        return None

    def drain(self) -> Iterator[tuple[int, list]]:
        for key, chain in self.of.items():
            for e in chain:
                yield key, e
        self.of, self.held = {}, 0


def route(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(key, row) of (doc_id, part, text): settled rows as (doc_id, parts, mask), texts as (text, mask, doc_id, parts)."""
    chains = Chains()
    for doc_id, part, text in rows:
        data = bytes(text or b"")
        key = xxhash.xxh64_intdigest(data)
        known = chains.entry(key, data)
        mask = known[1] if known else mask_of(data)
        if doc_id is None:
            yield key ^ xxhash.xxh64_intdigest(part), (None, {part: 1}, mask)
            continue
        loser = chains.add(key, data, mask, doc_id, {part: 1})
        if loser:
            yield loser[0], (*loser, mask | REPEATED)
        if chains.held > HELD:
            for k, e in chains.drain():
                yield k, tuple(e)
    for k, e in chains.drain():
        yield k, tuple(e)


def settle(pairs: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int, int]]:
    """``(doc_id, part, mask, n)`` of all rows that were routed to a task."""
    chains = Chains()
    for key, row in pairs:
        if len(row) == 3:
            done = row
        else:
            text, mask, doc_id, parts = row
            loser = chains.add(key, text, mask, doc_id, parts)
            done = (*loser, mask | REPEATED) if loser else None
        if done:
            for part, n in done[1].items():
                yield done[0], part, done[2], n
    for _, (_, mask, doc_id, parts) in chains.drain():
        for part, n in parts.items():
            yield doc_id, part, mask, n


def verdicts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """``(doc_id, part, mask, n)``: the filters that each row fails, bit k for the k-th of ``LETTERS``; n equal rows are one.

    A null text is empty, a null part the empty string. Rows that repeat an id with its text are not copies of each
    other. A row without an id is nobody's copy and nobody's original. An empty table gives no rows.
    """
    spark = docs.sparkSession
    part = F.coalesce(docs[part_column].cast("string"), F.lit(""))
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), part.alias("part"), docs[text_column].cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(width(docs), size // HELD)
    routed = rows.rdd.mapPartitions(route).partitionBy(parts, lambda key: key)
    return spark.createDataFrame(routed.mapPartitions(settle), "doc_id long, part string, mask int, n long", verifySchema=False)


def vectors(rows: DataFrame) -> DataFrame:
    """``(part, counts)``: partial sums of ``(part, mask, n, good, toxic)`` as 3 x 32 longs: rows, good ones, toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

        for batch in batches:
            for part, mask, n, good, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = total.setdefault(part, np.zeros((3, MASKS), "i8"))
                v[:, mask] += n, n * good, n * toxic
            if len(total) > PARTS:
                yield out()
                total.clear()
        yield out()

    return rows.select("part", "mask", "n", "good", "toxic").mapInArrow(tidy(run), "part string, counts binary")


ROW = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def figures(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of one part: five steps of each order."""
    mask = np.arange(MASKS)
    shapley: dict[str, int] = dict.fromkeys(LETTERS, 0)
    rows = []
    for order in map("".join, permutations(LETTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            fails, free = (mask & bit) > 0, (mask & before) == 0
            removed, good, toxic = (int(x) for x in counts[:, fails & free].sum(axis=1))
            before |= bit
            kept, redundant = int(counts[0, (mask & before) == 0].sum()), int(counts[0, fails & ~free].sum())
            rows.append((order, step, kept, removed, redundant, int(counts[0, bit]), good, toxic))
            shapley[letter] += removed
    for row in rows:
        yield (part, *row, shapley[row[0][row[1] - 1]])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``ROW`` for each part, order of the filters and step.

    ``labels(doc_id, quality, toxic)``: an id counts as good or toxic if any of its rows says so; rows without a label
    are neither.
    """
    said = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    said = said.where("doc_id IS NOT NULL AND (good = 1 OR toxic = 1)").na.fill(0, ["good", "toxic"])
    joined = verdicts(docs).join(said, "doc_id", "left").na.fill(0, ["good", "toxic"])
    pairs = vectors(joined).rdd.map(lambda r: (r[0], np.frombuffer(r[1], "i8")))
    summed = pairs.combineByKey(lambda v: v, lambda a, b: a + b, lambda a, b: a + b, width(docs))
    rows = summed.flatMap(lambda kv: figures(kv[0], kv[1].reshape(3, MASKS)))
    return docs.sparkSession.createDataFrame(rows, ROW, verifySchema=False)


def sql() -> str:
    """The same rows in DuckDB's SQL."""
    orders = " CROSS JOIN ".join(f"l AS l{i}" for i in range(1, 6))
    different = " AND ".join(f"l{i}.f <> l{j}.f" for i in range(1, 6) for j in range(1, i))
    return f"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        first_of AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
        w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM t JOIN first_of USING (text)),
        f AS (SELECT part, (len(ws) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws))::INT
                     + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text))::INT
                     + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask,
                     doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
        c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
        l(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (SELECT l1.f || l2.f || l3.f || l4.f || l5.f AS filter_order, [l1.bit, l2.bit, l3.bit, l4.bit, l5.bit] AS bits FROM {orders} WHERE {different}),
        s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS earlier FROM o CROSS JOIN range(1, 6) AS r(step)),
        e AS (SELECT part, filter_order, step::INT AS step, bit,
                     coalesce(sum(n) FILTER (mask & (earlier + bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
              FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM e"""
