"""Near-duplicate documents by SimHash and a generalised pigeonhole join.

Fingerprints that differ in at most ``tau`` bits are linked. The bits are permuted so that correlated ones share a
partition. With thresholds that add up to ``tau - parts + 1`` (each at least -1, which skips a partition), any linked
pair agrees within the threshold of at least one partition. So every distinct fingerprint probes, in each partition,
the values within its threshold there; an equi-join with the index finds the candidates, and the join's condition
counts the differing bits. Thresholds are allotted for each fingerprint by dynamic programming over the estimated
number of candidates, taken from byte-wide histograms of all fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import apart, narrow_batches, saved, tidy
from tonequarry.llm.components import components

BITS, TAU, WORDS, SEED = 64, 4, 4, 42
#: Partitions to choose from; the cheapest by the estimate is taken.
PARTS = (2, 3, 4)
#: What a probe (a shuffled row) and a candidate (a counted pair) cost, relative to each other.
PROBE_COST, CANDIDATE_COST = 1.0, 0.05


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """The SimHash of a text's bytes: a bit is set if it is in over half of the shingles' hashes; without words, 0."""
    found = data.lower().split()  # bytes: A-Z and the six ASCII white-space characters
    if not found:
        return 0
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], ">u8")
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
        hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), "u8", len(found) - words + 1).astype(">u8")
    counts = np.zeros(BITS, "i8")
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view("u1")).reshape(-1, BITS).sum(0, dtype="i4")
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of whole texts, a null text being empty; ``fp`` is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, "u8").view("i8"))], ["doc_id", "fp"])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("binary").alias("text"))
    return narrow_batches(narrow).mapInArrow(tidy(run), "doc_id long, fp long")


def as_bits(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones per value, the highest bit first."""
    return np.unpackbits(values.astype(">i8").view("u1")).reshape(-1, BITS)


def from_bits(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).reshape(-1).view(">i8").astype("i8")


def grouped_bits(together: np.ndarray, rows: int) -> list[int]:
    """An order of the bits in which each is followed by the one most correlated with those before it."""
    p = np.diag(together) / max(rows, 1)
    cov = together / max(rows, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    order = [int(corr.sum(0).argmax())]
    while len(order) < BITS:
        near = corr[order[-16:]].sum(0)
        near[order] = -1
        order.append(int(near.argmax()))
    return order


def bounds(parts: int) -> list[tuple[int, int]]:
    """First and last bit (exclusive) of each partition."""
    edges = [round(i * BITS / parts) for i in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def nearness(histograms: np.ndarray) -> np.ndarray:
    """For each byte position and byte value the number of rows at each distance 0..8 in that byte."""
    x = np.arange(256, dtype="u1")
    distance = np.bitwise_count(x[:, None] ^ x[None, :])
    return np.stack([np.stack([(h[None, :] * (distance == d)).sum(1) for d in range(9)], 1) for h in histograms])


def estimates(values: np.ndarray, near: np.ndarray, rows: int, parts: int, tau: int) -> np.ndarray:
    """``[value, partition, e + 1]``: the estimated rows within ``e`` of the value in the partition; 0 for e = -1.

    Bytes are taken as independent; a byte that a partition holds in part counts with that share of its distances.
    """
    data = values.astype(">i8").view("u1").reshape(-1, 8)
    out = np.zeros((len(values), parts, tau + 2))
    for i, (a, b) in enumerate(bounds(parts)):
        spread = np.zeros((len(values), tau + 1))
        spread[:, 0] = 1
        for byte in range(a // 8, (b + 7) // 8):
            share = (min(b, 8 * byte + 8) - max(a, 8 * byte)) / 8
            own = near[byte][data[:, byte]] / max(rows, 1)
            if share < 1:  # a bit of the byte is in the partition with this chance
                own = (1 - share) * np.eye(1, 9) + share * own
            mixed = np.zeros_like(spread)
            for d in range(min(9, tau + 1)):
                mixed[:, d:] += own[:, d : d + 1] * spread[:, : tau + 1 - d]
            spread = mixed
        out[:, i, 1:] = np.cumsum(spread, 1) * rows
    return out


def probes(bits: int, radius: int) -> int:
    """Values within ``radius`` of a value of ``bits`` bits."""
    total, term = 0, 1
    for r in range(radius + 1):
        total += term
        term = term * (bits - r) // (r + 1)
    return total


def allot(values: np.ndarray, near: np.ndarray, rows: int, parts: int, tau: int = TAU) -> tuple[np.ndarray, np.ndarray]:
    """For each value its thresholds by partition, and their cost: the least over all that add up to tau - parts + 1."""
    cost = CANDIDATE_COST * estimates(values, near, rows, parts, tau)
    for i, (a, b) in enumerate(bounds(parts)):
        cost[:, i, :] += [PROBE_COST * (probes(b - a, e) if e >= 0 else 0) for e in range(-1, tau + 1)]
    spare = tau + 1  # the sum over partitions of (threshold + 1)
    best = np.full((len(values), spare + 1), np.inf)
    best[:, 0] = 0
    chosen = []
    for i in range(parts):
        options = np.full((len(values), spare + 1, tau + 2), np.inf)
        for e in range(tau + 2):
            options[:, e:, e] = best[:, : spare + 1 - e] + cost[:, i, e : e + 1]
        chosen.append(options.argmin(2))
        best = options.min(2)
    thresholds, left = np.zeros((len(values), parts), "i8"), np.full(len(values), spare)
    for i in reversed(range(parts)):
        thresholds[:, i] = chosen[i][np.arange(len(values)), left]
        left = left - thresholds[:, i]
    return thresholds - 1, best[:, spare]


def flips(a: int, b: int, radius: int) -> np.ndarray:
    """The masks that turn a value into all those within ``radius`` in bits a..b."""
    single = [1 << (BITS - 1 - i) for i in range(a, b)]
    return np.array([sum(c) for r in range(radius + 1) for c in combinations(single, r)], "u8").view("i8")


def keys_of(a: int, b: int) -> int:
    """The mask of bits a..b as a signed long."""
    mask = ((1 << (b - a)) - 1) << (BITS - b)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _counted(distinct: DataFrame, of: callable, length: int) -> np.ndarray:
    """The sum over all rows of an array that ``of`` makes of a batch's values; it has ``length`` entries, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, "i8")
        for batch in batches:
            total += of(batch.column(0).to_numpy(zero_copy_only=False)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(total)], ["at", "n"])

    counted = distinct.select("fp").mapInArrow(tidy(run), "at long, n long").where("n > 0").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(length, "i8")
    for at, n in counted.collect():
        out[at] = n
    return out


def links(distinct: DataFrame, tau: int = TAU) -> DataFrame:
    """``(a, b)``: every pair of different ``fp`` values in ``distinct(fp)`` that differ in at most ``tau`` bits, once."""

    def matrix(values: np.ndarray) -> np.ndarray:
        bits = as_bits(values).astype("f8")
        return (bits.T @ bits).astype("i8")

    together = _counted(distinct, matrix, BITS * BITS).reshape(BITS, BITS)
    rows = distinct.count()
    order = grouped_bits(together, rows)
    back = np.argsort(order)

    def tally(values: np.ndarray) -> np.ndarray:
        data = from_bits(as_bits(values)[:, order]).astype(">i8").view("u1").reshape(-1, 8)
        return np.stack([np.bincount(data[:, i], minlength=256) for i in range(8)])

    histograms = _counted(distinct, tally, 8 * 256).reshape(8, 256)
    near = nearness(histograms)
    # Typical values, drawn from the histograms, tell which number of partitions is the cheapest.
    rng = np.random.default_rng(SEED)
    drawn = np.stack([rng.choice(256, 512, p=h / h.sum()) if h.sum() else np.zeros(512, int) for h in histograms], 1)
    typical = np.ascontiguousarray(drawn.astype("u1")).view(">i8").reshape(-1).astype("i8")
    parts = min((p for p in PARTS if p <= tau + 1), key=lambda p: allot(typical, near, rows, p, tau)[1].mean())
    edges = bounds(parts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {}
        for batch in batches:
            every = from_bits(as_bits(batch.column(0).to_numpy(zero_copy_only=False))[:, order])
            for at in range(0, len(every), 2048):
                values = every[at : at + 2048]
                thresholds, _ = allot(values, near, rows, parts, tau)
                for i, (a, b) in enumerate(edges):
                    for e in np.unique(thresholds[:, i]):
                        if e < 0:
                            continue
                        if (i, e) not in masks:
                            masks[i, e] = flips(a, b, int(e))
                        own = values[thresholds[:, i] == e]
                        keys = ((own & keys_of(a, b))[:, None] ^ masks[i, e][None, :]).reshape(-1)
                        part = pa.array(np.full(len(keys), i, "i4"))
                        yield pa.RecordBatch.from_arrays([part, pa.array(keys), pa.array(np.repeat(own, len(masks[i, e])))], ["part", "key", "a"])

    def turn(bits_order: list[int]) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [from_bits(as_bits(c.to_numpy(zero_copy_only=False))[:, bits_order]) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], batch.schema.names)

        return run

    probing = distinct.select("fp").mapInArrow(tidy(probe), "part int, key long, a long")
    values = distinct.select(F.col("fp").alias("b")).mapInArrow(tidy(turn(order)), "b long")
    index = values.select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("b").bitwiseAND(F.lit(keys_of(*e)).cast("long")).alias("key")) for i, e in enumerate(edges)))).alias("x"), "b")
    index = index.select("x.part", "x.key", "b")
    # One direction is enough: a pair's smaller value probes by its own thresholds and finds the larger one.
    within = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)
    found = probing.join(index.hint("merge"), (probing.part == index.part) & (probing.key == index.key) & within).select("a", "b").distinct()
    return found.mapInArrow(tidy(turn(back.tolist())), "a long, b long")


def near_duplicates(docs: DataFrame, tau: int = TAU, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: the component's id is the smallest doc_id reachable over links.

    Equal texts have equal fingerprints and are one node, so copies are never paired. Null and empty texts have the
    fingerprint 0. Rows repeat as they stand; a null id counts for no minimum; an empty table gives no rows.
    """
    prints = saved(fingerprints(docs, id_column, text_column))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = saved(components(links(distinct, tau)))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = roots.join(distinct, distinct.fp == roots.node).groupBy("root").agg(F.min("first").alias("least"))
    classes = saved(joined.join(smallest, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return prints.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """The documents without all but the one of smallest doc_id of each group; columns stay as they are.

    Only documents that may be dropped are joined by id; the texts of the others stay where they are.
    """
    found = near_duplicates(docs, tau).where(F.col("doc_id") != F.col("component_id"))
    dropped = saved(found.select(F.col("doc_id").alias("key")).distinct())
    maybe, kept = apart(docs, dropped, "doc_id")
    return maybe.join(dropped, maybe["doc_id"].cast("long") == dropped["key"], "left_anti").unionByName(kept)
