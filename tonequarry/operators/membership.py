"""Work that is done already, and work that isn't: only rows whose key may be among the done ones are shuffled.

A blocked Bloom filter of the done keys is built by partial aggregation, sized by their count and broadcast; it never
exceeds ``MOST_BLOCKS`` blocks of 64 bytes (32 MB). Rows that it rules out are decided where they are read; the others
meet the done keys in an exact join, so a false hit costs a shuffled row and changes no result. More keys than the
largest filter holds well, or keys of a kind that two equal values may hash differently in, are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a block, of which a key sets six; 16 bits a key, down to 8 in the largest filter.
WORDS, HASHES, BITS_A_KEY = 8, 6, 16
MOST_BLOCKS = 1 << 19
MOST_KEYS = MOST_BLOCKS * WORDS * 64 // 8
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _comparable(work: DataFrame, done: DataFrame, key: str) -> str | None:
    """The type in which equal keys of both sides hash equally, or None."""
    a, b = work.schema[key].dataType, done.schema[key].dataType
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return "bigint"
    plain = isinstance(a, (T.DateType, T.TimestampType, T.BinaryType)) or (isinstance(a, T.StringType) and a == T.StringType())
    return a.simpleString() if plain and a == b else None


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _places(key: Column) -> list[tuple[Column, Column]]:
    """The word and the bit in it of each of a key's bits."""
    h = F.xxhash64(key, F.lit("bits"))
    return [(F.shiftrightunsigned(h, 10 * i).bitwiseAND(F.lit(WORDS - 1)).cast("int"), F.shiftrightunsigned(h, 10 * i + 3).bitwiseAND(F.lit(63)).cast("int")) for i in range(HASHES)]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``(block, w0..w7)``: the blocks with any bit set. Tasks merge their own keys' bits before the shuffle."""
    one, zero = F.expr("1L"), F.lit(0).cast("long")
    masks = []
    for i in range(WORDS):
        mask = zero
        for word, bit in _places(F.col(key)):
            mask = mask.bitwiseOR(F.when(word == i, F.call_function("shiftleft", one, bit)).otherwise(zero))
        masks.append(mask.alias(f"w{i}"))
    return keys.select(_block(F.col(key), blocks).alias("block"), *masks).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def _marked(work: DataFrame, done: DataFrame, key: str, kind: str, n: int) -> tuple[DataFrame, Column]:
    """``work`` beside its block of the filter, in the one column ``name``, and whether the key may be done; null keys aren't."""
    blocks = max(1, min(MOST_BLOCKS, -(-n * BITS_A_KEY // (WORDS * 64))))
    name = "__filter"
    while name in work.columns:
        name += "_"
    table = bloom_filter(done.select(F.col(key).cast(kind).alias("key")).where("key IS NOT NULL"), "key", blocks)
    table = table.select(F.col("block").alias(f"{name}b"), F.array(*(f"w{i}" for i in range(WORDS))).alias(name))
    as_key = F.col(key).cast(kind)
    beside = work.join(F.broadcast(table), (_block(as_key, blocks) == F.col(f"{name}b")) & as_key.isNotNull(), "left")
    may = F.col(name).isNotNull()
    for word, bit in _places(as_key):
        may = may & (F.call_function("shiftrightunsigned", F.col(name)[word], bit).bitwiseAND(F.expr("1L")) == 1)
    return beside, F.coalesce(may, F.lit(False))


def possible(work: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame] | None:
    """Rows of ``work`` whose key may be done, and those whose key surely isn't; None where a filter doesn't pay or can't be built."""
    kind = _comparable(work, done, key)
    if kind is None or (n := done.count()) > MOST_KEYS:
        return None
    beside, may = _marked(work, done, key, kind, n)
    return beside.where(may).select(work["*"]), beside.where(~may).select(work["*"])


def todo(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key isn't done; rows with a null key always stay, and rows repeat as they stand."""
    parts = possible(work, done, key)
    if parts is None:
        return work.join(done.select(key), key, "left_anti")
    return parts[0].join(done.select(key), key, "left_anti").select(*work.columns).unionByName(parts[1])


def known(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key is done; no row with a null key is, and rows repeat as they stand."""
    parts = possible(work, done, key)
    return (work if parts is None else parts[0]).join(done.select(key), key, "left_semi").select(*work.columns)
