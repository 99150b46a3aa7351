"""URL filtering: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join.

The filter's blocks are a table of at most ``MAX_BLOCKS`` rows of 512 bits, whatever the list's size, so it may be
broadcast; a longer list only lets more false hits through, and the exact join removes those.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import saved

#: 2^17 blocks of 64 bytes: 8 MB.
MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 32
WORDS, HASHES = 8, 6
#: Query parameters that name where a visit came from, not what is shown.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to the next ``/ ? #`` or the end, ASCII letters lower-cased; then the path up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does. Ties go to the one named first."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.host + r.path))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def bare_host(host: Column) -> Column:
    """Without user, default port and ``www.``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":(80|443)?$", ""), r"^www\.", "")


def canonical(host: Column, path: Column, url: Column) -> Column:
    """``host/path?query`` without scheme, fragment, tracking parameters, index page and closing slash."""
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    trimmed = F.regexp_replace(F.regexp_replace(path, r"/index\.html?$", "/"), "/+$", "")
    return F.concat(bare_host(host), F.lit("/"), F.regexp_replace(trimmed, "^/+", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def host_levels(listed: DataFrame) -> list[int]:
    """How many labels the listed hosts have, each number once: a listed host covers its subdomains of any depth."""
    host = F.substring_index("key", "/", 1)
    return sorted(r[0] for r in listed.select(F.size(F.split(host, r"\.")).alias("n")).distinct().collect())


def keys(host: Column, path: Column, url: Column, levels: Sequence[int]) -> Column:
    """What is looked up for a URL: its canonical form, its host as ``host/``, and the hosts above it of as many labels as listed ones have."""
    bare = bare_host(host)
    labels = F.size(F.split(bare, r"\."))
    hosts = [F.when(labels >= n, F.concat(F.substring_index(bare, ".", -n), F.lit("/"))) for n in levels]
    return F.array_distinct(F.array_compact(F.array(canonical(host, path, url), F.concat(bare, F.lit("/")), *hosts)))


def _block(key: Column, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def _bits(key: Column) -> list[tuple[Column, Column]]:
    """Word and mask of each of a key's bits in its block."""
    h = F.xxhash64(F.lit("bits"), key)
    return [(F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(WORDS - 1)), F.shiftrightunsigned(h, 9 * i + 3).bitwiseAND(F.lit(63)).cast("int")) for i in range(HASHES)]


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0..w7)`` of ``listed(key)``: the filter's blocks that hold any key."""
    bits = F.explode(F.array(*(F.struct(w.alias("w"), b.alias("b")) for w, b in _bits(F.col("key")))))
    rows = listed.select(_block(F.col("key"), blocks).alias("block"), bits.alias("x"))
    words = [F.bit_or(F.when(F.col("x.w") == i, F.expr("shiftleft(1L, x.b)")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(WORDS)]
    return rows.groupBy("block").agg(*words)


def may_hold(key: Column) -> Column:
    """Whether the block beside it may hold the key."""
    words = F.array(*(F.col(f"w{i}") for i in range(WORDS)))
    out = F.lit(True)
    for w, b in _bits(key):
        out = out & (F.expr("1L") == F.call_function("shiftrightunsigned", F.element_at(words, w.cast("int") + 1), b).bitwiseAND(F.lit(1).cast("long")))
    return out


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row.

    A rule's verdict stands; without one, a URL is blocked if its canonical form or a host of it is in ``listed(key)``,
    else allowed. A null URL or one without ``://`` has an empty host and path and is allowed. Rows repeat as they
    stand; repeated keys count once; empty tables give no rows; other columns aren't read.
    """
    narrow = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    narrow = narrow.select("page_id", "__url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = saved(narrow.select(F.monotonically_increasing_id().alias("rid"), "*", rule.alias("rule"), verdict.alias("ruled")))
    distinct = saved(listed.where(F.col("key").isNotNull()).select("key").distinct())
    blocks = max(1, min(MAX_BLOCKS, distinct.count() // KEYS_PER_BLOCK))
    asked = rows.where(F.col("rule").isNull() & (F.col("host") != "")).select("rid", F.explode(keys(F.col("host"), F.col("path"), F.col("__url"), host_levels(distinct))).alias("key"))
    asked = asked.withColumn("block", _block(F.col("key"), blocks))
    possible = asked.join(F.broadcast(bloom_blocks(distinct, blocks)), "block").where(may_hold(F.col("key"))).select("rid", "key")
    # A listed key may have a third of all rows, so its hits are dealt by the row too.
    salt = F.pmod("rid", F.lit(16)).cast("int")
    exact = distinct.select("key", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    hits = possible.withColumn("salt", salt).join(exact, ["key", "salt"]).select("rid").distinct().withColumn("hit", F.lit(True))
    out = rows.join(hits, "rid", "left")
    final = F.coalesce("ruled", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"))
