"""Secret scanning with DataFrame functions only: base patterns, and corpus-wide ownership of candidate values.

Matches' places come from cutting the text at them: the pieces between matches and the matches have known lengths, so
their running sums are the starts. Candidate values (those of base matches and other strings with digits) are hashed
and counted by distinct owners and distinct repositories over the whole corpus. A value that many owners or many
repositories hold is a copied example; one that few hold and that looks random is a live-looking credential: a long
string by itself, a shorter one where it stands bare in a text of the owner who assigns it elsewhere.

Arrays of n matches are summed and searched in blocks of about the square root of n, so that a text full of matches
doesn't cost their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import apart, saved, unused

#: The base kinds, in the order that breaks ties between spans. Runs need no upper bound; a run that is too short fails
#: as a whole, so the length may stand in the pattern where the run can't restart inside itself.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "owned")
#: Strings that may be credentials without a base pattern; they need a digit and a letter. Those of ``LONG`` letters or more
#: may be so by themselves, shorter ones only where their owner has assigned the same value elsewhere.
LOOSE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{6,}"
LONG, LEAST_VALUE = 20, 6
#: What doesn't tell two values apart at their ends.
ENDS = r"^[+/_.=-]+|[+/_.=-]+$"
#: A value that so many distinct owners, or repositories of whatever owners, hold is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5
#: Different characters that a live-looking value has at least, and for short ones their share of its length.
LEAST_VARIETY, LEAST_SHARE = 8, 0.6
#: Parts that the rows of one value are dealt to when its counts return to them.
SALT = 16

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _present(text: Column, *words: str) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w)
    return found


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it for each item of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _step(n: Column) -> Column:
    return F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))


def _blocks(n: Column, step: Column) -> Column:
    """The numbers of the blocks that hold n items; at least one."""
    return F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / step).cast("int"))


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def _spans(kind: int, pieces: Column, matches: Column, values: Column) -> Column:
    """Structs of a kind's matches. pieces: the text cut at the matches; values: what of each match is the secret."""
    n = F.size(matches)
    lengths = F.zip_with(F.slice(F.transform(pieces, F.char_length), F.lit(1), n), F.transform(matches, F.char_length), lambda p, m: p + m)

    def placed(each: Column) -> Column:
        def summed(step: Column) -> Column:
            totals = F.transform(_blocks(n, step), lambda j: _total(F.slice(each, j * step + 1, step)))

            def from_totals(t: Column) -> Column:
                def from_before(before: Column) -> Column:
                    def one(m: Column, i: Column) -> Column:
                        j = F.floor(i / step).cast("int")
                        end = F.element_at(before, j + 1) + _total(F.slice(each, j * step + 1, i - j * step + 1))
                        return F.struct((end - F.char_length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.element_at(values, i + 1).alias("value"))

                    return F.transform(matches, one)

                return _let(F.transform(_blocks(n, step), lambda j: _total(F.slice(t, F.lit(1), j))), from_before)

            return _let(totals, from_totals)

        return _let(_step(n), summed)

    return F.when(n > 0, _let(lengths, placed)).otherwise(F.array().cast(SPAN))


def _outside(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``, which is in order."""
    n = F.size(base)

    def grouped(step: Column) -> Column:
        def block(j: Column) -> Column:
            own = F.slice(base, j * step + 1, step)
            return F.struct(F.array_min(F.transform(own, lambda b: b["start"])).alias("low"), F.array_max(F.transform(own, lambda b: b["end"])).alias("high"), own.alias("own"))

        return _let(F.transform(_blocks(n, step), block), kept)

    def kept(blocks: Column) -> Column:
        def meets(s: Column) -> Column:
            return F.exists(blocks, lambda c: (c["low"] < s["end"]) & (s["start"] < c["high"]) & F.exists(c["own"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

        return F.filter(spans, lambda s: ~meets(s))

    return F.when((n > 0) & (F.size(spans) > 0), _let(_step(n), grouped)).otherwise(spans)


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner: str = "source", repository: str = "lang") -> DataFrame:
    """``(rid, doc_id, owner, repository, base, loose)``: the spans of each row's base matches and of other candidates.

    One pass over the texts, without a shuffle. The patterns run only where a literal that they need occurs.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(docs[id_column].alias("doc_id"), docs[owner].cast("string").alias("owner"), F.concat_ws("\0", docs[owner].cast("string"), docs[repository].cast("string")).alias("repository"), text.alias("text"))
    none = F.array().cast("array<string>")
    has = {
        "assign": _present(F.col("text"), "password", "passwd", "secret", "token", "apikey", "api_key"),
        "access": F.col("text").contains("AKIA"),
        "hex": F.col("text").rlike(HEX),
        "loose": F.col("text").rlike("[0-9]"),
    }
    rows = rows.select("*", *(v.alias(f"has_{k}") for k, v in has.items()))
    cut = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "loose": LOOSE}
    out = []
    for k, pattern in cut.items():
        out += [F.when(F.col(f"has_{k}"), F.split("text", pattern, -1)).otherwise(none).alias(f"{k}_pieces")]
        out += [F.when(F.col(f"has_{k}"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{k}_matches")]
    out += [F.when(F.col("has_assign"), F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(none).alias("assign_values")]
    rows = rows.select("doc_id", "owner", "repository", *out)
    spans = {}
    for i, k in enumerate(cut):
        values = F.col("assign_values") if k == "assign" else F.col(f"{k}_matches")
        spans[k] = _spans(i, F.col(f"{k}_pieces"), F.col(f"{k}_matches"), values)
    rows = rows.select("doc_id", "owner", "repository", *(v.alias(k) for k, v in spans.items()))
    assign = F.filter("assign", lambda s: F.char_length(s["value"]) >= LEAST_VALUE)
    loose = F.filter("loose", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    rows = rows.select("doc_id", "owner", "repository", F.array_sort(F.concat(assign, "access", "hex")).alias("base"), loose.alias("loose"))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repository", "base", _outside(F.col("loose"), F.col("base")).alias("loose"))


def plain(value: Column) -> Column:
    """A value without the marks at its ends, by which its copies are told."""
    return F.regexp_replace(value, ENDS, "")


def named(owner: str) -> Column:
    return F.coalesce(F.col(owner), F.lit("\0"))


def ownership(found: DataFrame) -> DataFrame:
    """``(hash, owners, repositories, first, last)`` of every candidate value of ``candidates``' rows, over the whole corpus.

    ``first`` and ``last`` are the least and the greatest of the owners who assign the value: all of them, where there are
    at most two. Counted in three steps, each summed before its shuffle: no task gets all rows of a value.
    """
    assigned = KINDS.index("assign")
    each = lambda c: F.transform(c, lambda s: F.struct(plain(s["value"]).alias("value"), (s["kind"] == assigned).alias("assigned")))
    values = found.select(named("owner").alias("owner"), "repository", F.explode(F.array_distinct(F.concat(each(F.col("base")), each(F.col("loose"))))).alias("x"))
    by_repository = values.groupBy(F.sha2("x.value", 256).alias("hash"), "owner", "repository").agg(F.bool_or("x.assigned").alias("assigned"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.bool_or("assigned").alias("assigned"))
    who = F.when(F.col("assigned"), F.col("owner"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.min(who).alias("first"), F.max(who).alias("last"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner: str = "source", repository: str = "lang") -> DataFrame:
    """``(doc_id, base, added, live)``: each row's base spans, those added, and those of base that look live.

    A span of ``added`` is a loose candidate that fewer than ``EXAMPLE_OWNERS`` owners and fewer than
    ``EXAMPLE_REPOSITORIES`` repositories hold, that has enough different characters for its length, and that is long or
    is assigned by the same owner somewhere; a live base span is one that few hold and that varies as much. Null and empty
    texts have no spans; a null owner is one owner; rows repeat as they stand; ties between spans go by kind; an empty table gives no rows.
    """
    found = saved(candidates(docs, id_column, text_column, owner, repository))
    few = ownership(found).where((F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES))
    few = few.select("hash", "first", "last", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    loose = KINDS.index("owned")
    spans = found.where((F.size("base") > 0) | (F.size("loose") > 0)).select("rid", named("owner").alias("holder"), F.explode(F.concat("base", "loose")).alias("span"))
    length = F.char_length("span.value")
    varied = F.size(F.array_distinct(F.split("span.value", ""))) >= F.least(F.lit(LEAST_VARIETY), F.ceil(length * LEAST_SHARE))
    spans = spans.where(varied).select("rid", "holder", "span", F.sha2(plain(F.col("span.value")), 256).alias("hash"), F.pmod("rid", F.lit(SALT)).cast("int").alias("salt"))
    own = F.coalesce((F.col("holder") == F.col("first")) | (F.col("holder") == F.col("last")), F.lit(False))
    held = spans.join(few, ["hash", "salt"]).where((F.col("span.kind") != loose) | (F.char_length("span.value") >= LONG) | own)
    owned = held.groupBy("rid").agg(F.array_sort(F.collect_list("span")).alias("owned"))
    rows = found.join(owned, "rid", "left").withColumn("owned", F.coalesce("owned", F.array().cast(SPAN)))
    added, live = F.filter("owned", lambda s: s["kind"] == loose), F.filter("owned", lambda s: s["kind"] != loose)
    return rows.select("doc_id", "base", added.alias("added"), live.alias("live"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans that are in order, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """The counts and digests of ``scan``'s rows."""
    def of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    everything = F.array_sort(F.concat("base", "added"))
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(everything).alias("spans"), F.size("live").cast("long").alias("n_live"), F.size("added").cast("long").alias("n_owned"))


def masked_base(text: Column, mask: str) -> Column:
    """The text with the secret of every base match replaced where it stands."""
    pieces, matches = F.split(text, ASSIGN, -1), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))

    def assigned(match: Column, value: Column) -> Column:
        return F.when(F.char_length(value) >= LEAST_VALUE, F.concat(F.left(match, F.char_length(match) - F.char_length(value)), F.lit(mask))).otherwise(match)

    # A piece of text, then the match that follows it; the last piece has none.
    each = F.zip_with(pieces, F.zip_with(matches, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), assigned), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    out = F.when(_present(text, "password", "passwd", "secret", "token", "apikey", "api_key"), F.array_join(each, "")).otherwise(text)
    for pattern in (ACCESS, HEX):
        out = F.regexp_replace(out, pattern, mask)
    return out


def masked_values(text: Column, values: Column, mask: str) -> Column:
    """The text with every loose candidate that is one of ``values`` replaced; values are dealt to lists by their hashes."""
    slot = lambda v, n: F.pmod(F.xxhash64(v), n).cast("int")
    pieces, matches = F.split(text, LOOSE, -1), F.regexp_extract_all(text, F.lit(LOOSE), F.lit(0))

    def dealt(step: Column) -> Column:
        lists = F.transform(F.sequence(F.lit(0), step - 1), lambda j: F.filter(values, lambda v: slot(v, step) == j))
        each = lambda held: F.zip_with(pieces, matches, lambda p, m: F.when(m.isNull(), p).otherwise(F.concat(p, F.when(F.array_contains(F.element_at(held, slot(m, step) + 1), m), F.lit(mask)).otherwise(m))))
        return F.array_join(_let(lists, each), "")

    return _let(_step(F.size(values)), dealt)


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every base match's secret and every owner-specific candidate masked; other columns stay.

    Needs the columns doc_id, text, source and lang. Secrets are masked where they stand: a word that is a value
    somewhere stays in prose. ``n_chars``, if there, is counted anew. Null and empty texts, null ids, rows that repeat,
    texts that hold the mask and empty tables are fine.
    """
    at = unused("__secret", docs)
    known = unused("__secrets", docs)
    key = F.sha2(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)
    scanned = scan(docs.select(key.alias("doc_id"), "text", "source", "lang"))
    owned = F.array_distinct(F.transform("added", lambda s: s["value"]))
    masks = saved(scanned.where(F.size("added") > 0).groupBy("doc_id").agg(F.min(owned).alias("values")))
    maybe, clean = apart(docs.withColumn(at, key), masks.select(F.col("doc_id").alias("key")), at)
    joined = maybe.join(masks.select(F.struct("doc_id", "values").alias(known)), F.col(at) == F.col(f"{known}.doc_id"), "left")
    joined = joined.withColumn("text", masked_base(F.col("text"), mask))
    joined = joined.withColumn("text", F.when(F.col(known).isNotNull(), masked_values(F.col("text"), F.col(f"{known}.values"), mask)).otherwise(F.col("text")))
    out = joined.select(*docs.columns).unionByName(clean.withColumn("text", masked_base(F.col("text"), mask)).select(*docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*docs.columns)
