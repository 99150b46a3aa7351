"""Near-duplicate documents by SimHash links and an exact join: five-word shingles, Jaccard similarity 0.8 or more.

SimHash (``simhash.links``, over five-word shingles) finds near copies cheaply, but no radius that can be probed finds
all pairs of similarity 0.8: they differ in 5 to 14 of 64 bits. So each of its links is verified on the texts, and the
set-similarity join of line dedup, with a document for a line and its shingles for the words, finds the others.
Documents of equal sets are one class, and its first stands for it. Groups are the components over all similar pairs.
Each class first meets a few candidates of each of its keys; of the others only those count that the links so far leave
in another component, so a group of n near copies costs about n pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonequarry.llm import lines, simhash
from tonequarry.llm.common import apart, discard, narrow_batches, release, saved, tidy, unused, width, written
from tonequarry.llm.components import components
from tonequarry.llm.lines import DOWN, GATHERED, MIX, POSTING, UP, Words, ends_key, flags_of, mixed

WORDS = 5


class Shingles:
    """The shingles of a run of texts: ``token``, ``other()`` (another hash) and ``owner`` of each, and the owners' rows and numbers.

    Words are lower-cased and parted as for op2; a text of fewer words than a shingle is one shingle; texts without
    words are left out.
    """

    cut = False

    def __init__(self, rows: list[int], numbers: list[int], parts: list[bytes]):
        data = b"\n".join(parts).lower()
        self.words = Words(data)
        start = self.words.start
        ends = np.cumsum([len(p) + 1 for p in parts])
        text = np.searchsorted(ends, start, "right")
        n = np.bincount(text, minlength=len(parts))
        after = np.cumsum(n)[text]  # the first word of the next text
        at = np.arange(len(start))
        use = np.flatnonzero((at + WORDS <= after) | ((n[text] < WORDS) & (at == after - n[text])))
        self.use, self.after = use, after[use]
        self.token = self.rolled(0)
        held = np.flatnonzero(n)
        self.owner = (np.cumsum(n > 0) - 1)[text[use]]
        self.rows = np.array(rows)[held]
        self.numbers = np.array([lines.tag_of(parts[i]) for i in held.tolist()], "i8")

    def rolled(self, half: int) -> np.ndarray:
        """One of the two hashes of each shingle, from those of its words."""
        word, out = self.words.half(half), np.zeros(len(self.use), "u8")
        for i in range(WORDS):
            where, inside = np.minimum(self.use + i, len(word) - 1), self.use + i < self.after
            out = mixed(out * MIX + np.where(inside, word[where], np.uint64(i)))
        return out

    def other(self) -> np.ndarray:
        return self.rolled(1)


def number_of(text: Column) -> Column:
    """What tells apart texts of one id, as ``lines.tag_of``."""
    return F.shiftleft(F.crc32(text).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), 32)


def prints(texts: DataFrame) -> DataFrame:
    """``(doc_id, line, fp)``: SimHash fingerprints over five-word shingles of the texts that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in lines.runs(batch.column(1), False):
                s = Shingles(*piece)
                first = np.flatnonzero(np.append(True, s.owner[1:] != s.owner[:-1])[: len(s.owner)])
                out = []
                for a, b in zip(first, [*first[1:], len(s.token)], strict=False):
                    counts = np.zeros(simhash.BITS, "i8")
                    for k in range(a, b, 1 << 15):
                        own = s.token[k : min(b, k + (1 << 15))].astype(">u8")
                        counts += np.unpackbits(own.view("u1")).reshape(-1, simhash.BITS).sum(0, dtype="i4")
                    out.append(np.packbits(2 * counts > b - a).view(">i8")[0])
                yield pa.RecordBatch.from_arrays([pa.array(ids[s.rows]), pa.array(s.numbers), pa.array(np.array(out, "i8"))], ["doc_id", "line", "fp"])

    return texts.mapInArrow(tidy(run), "doc_id long, line long, fp long")


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """Documents whose fingerprints are equal or linked: each with the first of its own fingerprint, and those first ones with each other."""
    found = saved(prints(texts))
    firsts = saved(found.groupBy("fp").agg(F.min(F.struct("doc_id", "line")).alias("x")))
    near = simhash.links(firsts.select("fp"))
    a, b = (firsts.select(F.col("fp").alias(n), F.col("x").alias(f"x{n}")) for n in "ab")
    linked = near.join(a, "a").join(b, "b").select(F.greatest("xa", "xb").alias("x"), F.least("xa", "xb").alias("y"))
    same = found.join(firsts.hint("merge"), "fp").select(F.struct("doc_id", "line").alias("x"), F.col("x").alias("y")).where("x <> y")
    both = linked.unionByName(same).distinct()
    return saved(both.select("x.doc_id", "x.line", F.col("y.doc_id").alias("to_doc"), F.col("y.line").alias("to_line")))


PAIR = ["doc_id", "line", "to_doc", "to_line"]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose shingle sets, made of the texts themselves, are similar enough."""
    ends = saved(pairs.select("doc_id", "line").unionByName(pairs.select(F.col("to_doc").alias("doc_id"), F.col("to_line").alias("line"))).distinct())
    holding, _ = apart(texts, ends.select(F.col("doc_id").alias("key")), "doc_id")
    # Rows that repeat as a whole give a text twice.
    own = holding.withColumn("line", number_of(F.col("text"))).join(ends, ["doc_id", "line"], "left_semi").groupBy("doc_id", "line").agg(F.min("text").alias("words"))
    own = written(own)
    right = own.select(F.col("doc_id").alias("to_doc"), F.col("line").alias("to_line"), F.col("words").alias("others"))
    both = pairs.join(own, ["doc_id", "line"]).join(right, ["to_doc", "to_line"]).select(*PAIR, "words", "others")

    def shingles(text: bytes) -> set:
        found = text.lower().split()
        return set(zip(*(found[i:] for i in range(WORDS)), strict=False)) if len(found) >= WORDS else {tuple(found)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                a, b = shingles(x.as_py()), shingles(y.as_py())
                keep.append((UP + DOWN) * len(a & b) >= UP * (len(a) + len(b)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(PAIR)

    out = saved(both.mapInArrow(tidy(run), "doc_id long, line long, to_doc long, to_line long"))
    discard(own)
    return out


ROOTED = np.dtype([*POSTING.descr, ("root", "i8")])
ROWS = "key long, doc_id long, line long, parity0 long, parity1 long, size int, place int"


def across(posted: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """Pairs of postings of one key and different ``root`` that pass the filters.

    In each group the rows of its commonest root come first and don't ask, so the pairs looked at are those of the others.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1):
                c = np.frombuffer(x.as_py(), POSTING)
                columns = [c["key"].copy().view("i8"), c["doc"].copy(), c["line"].copy(), *(c["parity"][:, k].copy().view("i8") for k in range(2)), c["size"].astype("i4"), c["place"].astype("i4")]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], [n.split()[0] for n in ROWS.split(", ")])

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names)}
            c = np.zeros(batch.num_rows, ROOTED)
            c["key"] = v["key"].view("u8")
            for k in range(2):
                c["parity"][:, k] = v[f"parity{k}"].view("u8")
            c["doc"], c["line"], c["size"], c["place"], c["root"] = v["doc_id"], v["line"], v["size"], v["place"], v["root"]
            to = (mixed(c["key"]) % np.uint64(parts)).view("i8")
            order = np.argsort(to, kind="stable")
            c, to = c[order], to[order]
            cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)) if len(to) else [0]
            found = [(int(to[a]), c[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.binary())], ["part", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(x.as_py(), ROOTED) for batch in batches for x in batch.column(1)]
        if not own:
            return
        c = np.concatenate(own)
        c = c[np.lexsort((c["root"], c["key"]))]
        # How often each row's root stands in its group, and the most that any does.
        both = np.append(True, (c["key"][1:] != c["key"][:-1]) | (c["root"][1:] != c["root"][:-1]))
        group = np.append(True, c["key"][1:] != c["key"][:-1])
        run_no, group_no = np.cumsum(both) - 1, np.cumsum(group) - 1
        times = np.bincount(run_no)
        lead = np.flatnonzero(both)
        best = np.full(group_no[-1] + 1, -1, "i8")
        order = np.lexsort((-lead, times))  # the last one written is the largest, and the first of equals
        best[group_no[lead[order]]] = order
        c["asks"] = best[group_no] != run_no
        c = c[np.lexsort((c["line"], c["doc"], c["asks"], c["key"]))]
        for x, y, _ in lines.matched(c, True):
            ok = c["root"][x] != c["root"][y]
            x, y = x[ok], y[ok]
            later = (c["doc"][x] > c["doc"][y]) | ((c["doc"][x] == c["doc"][y]) & (c["line"][x] > c["line"][y]))
            a, b = np.where(later, x, y), np.where(later, y, x)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (c["doc"][a], c["line"][a], c["doc"][b], c["line"][b])], PAIR)

    unrolled = posted.mapInArrow(tidy(rows), ROWS).join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    rooted = unrolled.withColumn("root", F.coalesce("root", "doc_id"))
    packed = rooted.mapInArrow(tidy(roll), "part int, rows binary")
    return packed.repartitionById(parts, "part").mapInArrow(tidy(run), "doc_id long, line long, to_doc long, to_line long").distinct()


def as_links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("doc_id").alias("a"), F.col("to_doc").alias("b"))


def near_copies(classes: DataFrame, texts: DataFrame, spread, parts: int) -> DataFrame:
    """``(doc_id, line)`` of the classes in a component with a smaller id."""
    spark = texts.sparkSession
    share = spark.sparkContext.broadcast
    copies = lines.repeats_of(classes)
    found = verified(simhash_pairs(texts).join(copies, ["doc_id", "line"], "left_anti").join(copies.toDF("to_doc", "to_line"), ["to_doc", "to_line"], "left_anti"), texts)
    release(spark)
    blocks = share(None)
    pairs = saved(lines.candidates(lines.postings(classes, spread, blocks, parts), parts, False))
    release(spark)
    found = found.unionByName(verified(pairs.select(*PAIR).join(found, PAIR, "left_anti"), texts))
    roots = saved(components(as_links(found)))
    more = saved(pairs.where("more").select("doc_id", "line").distinct())
    if not more.isEmpty():
        asking = share(flags_of(more, ends_key, more.count()))
        among = share(flags_of(*lines.asked_keys(classes, spread, asking)))
        second = across(lines.postings(classes, spread, blocks, parts, None, among), roots, parts)
        second = saved(second.join(pairs, PAIR, "left_anti"))
        if not second.isEmpty():
            found = found.unionByName(verified(second, texts))
            roots = saved(components(as_links(found)))
    blocks.unpersist()
    ends = found.select("doc_id", "line").unionByName(found.select(F.col("to_doc").alias("doc_id"), F.col("to_line").alias("line"))).distinct()
    return saved(ends.join(roots.where("node <> root").select(F.col("node").alias("doc_id")), "doc_id", "left_semi"))


def later(docs: DataFrame) -> DataFrame:
    """``(key, line)``: ids and text numbers of all documents but the first of each group of near duplicates.

    Texts without words, null ones too, are one group. Rows without an id are left alone. Texts of one id are told
    apart by a checksum; a group's first document is that of the smallest id.
    """
    spark = docs.sparkSession
    texts = narrow_batches(docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text")))
    counts = lines.rarity(texts, Shingles)
    spread = spark.sparkContext.broadcast(counts)
    parts = max(width(texts), 8 * int(counts.sum(dtype="u8")) // GATHERED)
    classes = written(lines.classes_of(lines.token_sets(texts, spread, parts, Shingles), parts))
    release(spark)
    near = near_copies(classes, texts, spread, parts)
    wordless = texts.where(~F.col("text").cast("string").rlike(r"[^\t-\r ]")).select("doc_id", number_of(F.col("text")).alias("line"))
    least = wordless.agg(F.min("doc_id")).first()[0]
    gone = lines.repeats_of(classes).unionByName(near).unionByName(wordless.where(F.col("doc_id") != F.lit(least)))
    out = saved(gone.select(F.col("doc_id").alias("key"), "line").distinct())
    discard(classes)
    spread.unpersist()
    release(spark)
    return out


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without all but the first of each group; columns stay as they are.

    Rows that repeat as a whole are one document, which stands once if it stays. Only documents that may be dropped or
    repeat are joined by id; the texts of the others stay where they are.
    """
    dropped = later(docs)
    number = number_of(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    again = saved(docs.where(docs["doc_id"].isNotNull()).groupBy(docs["doc_id"].cast("long").alias("key"), number.alias("line")).agg(F.count("*").alias("n")).where("n > 1").select("key", "line"))
    maybe, kept = apart(docs, dropped.select("key").unionByName(again.select("key")), "doc_id")
    at = unused("__near", docs)
    gone, repeated = (x.select(F.struct("key", "line").alias(at)) for x in (dropped, again))
    same = (maybe["doc_id"].cast("long") == F.col(f"{at}.key")) & (number_of(F.coalesce(maybe["text"], F.lit("")).cast("binary")) == F.col(f"{at}.line"))
    stay = maybe.join(gone, same, "left_anti")
    if not again.isEmpty():
        one = Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*docs.columns)))
        first = stay.join(repeated, same, "left_semi").withColumn(at, F.row_number().over(one)).where(F.col(at) == 1).drop(at)
        stay = stay.join(repeated, same, "left_anti").unionByName(first)
    return stay.unionByName(kept)
