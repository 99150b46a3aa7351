"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, however few; blank lines have none and stay. Lines whose sets are equal are one
class; its first line stays. Classes are joined by Jaccard similarity: tokens are ordered by rarity in the corpus, so two
similar sets must share a token of their short prefixes; length, position and a parity bitmap bound the overlap of the
pairs that do, and the rest is verified on the words themselves. A class that is similar to an earlier one goes with all
its lines.

A token that many lines hold makes no key by itself: similar sets share a second token in prefixes longer by one, so the
two tokens together are the key. It is enough to know whether an earlier similar line exists, so each line first meets
the nearest passing candidate for each key, is compared with the one it meets most often, then with the others, and
meets all of them only if none of those is similar: a group of n near copies costs about n pairs. What many rows of one key would make too large for a task is dealt to blocks; lines that found
nothing in theirs then ask in all.

Rows travel as arrays packed into binary columns, a few per task, which costs a fraction of a row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import apart, discard, narrow_batches, release, saved, tidy, unused, width, written

#: Similarity as a fraction, so that comparisons are exact.
UP, DOWN = 4, 5
#: A set of fewer tokens is similar to none but its equals: it needs a class and no postings.
LEAST_SIMILAR = 4
#: Counters of the rarity table, whatever the number of tokens: 16 MB. Tokens that share a counter look more frequent.
COUNTERS = 1 << 22
CHUNKS = 64
#: Tables of flags keep rows out of shuffles that can't concern them: so many bits for each value, as powers of two.
FLAG_BITS = (16, 27)
#: A more frequent token needs a second one to make a key.
GROUP = 4096
#: Rows of one key that a task takes; the rows of a more frequent key are dealt to blocks.
SPLIT = 1 << 18
#: Bytes of text that are taken apart at once, pairs that are compared at once, and bytes that a task gathers.
STEP, PAIRS, GATHERED = 1 << 20, 1 << 18, 1 << 25
#: Sets in one packed value: small enough for the JVM to move about.
TOGETHER = 1 << 12
#: Words that are hashed at once, and the longest one whose bytes are taken as two integers.
STRIDE, TWO = 1 << 14, 16
#: Classes whose first line a task remembers while it reads.
SEEN = 1 << 14

MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX2
    return x ^ x >> np.uint64(29)


#: What is left of an integer's bytes for each number of them.
HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], "u8")


def stirred(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits in which every bit depends on all."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Words:
    """The words of some bytes, parted by ASCII white space: where they ``start``, and the halves of their 128-bit hashes.

    A word of up to ``TWO`` bytes is two integers and its length, which no other word has; these are mixed, all words at
    once. Longer words are hashed one by one.
    """

    def __init__(self, data: bytes):
        buf = np.frombuffer(data, "u1")
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(buf) and not space[0]:
            edges = np.append(0, edges)
        if len(buf) and not space[-1]:
            edges = np.append(edges, len(buf))
        self.data, self.start, self.length = data, edges[0::2], edges[1::2] - edges[0::2]
        long = np.flatnonzero(self.length > TWO).tolist()
        self.long = long, [xxhash.xxh3_128_intdigest(data[(a := int(self.start[i])) : a + int(self.length[i])]) for i in long]

    def half(self, first: int) -> np.ndarray:
        """One of the two hashes."""
        view = np.ndarray((len(self.data) + 9,), "<u8", self.data + bytes(16), 0, (1,))
        out = np.empty(len(self.start), "u8")
        salt = np.uint64(0x9E3779B97F4A7C15 * (first + 1) & 0xFFFFFFFFFFFFFFFF)
        for i in range(0, len(out), STRIDE):
            at, n = self.start[i : i + STRIDE], self.length[i : i + STRIDE]
            one = view[at] & HEADS[np.minimum(n, 8)]
            two = view[at + 8] & HEADS[np.minimum(np.maximum(n - 8, 0), 8)]
            out[i : i + STRIDE] = stirred(stirred(one ^ salt) * MIX2 + stirred(two + salt) + n.view("u8") * MIX)
        rows, hashes = self.long
        out[rows] = [h >> 64 * first & 0xFFFFFFFFFFFFFFFF for h in hashes]
        return out


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start, and their 64-bit hashes."""
    words = Words(data)
    return words.start, words.half(0)


def tag_of(text: bytes) -> int:
    """Tells apart texts of one id: the upper half of a line's number."""
    return (zlib.crc32(text) & 0x7FFFFFFF) << 32


def runs(column: pa.Array, cut: bool = True) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """A column's texts in runs of about ``STEP`` bytes: rows, numbers of the first lines, and bytes. Long texts are cut at line ends."""
    rows, numbers, parts, held = [], [], [], 0
    for r in range(len(column)):
        text = column[r].as_py() or b""
        tag, at, no = tag_of(text) if cut else 0, 0, 0
        while True:
            end = text.find(b"\n", at + STEP) if cut and len(text) - at > STEP else -1
            part = text[at:] if end < 0 else text[at:end]
            rows.append(r)
            numbers.append(tag + no)
            parts.append(part)
            held += len(part)
            if held >= STEP:
                yield rows, numbers, parts
                rows, numbers, parts, held = [], [], [], 0
            if end < 0:
                break
            no += part.count(b"\n") + 1
            at = end + 1
    if parts:
        yield rows, numbers, parts


class LineTokens:
    """The words of a run's lines: ``token``, ``other()`` (another hash) and ``owner`` of each, and the owners' rows and numbers.

    Only lines with a word are owners.
    """

    cut = True

    def __init__(self, rows: list[int], numbers: list[int], parts: list[bytes]):
        data = b"\n".join(parts)
        self.words = Words(data)
        start, self.token = self.words.start, self.words.half(0)
        ends = np.flatnonzero(np.frombuffer(data, "u1") == 10)
        line = np.searchsorted(ends, start)
        new = np.append(True, line[1:] != line[:-1])[: len(line)]
        self.owner, used = np.cumsum(new) - 1, line[new]
        counts = np.array([p.count(b"\n") + 1 for p in parts])
        part = np.repeat(np.arange(len(parts)), counts)[used]
        self.rows = np.array(rows)[part]
        self.numbers = np.array(numbers)[part] + used - (np.cumsum(counts) - counts)[part]


    def other(self) -> np.ndarray:
        return self.words.half(1)


class Sets:
    """Distinct tokens by owner, the rarest first, ties by token."""

    def __init__(self, token: np.ndarray, other: np.ndarray, owner: np.ndarray, owners: int, spread: np.ndarray):
        count = np.minimum(spread[counter_of(token)], (1 << 20) - 1).astype("u8")
        if owners < 1 << 16:  # one integer that sorts by itself, unless it can't tell two tokens apart
            both = owner.view("u8") << np.uint64(48) | count << np.uint64(28) | token >> np.uint64(36)
            order = np.argsort(both)
            both, sorted_token = both[order], token[order]
            clash = ((both[1:] == both[:-1]) & (sorted_token[1:] != sorted_token[:-1])).any()
        if owners >= 1 << 16 or clash:
            order = np.lexsort((token, count, owner))
        token, other, owner, count = token[order], other[order], owner[order], count[order]
        new = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))[: len(token)]
        self.token, self.other, self.owner, self.count = token[new], other[new], owner[new], count[new]
        self.sizes = np.bincount(self.owner, minlength=owners)
        self.starts = np.cumsum(self.sizes) - self.sizes


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(42)).view("i8")


def sums(parts: DataFrame) -> DataFrame:
    """``(chunk, counts)`` tables of unsigned integers, added up chunk by chunk; no sum overflows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_py(), "u4")
                total[chunk] = np.minimum(total[chunk].astype("u8") + own, 0xFFFFFFFF).astype("u4") if chunk in total else own
        for chunk, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["chunk", "counts"])

    return parts.repartitionById(CHUNKS, "chunk").mapInArrow(tidy(add), "chunk int, counts binary")


def counted(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How many keys fall to each counter: a table of fixed size (16 MB), summed chunk by chunk."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(COUNTERS, "u4"), []
        for batch in batches:
            for keys in keys_of(batch):
                held.append(counter_of(keys).astype("u4"))
                if sum(map(len, held)) >= COUNTERS // 2:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS).astype("u4")
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS).astype("u4")
        parts = total.reshape(CHUNKS, -1)
        for i in range(CHUNKS):
            if parts[i].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], ["chunk", "counts"])

    out = np.zeros((CHUNKS, COUNTERS // CHUNKS), "u4")
    for chunk, counts in sums(rows.mapInArrow(tidy(tally), "chunk int, counts binary")).collect():
        out[chunk] = np.frombuffer(counts, "u4")
    return out.reshape(-1)


def rarity(texts: DataFrame, take: type = LineTokens) -> np.ndarray:
    """How often the tokens of each counter occur in all texts."""

    def tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for run in runs(batch.column(1), take.cut):
            yield take(*run).token

    return counted(texts, tokens)


def flags_at(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each value."""
    return (values * MIX >> np.uint64(64 - bits)).view("i8"), (values * MIX2 >> np.uint64(64 - bits)).view("i8")


def flagged(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether values may be among those that ``flags`` was made of."""
    a, b = (flags[at >> 3] >> (at & 7).astype("u1") & 1 for at in flags_at(values, len(flags).bit_length() + 2))
    return (a & b).astype(bool)


def flags_of(rows: DataFrame, values_of: Callable[[pa.RecordBatch], np.ndarray], count: int) -> np.ndarray:
    """A bit table, of 16 MB at most, in which every value has its two bits: what others can be left out by."""
    bits = min(max(FLAG_BITS[0], (16 * count).bit_length()), FLAG_BITS[1])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 3), "u1")
        for batch in batches:
            for at in flags_at(values_of(batch), bits):
                np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype("u1"))
        parts = table.reshape(16, -1)
        full = [i for i in range(16) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([parts[i].tobytes() for i in full], pa.binary())], ["chunk", "bits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(own.as_py(), "u1")
                total[chunk] = total[chunk] | own if chunk in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "bits"])

    shape = "chunk int, bits binary"
    out = np.zeros((16, 1 << (bits - 7)), "u1")
    for chunk, own in rows.mapInArrow(tidy(mark), shape).repartitionById(16, "chunk").mapInArrow(tidy(add), shape).collect():
        out[chunk] = np.frombuffer(own, "u1")
    return out.reshape(-1)


def line_key(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return doc.view("u8") * MIX2 ^ line.view("u8")


def ends_key(batch: pa.RecordBatch) -> np.ndarray:
    return line_key(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)))


def prefix_length(sizes: np.ndarray) -> np.ndarray:
    """Tokens of which two similar sets share one, at least: all but those that must be shared, and one.

    None for sets that only their equals are similar to.
    """
    return np.where(sizes < LEAST_SIMILAR, 0, sizes - (sizes * UP + DOWN - 1) // DOWN + 1)


#: A set without its prefix: digest, its line, how many tokens it has, how many of its rarest occur nowhere else, how many prefix tokens follow.
HEAD = np.dtype([("hi", "u8"), ("lo", "u8"), ("doc", "i8"), ("line", "i8"), ("parity", "u8", (2,)), ("size", "u4"), ("skipped", "u4"), ("held", "u4")])
#: A set under one of its keys.
POSTING = np.dtype([("key", "u8"), ("doc", "i8"), ("line", "i8"), ("parity", "u8", (2,)), ("size", "u4"), ("place", "u2"), ("asks", "?")])


def packed(part: int, *arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([part], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class Firsts:
    """Tells the lines that may be the first of their class from those that aren't, as an equal earlier line was read.

    Remembers the first lines of so many classes; a class that it has forgotten is new to it, which costs a row.
    """

    def __init__(self):
        self.of: dict[tuple[int, int], tuple[int, int]] = {}

    def split(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the heads are kept, and the (doc, line) of those that go; rows that repeat as a whole do neither."""
        order = np.lexsort((heads["line"], heads["doc"], heads["lo"], heads["hi"]))
        h = heads[order]
        first = np.append(True, (h["hi"][1:] != h["hi"][:-1]) | (h["lo"][1:] != h["lo"][:-1]))
        new = np.append(True, first[1:] | (h["doc"][1:] != h["doc"][:-1]) | (h["line"][1:] != h["line"][:-1]))
        again = ~first & new
        lead = np.flatnonzero(first)
        if len(self.of) + len(lead) > SEEN:
            self.of.clear()
        for i, key, end in zip(lead.tolist(), zip(h["hi"][lead].tolist(), h["lo"][lead].tolist(), strict=True), zip(h["doc"][lead].tolist(), h["line"][lead].tolist(), strict=True), strict=True):
            known = self.of.get(key)
            if known is None or end < known:
                self.of[key] = end
            else:
                first[i], again[i] = False, end != known
        return order[first], np.stack([h["doc"][again], h["line"][again]], 1)


def token_sets(texts: DataFrame, spread: Broadcast, parts: int, take: type = LineTokens) -> DataFrame:
    """``(part, heads, tokens, repeats)``: the sets of lines that have a word, dealt by digest.

    A line that equals an earlier one of the same task isn't the first of its class: it leaves as a (doc, line) of
    ``repeats``, dealt anywhere, so a class of any size costs each task a few rows. ``tokens`` are the prefixes, one
    longer than a shared token needs. Tokens that occur once in the corpus can match nothing and are skipped; they come
    first, so a prefix token's place is its index and the number skipped.
    """
    names = ["part", "heads", "tokens", "repeats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in runs(batch.column(1), take.cut):
                t = take(*piece)
                if not len(t.rows):
                    continue
                s = Sets(t.token, t.other(), t.owner, len(t.rows), spread.value)
                place = np.arange(len(s.token)) - np.repeat(s.starts, s.sizes)
                length = prefix_length(s.sizes)
                within = place < np.repeat(np.where(length > 0, length + 1, 0), s.sizes)
                use = within & (s.count > 1)
                heads = np.zeros(len(t.rows), HEAD)
                heads["hi"], heads["lo"] = np.add.reduceat(mixed(s.token), s.starts), np.add.reduceat(mixed(s.other), s.starts)
                heads["doc"], heads["line"] = ids[t.rows], t.numbers
                bit = s.token >> np.uint64(8) & np.uint64(127)
                for k in range(2):
                    heads["parity"][:, k] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)), s.starts)
                heads["size"], heads["held"] = s.sizes, np.bincount(s.owner[use], minlength=len(t.rows))
                heads["skipped"] = np.bincount(s.owner[within], minlength=len(t.rows)) - heads["held"]
                token, begin = s.token[use], np.cumsum(heads["held"], dtype="i8") - heads["held"]
                mine, again = firsts.split(heads)
                to = (heads["hi"][mine] >> np.uint64(20)) % np.uint64(parts)
                mine, to = mine[np.argsort(to, kind="stable")], np.sort(to).astype("i8")
                heads = heads[mine]
                token = token[ranges(begin[mine], heads["held"].astype("i8"))]
                begin = np.append(0, np.cumsum(heads["held"], dtype="i8"))
                cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)]), len(to))
                rows = [(int(to[a]), heads[a:b].tobytes(), token[begin[a] : begin[b]].tobytes(), b"") for a, b in zip(cuts, cuts[1:], strict=False)]
                if len(again):
                    rows.append((int(mixed(line_key(again[:1, 0], again[:1, 1]))[0] % np.uint64(parts)), b"", b"", again.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

    return narrow_batches(texts).mapInArrow(tidy(run), "part int, heads binary, tokens binary, repeats binary")


def classes_of(sets: DataFrame, parts: int) -> DataFrame:
    """``(heads, tokens, repeats)``: the first line of each class with its prefix, and the other lines as (doc, line).

    Classes are told by the 128 bits of their words' hashes.
    """
    names = ["heads", "tokens", "repeats"]

    def row(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tokens, none = [], [], np.zeros(0, HEAD)
        for batch in batches:
            heads += [np.frombuffer(x.as_py(), HEAD) for x in batch.column(1)]
            tokens += [np.frombuffer(x.as_py(), "u8") for x in batch.column(2)]
            again = [np.frombuffer(x.as_py(), "i8") for x in batch.column(3)]
            if any(map(len, again)):
                yield row(none, none, np.concatenate(again))
        heads, tokens = np.concatenate([none, *heads]), np.concatenate([np.zeros(0, "u8"), *tokens])
        if not len(heads):
            return
        begin = np.cumsum(heads["held"], dtype="i8") - heads["held"]
        order = np.lexsort((heads["line"], heads["doc"], heads["lo"], heads["hi"]))
        h = heads[order]
        new = np.append(True, (h["hi"][1:] != h["hi"][:-1]) | (h["lo"][1:] != h["lo"][:-1]) | (h["doc"][1:] != h["doc"][:-1]) | (h["line"][1:] != h["line"][:-1]))
        order, h = order[new], h[new]  # rows that repeat as a whole
        first = np.append(True, (h["hi"][1:] != h["hi"][:-1]) | (h["lo"][1:] != h["lo"][:-1]))
        for at in range(0, len(order), TOGETHER):
            here = first[at : at + TOGETHER]
            mine = order[at : at + TOGETHER][here]
            own, again = heads[mine], np.stack([h["doc"][at : at + TOGETHER][~here], h["line"][at : at + TOGETHER][~here]], 1)
            yield row(own, tokens[ranges(begin[mine], own["held"].astype("i8"))], again)

    return sets.repartitionById(parts, "part").mapInArrow(tidy(run), "heads binary, tokens binary, repeats binary")


def repeats_of(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_py(), "i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1])], ["doc_id", "line"])

    return classes.select("repeats").mapInArrow(tidy(run), "doc_id long, line long")


def keyed(heads: np.ndarray, tokens: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, row and place of all keys of some sets, a prefix token or a frequent one with each that follows it; and how
    many lines may have a key: as many as the lines of its rarest token."""
    held = heads["held"].astype("i8")
    row = np.repeat(np.arange(len(heads)), held)
    index = np.arange(len(tokens)) - np.repeat(np.cumsum(held) - held, held)
    place = index + heads["skipped"][row]
    lead = place < prefix_length(heads["size"].astype("i8"))[row]
    count = spread[counter_of(tokens)]
    hot = count > GROUP
    alone = np.flatnonzero(lead & ~hot)
    both = np.flatnonzero(lead & hot)
    after = held[row[both]] - 1 - index[both]
    one, two = np.repeat(both, after), ranges(both + 1, after)
    key = np.concatenate([mixed(tokens[alone]), mixed(tokens[one] * MIX + mixed(tokens[two]))])
    # With the first two tokens shared, all before the second but one are not: the bound is that of the place before.
    return key, row[np.concatenate([alone, one])], np.concatenate([place[alone], place[two] - 1]), count[np.concatenate([alone, one])]


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, y in zip(batch.column(0), batch.column(1), strict=True):
        if len(heads := np.frombuffer(x.as_py(), HEAD)):
            yield heads, np.frombuffer(y.as_py(), "u8")


def key_counts(classes: DataFrame, spread: Broadcast) -> np.ndarray:
    """How many postings the keys have that may have more than a task takes."""

    def frequent(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for heads, tokens in unpacked(batch):
            key, _, _, most = keyed(heads, tokens, spread.value)
            yield key[most > SPLIT]

    return counted(classes.select("heads", "tokens"), frequent)


def blocks_of(key: np.ndarray, most: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    """To how many blocks the rows of each key are dealt."""
    if counts is None:
        return np.ones(len(key), "i8")
    return np.where(most > SPLIT, np.maximum(1, -(-counts[counter_of(key)].astype("i8") // SPLIT)), 1)


def postings(classes: DataFrame, spread: Broadcast, counts: Broadcast, parts: int, asking: Broadcast | None = None, among: Broadcast | None = None) -> DataFrame:
    """``(part, rows)``: every class under each of its keys, as ``POSTING`` arrays dealt by key.

    The rows of a key are dealt to blocks by ``counts``, the frequent keys' counters (None: there is none). ``asking``: flags of the lines
    that ask, which then stand in all blocks; ``among``: flags of the keys that are wanted. Flags let a few others
    through, which costs work but changes no result. Keys are hashes: a clash brings pairs together that verification
    parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for heads, tokens in unpacked(batch):
                key, row, place, most = keyed(heads, tokens, spread.value)
                own = line_key(heads["doc"], heads["line"])
                asks = np.ones(len(heads), bool) if asking is None else flagged(asking.value, own)
                if among is not None:
                    use = flagged(among.value, key)
                    key, row, place, most = key[use], row[use], place[use], most[use]
                n = blocks_of(key, most, counts.value)
                if n.max(initial=1) > 1:
                    block = (mixed(own[row]) % n.view("u8")).view("i8")
                    if asking is not None:  # a line that asks stands in all blocks
                        times = np.where(asks[row], n, 1)
                        at = np.repeat(np.arange(len(key)), times)
                        block = np.where(asks[row[at]], np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times), block[at])
                        key, row, place = key[at], row[at], place[at]
                    key = key ^ block.view("u8") * MIX
                to = (mixed(key) % np.uint64(parts)).view("i8")
                out = np.empty(len(key), POSTING)
                out["key"], out["place"], out["asks"] = key, np.minimum(place, 0xFFFF), asks[row]
                for n in ("doc", "line", "parity", "size"):
                    out[n] = heads[n][row]
                order = np.argsort(to, kind="stable")
                out, to = out[order], to[order]
                cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)) if len(to) else [0]
                rows = [(int(to[a]), out[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "rows"])

    return classes.select("heads", "tokens").mapInArrow(tidy(run), "part int, rows binary")


def asked_keys(classes: DataFrame, spread: Broadcast, asking: Broadcast) -> tuple[DataFrame, Callable, int]:
    """What ``flags_of`` needs to flag the keys of the lines that ask."""

    def values(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0, "u8")]
        for heads, tokens in unpacked(batch):
            key, row, _, _ = keyed(heads, tokens, spread.value)
            out.append(key[flagged(asking.value, line_key(heads["doc"], heads["line"]))[row]])
        return np.concatenate(out)

    return classes.select("heads", "tokens"), values, 1 << 24


def passing(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of postings of one key that pass the length, position and parity filters."""
    sx, sy = c["size"][x], c["size"][y]
    need = (UP * (sx + sy) + UP + DOWN - 1) // (UP + DOWN)
    ok = np.flatnonzero((np.minimum(sx - c["place"][x], sy - c["place"][y]) >= need) & (DOWN * sy >= UP * sx) & (DOWN * sx >= UP * sy))
    x, y, spare = x[ok], y[ok], (sx + sy - 2 * need)[ok]
    # Every token in only one of the two sets turns one bit: the bits that differ are at most so many.
    turned = sum(np.bitwise_count(c[p][x] ^ c[p][y]).astype("i8") for p in ("parity0", "parity1"))
    ok = (turned <= spare) & ((c["doc"][x] != c["doc"][y]) | (c["line"][x] != c["line"][y]))
    return x[ok], y[ok]


def matched(c: np.ndarray, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that ask, earlier rows of the same key that pass the filters, and whether others of them were left out.

    ``c`` is in the order of (key, doc, line). Either all such pairs, or for each row the nearest one before it: it
    then looks on until it knows whether there is another.
    """
    n = len(c)
    starts = np.flatnonzero(np.append(True, c["key"][1:] != c["key"][:-1])[:n])
    of = {k: np.ascontiguousarray(c[k]) for k in ("doc", "line")} | {k: c[k].astype("i8") for k in ("size", "place")} | {f"parity{k}": np.ascontiguousarray(c["parity"][:, k]) for k in range(2)}
    before = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    active = np.flatnonzero((before > 0) & c["asks"])
    found, nearest = np.zeros(n, "u1"), np.zeros(n, "i8")
    done = 0
    while len(active):
        wide = max(1, PAIRS // len(active))
        for at in range(0, len(active), PAIRS):
            mine = active[at : at + PAIRS]
            many = np.minimum(before[mine] - done, wide)
            x = np.repeat(mine, many)
            y = x - done - 1 - ranges(np.zeros(len(mine), "i8"), many)
            x, y = passing(of, x, y)
            if every:
                yield x, y, np.zeros(len(x), bool)
            elif len(x):
                lead = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                first = lead[found[x[lead]] == 0]
                nearest[x[first]] = y[first]
                found[x[lead]] = np.minimum(found[x[lead]] + np.diff(np.append(lead, len(x))), 2)
        done += wide
        active = active[(before[active] > done) & (found[active] < 2)]
    rows = np.flatnonzero(found)
    for at in range(0, len(rows), PAIRS):
        x = rows[at : at + PAIRS]
        yield x, nearest[x], found[x] > 1


PAIR = "doc_id long, line long, to_doc long, to_line long, more boolean"
ENDS = ["doc_id", "line", "to_doc", "to_line"]


def gathered(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """All postings of a task whose key isn't alone, by (key, doc, line)."""
    own = [np.frombuffer(x.as_py(), POSTING) for batch in batches for x in batch.column(1)]
    if not own:
        return np.zeros(0, POSTING)
    c = np.concatenate(own)
    c = c[np.argsort(c["key"])]
    same = c["key"][1:] == c["key"][:-1]
    c = c[np.append(False, same)[: len(c)] | np.append(same, False)[: len(c)]]
    return c[np.lexsort((c["line"], c["doc"], c["key"]))]


def candidates(posted: DataFrame, parts: int, every: bool) -> DataFrame:
    """Pairs of an asking line and an earlier one that pass the filters.

    ``more``: others may have been left out; ``keys``: under how many keys the two met.
    """
    names = [x.split()[0] for x in PAIR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = gathered(batches)
        for x, y, more in matched(c, every):
            columns = [c["doc"][x], c["line"][x], c["doc"][y], c["line"][y], more]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names)

    pairs = posted.repartitionById(parts, "part").mapInArrow(tidy(run), PAIR)
    return pairs.groupBy(*ENDS).agg(F.max("more").alias("more"), F.count("*").alias("keys"))


def line_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(doc_id, line, words)``: the lines in ``pairs``, and a few others, read from their texts."""
    ends = saved(pairs.select("doc_id", "line").unionByName(pairs.select(F.col("to_doc").alias("doc_id"), F.col("to_line").alias("line"))).distinct())
    holding, _ = apart(texts, ends.select(F.col("doc_id").alias("key")), "doc_id")
    wanted = texts.sparkSession.sparkContext.broadcast(flags_of(ends, ends_key, ends.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, numbers, parts in runs(batch.column(1)):
                counts = [p.count(b"\n") + 1 for p in parts]
                own, no = np.repeat(ids[rows], counts), ranges(np.array(numbers), np.array(counts))
                at = np.flatnonzero(flagged(wanted.value, line_key(own, no)))
                found = b"\n".join(parts).split(b"\n") if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(no[at]), pa.array([found[i] for i in at.tolist()], pa.binary())], ["doc_id", "line", "words"])

    found = narrow_batches(holding).mapInArrow(tidy(run), "doc_id long, line long, words binary")
    # Rows that repeat as a whole give a line twice.
    return written(found.groupBy("doc_id", "line").agg(F.min("words").alias("words")))


def ends_of(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lines of documents that ``pairs`` may name."""
    return apart(lines, pairs.select(F.col("doc_id").alias("key")).unionByName(pairs.select(F.col("to_doc").alias("key"))), "doc_id")[0]


def similar(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``(doc_id, line)`` of the lines of ``pairs`` whose set of words is similar enough to that of the other line."""
    right = lines.select(F.col("doc_id").alias("to_doc"), F.col("line").alias("to_line"), F.col("words").alias("others"))
    both = pairs.join(lines, ["doc_id", "line"]).join(right, ["to_doc", "to_line"]).select("doc_id", "line", "words", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = set(x.as_py().split()), set(y.as_py().split())
                keep.append((UP + DOWN) * len(a & b) >= UP * (len(a) + len(b)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["doc_id", "line"])

    return both.mapInArrow(tidy(run), "doc_id long, line long").distinct()


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, tag, drops)``: the numbers of the lines that go, as their sets equal or are similar to those of earlier lines.

    Earlier means by (doc_id, text, line number); texts of one id are told apart by a checksum, ``tag``, and rows of one
    id and text are one document. Any earlier line counts, whether it stays itself or not. Rows without an id are left
    alone; null and empty texts have no lines to remove.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = narrow_batches(docs.where(docs[id_column].isNotNull()).select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("binary").alias("text")))
    counts = rarity(texts)
    words, spread = int(counts.sum(dtype="u8")), share(counts)
    parts = max(width(texts), 8 * words // GATHERED)
    classes = written(classes_of(token_sets(texts, spread, parts), parts))
    release(spark)
    parts = max(width(texts), 6 * words // GATHERED)
    frequent = key_counts(classes, spread) if (counts > SPLIT).any() else np.zeros(1, "u4")
    split = bool((frequent > SPLIT).any())
    frequent = share(frequent if split else None)
    names = ["doc_id", "line"]
    pairs = saved(candidates(postings(classes, spread, frequent, parts), parts, False))
    release(spark)
    lines = line_texts(pairs, texts)
    best = F.max(F.struct("keys", F.bitwise_not("to_doc").alias("d"), "to_doc", "to_line")).alias("x")
    nearest = saved(pairs.groupBy(*names).agg(best, F.max("more").alias("more")).select(*names, "x.to_doc", "x.to_line", "more"))
    gone = saved(similar(nearest, lines))
    others = pairs.join(gone, names, "left_anti").join(nearest, ENDS, "left_anti").select(ENDS)
    gone = saved(gone.unionByName(similar(others, ends_of(lines, others))))
    left = saved(nearest.where("more").select(*names).join(gone, names, "left_anti"))
    discard(lines)
    if split:  # lines that have met the rows of their own block only
        left = saved(left.unionByName(in_blocks(classes, spread, frequent)).distinct().join(gone, names, "left_anti"))
    if not left.isEmpty():
        asking = share(flags_of(left, ends_key, left.count()))
        among = share(flags_of(*asked_keys(classes, spread, asking)))
        second = saved(candidates(postings(classes, spread, frequent, parts, asking, among), parts, True).join(left, names, "left_semi").join(pairs, ENDS, "left_anti").select(ENDS))
        lines = line_texts(second, texts)
        gone = saved(gone.unionByName(similar(second, lines)))
        discard(lines)
    gone = gone.unionByName(repeats_of(classes))
    number, tag = F.col("line").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int"), F.shiftright("line", 32)
    out = saved(gone.groupBy("doc_id", tag.alias("tag")).agg(F.collect_set(number).alias("drops")))
    discard(classes)
    for b in (spread, frequent):
        b.unpersist()
    release(spark)
    return out


def in_blocks(classes: DataFrame, spread: Broadcast, counts: Broadcast) -> DataFrame:
    """``(doc_id, line)`` of the classes that have a key whose rows are dealt to several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for heads, tokens in unpacked(batch):
                key, row, _, most = keyed(heads, tokens, spread.value)
                own = heads[np.unique(row[blocks_of(key, most, counts.value) > 1])]
                yield pa.RecordBatch.from_arrays([pa.array(own["doc"]), pa.array(own["line"])], ["doc_id", "line"])

    return classes.select("heads", "tokens").mapInArrow(tidy(run), "doc_id long, line long")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines; the columns stay, and ``n_chars``, if there, is counted anew.

    All documents stay, even those left empty. A document without repeated lines isn't moved between tasks.
    """
    at = unused("__dedup_lines", docs)  # one struct beside the user's columns
    drops = repeated_lines(docs).select(F.struct("doc_id", "tag", "drops").alias(at))
    touched, rest = apart(docs, drops.select(F.col(f"{at}.doc_id").alias("key")), "doc_id")
    tag = F.crc32(touched["text"].cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    joined = touched.join(drops, (touched["doc_id"].cast("long") == drops[f"{at}.doc_id"]) & (tag == drops[f"{at}.tag"]), "left")
    shape, where, struct = joined.schema, joined.columns.index("text"), joined.columns.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column(struct).field("drops") if batch.num_rows else []
            texts = []
            for text, gone in zip(batch.column(where), lost, strict=True):
                value, numbers = text.as_py(), gone.as_py()
                if numbers and value is not None:
                    numbers = set(numbers)
                    value = "\n".join([x for i, x in enumerate(value.split("\n")) if i not in numbers])
                texts.append(value)
            yield batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))

    changed = narrow_batches(joined).mapInArrow(tidy(run), shape)
    out = changed.select(*docs.columns).unionByName(rest.select(*docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*docs.columns)


def report(deduped: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_chars, text_sha256)`` of the texts that remain."""
    text = F.coalesce("text", F.lit(""))
    return deduped.select("doc_id", F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))
