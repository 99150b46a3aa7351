"""Counts of dictionary words, made in the tasks that read the texts: no token becomes a row.

A task finds the tokens of a block of letters all at once, as places where the kind of letter changes. The letters of a
token of at most 16 are read as two whole numbers and looked up in a table of slots, which compares whole words, not
hashes; longer ones are looked up as they are. Only counts leave the task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonequarry.functions.batches import narrow_batches, trimmed

#: The largest dictionary that goes to the tasks as arrays, by words and by their letters in all.
MOST_WORDS, MOST_LETTERS = 1 << 18, 1 << 23
#: Texts are looked at in blocks of about so many bytes, which end at a blank.
BLOCK = 1 << 21
PACKED = 16

_LETTER, _HYPHEN, _OTHER = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = _LETTER
_KIND[ord("-")] = _HYPHEN
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyz":
    _KIND[_c] = _OTHER
#: Keeps the first letters of 8 bytes that were read at once.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def packed(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of at most 16 letters, none of them zero, as two whole numbers; 16 bytes or more stand behind the last start."""
    eights = np.ndarray((len(letters) - 7,), "<u8", letters, strides=(1,))  # the 8 bytes from each place on
    return eights[starts] & _MASK[np.minimum(lengths, 8)], eights[starts + 8] & _MASK[np.maximum(lengths - 8, 0)]


def _slots(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    mixed = (first ^ (second * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class Dictionary:
    """Words with their flags; those of at most 16 letters in a table of at least four slots a word, longer ones by bytes."""

    def __init__(self, rows: list[tuple[str, bool, bool]]):
        words = [r[0].encode() for r in rows]
        self.words = pa.array([r[0] for r in rows], pa.string())
        self.neg, self.pos = (np.array([bool(r[k]) for r in rows], bool) for k in (1, 2))
        self.longer = {w: i for i, w in enumerate(words) if len(w) > PACKED}
        lengths = np.array([0 if len(w) > PACKED else len(w) for w in words], np.int64)
        letters = np.frombuffer(b"".join(w for w in words if len(w) <= PACKED) + bytes(PACKED), np.uint8)
        self.first, self.second = packed(letters, np.cumsum(lengths) - lengths, lengths)
        self.bits = max(4, int(4 * len(words)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.flatnonzero(lengths)
        at = _slots(self.first[left], self.second[left], self.bits)
        while len(left):  # each round, one word takes each slot that is free and the others go on to the next
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & (len(self.slots) - 1)

    def find(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The place of each token's word, -1 for tokens that aren't in the dictionary."""
        out = np.full(len(starts), -1, np.int64)
        asking = np.flatnonzero(lengths <= PACKED)
        first, second = packed(letters, starts[asking], lengths[asking])
        at = _slots(first, second, self.bits)
        while len(asking):  # to the next slot while another word has this one
            place = self.slots[at]
            taken = place >= 0
            same = taken & (self.first[place] == first) & (self.second[place] == second) if len(self.first) else taken
            out[asking[same]] = place[same]
            on = np.flatnonzero(taken & ~same)
            asking, first, second, at = asking[on], first[on], second[on], (at[on] + 1) & (len(self.slots) - 1)
        if self.longer:
            for i in np.flatnonzero(lengths > PACKED).tolist():
                out[i] = self.longer.get(letters[starts[i] : starts[i] + lengths[i]].tobytes(), -1)
        return out


def _points(letters: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Code points of the characters beyond ASCII whose first bytes stand at ``lead``; the text goes on behind each."""
    first, top = letters[lead].astype(np.int64), len(letters) - 1
    more = [(letters[np.minimum(lead + i, top)] & 0x3F).astype(np.int64) for i in (1, 2, 3)]
    two = (first & 0x1F) << 6 | more[0]
    three = (first & 0x0F) << 12 | more[0] << 6 | more[1]
    return np.where(first < 0xE0, two, np.where(first < 0xF0, three, (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]))


def _leads(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First bytes of the characters that hold the bytes at ``at``."""
    for _ in range(3):
        at = np.where(letters[at] & 0xC0 == 0x80, at - 1, at)
    return at


@cache
def _kind(point: int) -> int:
    """1: a letter or digit, which belongs to a word; 2: a mark, which does on a letter or digit; 0: neither."""
    kind = unicodedata.category(chr(point))
    return 2 if kind == "Mn" else int(kind[0] == "L" or kind == "Nd")


def _in_word(letters: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether the characters beyond ASCII that begin at ``lead`` belong to words."""
    points, which = np.unique(_points(letters, lead), return_inverse=True)
    kinds = np.array([_kind(p) for p in points.tolist()], np.int64)[which]
    for i in np.flatnonzero(kinds == 2).tolist():  # marks are few: each looks for what it stands on
        at, kind = int(lead[i]), 2
        while kind == 2 and at > 0:
            at = int(_leads(letters, np.array([at - 1]))[0])
            point = int(letters[at]) if letters[at] < 0x80 else int(_points(letters, np.array([at]))[0])
            kind = _kind(point) if point <= 0xFFFF else 0  # a mark on a letter of two units stands alone, as in Spark's search
        kinds[i] = kind
    return kinds == 1


def token_places(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the tokens of UTF-8 bytes that begin at a blank's end and end with a blank.

    A run of capital letters and hyphens holds at most one token: from its first letter with a word's boundary before it
    to its last boundary, if these are two letters or more apart. That is what a greedy search for ``text.TOKEN`` finds.
    """
    kind = _KIND[letters]
    run = (kind == _LETTER) | (kind == _HYPHEN)
    change = np.flatnonzero(run[1:] != run[:-1]) + 1
    if len(run) and run[0]:
        change = np.concatenate([[0], change])
    first, last = change[::2], change[1::2]  # the closing blank ends the last run
    word = (kind == _LETTER) | (kind == _OTHER)
    before = first[first > 0] - 1
    before, behind = before[letters[before] >= 0x80], last[letters[last] >= 0x80]
    word[before], word[behind] = _in_word(letters, _leads(letters, before)), _in_word(letters, behind)
    boundary = np.empty(len(word), bool)
    boundary[:1] = word[:1]
    np.not_equal(word[1:], word[:-1], out=boundary[1:])
    plain = boundary[first] & (kind[first] == _LETTER) & boundary[last]
    start, end = np.where(plain, first, 0), np.where(plain, last, 0)
    if not plain.all():
        begins, ends, odd = np.flatnonzero(boundary & (kind == _LETTER)), np.flatnonzero(boundary), np.flatnonzero(~plain)
        at = np.searchsorted(begins, first[odd])
        odd, at = odd[at < len(begins)], at[at < len(begins)]
        begin = begins[at]
        inside = begin < last[odd]
        odd, begin = odd[inside], begin[inside]
        start[odd], end[odd] = begin, ends[np.searchsorted(ends, last[odd], side="right") - 1]
    good = end - start >= 2
    return start[good], (end - start)[good]


def blocks(letters: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``BLOCK`` bytes, each ending behind a blank; the bytes end with one."""
    at, n = 0, len(letters)
    while at < n:
        end = min(at + BLOCK, n)
        while end < n:  # on to the next blank
            near = np.flatnonzero(letters[end - 1 : end + 4096] == 0x20)
            if len(near):
                end = end + int(near[0])
                break
            end = min(end + 4096, n)
        yield at, end
        at = end


def known_tokens(texts: pa.Array, dictionary: Dictionary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and words' places of the tokens of upper-cased texts that are in the dictionary, block by block."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    whole = texts.buffers()[2]
    if whole is None or offsets[-1] == offsets[0]:
        return
    letters = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    for low, high in blocks(letters):
        part = np.concatenate([letters[low:high], np.zeros(PACKED, np.uint8)])
        starts, lengths = token_places(part)
        places = dictionary.find(part, starts, lengths)
        hit = places >= 0
        yield np.searchsorted(offsets, starts[hit] + low, side="right") - 1, places[hit]


def loaded(words: DataFrame) -> Dictionary | None:
    """The dictionary of ``words(word, neg, pos)`` in memory, or None if it is too large for that. A word that stands twice has both rows' flags."""
    size = words.agg(F.count("word").alias("n"), F.sum(F.octet_length("word")).alias("letters")).first()
    if size.n > MOST_WORDS or (size.letters or 0) > MOST_LETTERS:
        return None
    merged: dict[str, tuple[bool, bool]] = {}
    for w, neg, pos in words.select("word", "neg", "pos").where("word IS NOT NULL").collect():  # bounded just now
        before = merged.get(w, (False, False))
        merged[w] = (before[0] or bool(neg), before[1] or bool(pos))
    return Dictionary([(w, *flags) for w, flags in merged.items()])


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return narrow_batches(docs).select(F.col(key).alias("key"), F.concat(F.upper(F.coalesce(F.col(text), F.lit(""))), F.lit(" ")).alias("text"))


def sums(docs: DataFrame, dictionary: Dictionary, key: str, text: str) -> DataFrame:
    """``(key, n, neg, pos)`` of each row: its tokens in the dictionary, and those with a flag."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            totals = np.zeros((3, batch.num_rows), np.int64)
            for row, place in known_tokens(batch.column(1), known):
                for i, of in enumerate((row, row[known.neg[place]], row[known.pos[place]])):
                    totals[i] += np.bincount(of, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, totals)], ["key", "n", "neg", "pos"])

    each = _texts(docs, key, text)
    return each.mapInArrow(trimmed(count), T.StructType([each.schema["key"], *(T.StructField(c, T.LongType()) for c in ("n", "neg", "pos"))]))


def terms(docs: DataFrame, dictionary: Dictionary, key: str, text: str) -> DataFrame:
    """``(key, word, tf, neg, pos)`` of each row and word of the dictionary that it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        n = max(1, len(known.words))
        for batch in batches:
            row, tf, place = [], [], []
            for r, p in known_tokens(batch.column(1), known):
                pairs, times = np.unique(r * n + p, return_counts=True)
                row.append(pairs // n), place.append(pairs % n), tf.append(times)
            if row:  # a text cut by blocks has a pair in several; the caller adds them up
                row, place, tf = map(np.concatenate, (row, place, tf))
                columns = batch.column(0).take(pa.array(row)), known.words.take(pa.array(place)), pa.array(tf.astype(np.int64)), pa.array(known.neg[place]), pa.array(known.pos[place])
                yield pa.RecordBatch.from_arrays(list(columns), ["key", "word", "tf", "neg", "pos"])

    each = _texts(docs, key, text)
    fields = (("word", T.StringType()), ("tf", T.LongType()), ("neg", T.BooleanType()), ("pos", T.BooleanType()))
    return each.mapInArrow(trimmed(count), T.StructType([each.schema["key"], *(T.StructField(c, t) for c, t in fields)]))
