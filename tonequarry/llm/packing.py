"""Packing of documents into training sequences by order-preserving dynamic programming.

The documents of a partition form one stream of tokens, in the table's order. Sequences are windows of that stream.
Possible cuts are document ends and sentence ends; only a stretch longer than a sequence without either may be cut
inside, every ``GRID`` tokens. The cost of a
window is its padding plus a penalty for what its end truncates. As padding is linear in both ends of a window, the
best predecessor of a cut is the minimum of a sliding window, kept by a monotone queue: each cut is pushed and popped
once. A window of a power of two isn't padded: where such a one ends at a cut, its start is a predecessor too, at a price
for one sequence more. A partition is packed in blocks of about ``BLOCK`` tokens; the last windows of a block are planned again with
the next block, so memory doesn't grow with the partition. No row moves between tasks, and a lost task repeats alike.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tonequarry.llm.bpe import CACHE_ENTRIES, bpe
from tonequarry.llm.common import narrow_batches, tidy

SEQUENCE = 4096
END_ID = 2
#: Penalties in tokens of padding for a window that ends after a sentence, or within one.
SENTENCE_PENALTY, GRID_PENALTY = 2, 8
#: Price of a window of a smaller power of two than a sequence, and the smallest such window.
SHORT_PENALTY, LEAST_SHORT = 4, 256
GRID = 32
BLOCK = 1 << 18
#: Windows at the end of a block that are planned again.
AGAIN = 2


def plan(cuts: list[int], penalties: list[int], size: int = SEQUENCE) -> list[int]:
    """The cuts of the cheapest windows from ``cuts[0]`` to ``cuts[-1]``; neighbours must be at most ``size`` apart.

    The last window costs nothing, as it is planned again or cut into sequences without padding.
    """
    best, came = [0] * len(cuts), [0] * len(cuts)
    short = shorter(cuts, size)
    queue: deque[int] = deque([0])
    keys = [cuts[0]] + [0] * (len(cuts) - 1)  # best + position: what a predecessor adds to a window's padding
    for j in range(1, len(cuts)):
        at = cuts[j]
        while at - cuts[queue[0]] > size:
            queue.popleft()
        i = came[j] = queue[0]
        best[j] = keys[i] + size - at + penalties[j]
        for i in short.get(j, ()):
            cost = best[i] + SHORT_PENALTY + penalties[j]
            if cost < best[j]:
                best[j], came[j] = cost, i
        key = keys[j] = best[j] + at
        while queue and keys[queue[-1]] > key:  # of equals the earlier one stays: the longer window
            queue.pop()
        queue.append(j)
    out, j = [], len(cuts) - 1
    came[j] = min((i for i in range(bisect_left(cuts, cuts[j] - size), j)), key=best.__getitem__)
    while j:
        out.append(cuts[j])
        j = came[j]
    return [cuts[0], *reversed(out)]


def shorter(cuts: list[int], size: int) -> dict[int, list[int]]:
    """For cuts at which a window of a smaller power of two can end, the cuts at which it starts."""
    at, out = np.array(cuts), {}
    power = size // 2
    while power >= min(LEAST_SHORT, size // 2) and power > 0:
        start = np.searchsorted(at, at - power)
        for j in np.flatnonzero(at[start] == at - power).tolist():
            out.setdefault(j, []).append(int(start[j]))
        power //= 2
    return out


def candidates(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, size: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """Cuts and their penalties for a stream whose documents end at ``ends``; ``sentence`` marks the ids that end one.

    Neighbouring cuts are at most ``size`` apart: where boundaries are farther, a grid is laid between them.
    """
    kind = np.full(len(ids) + 1, 255, "u1")
    kind[np.flatnonzero(sentence[ids]) + 1] = SENTENCE_PENALTY
    kind[ends] = 0
    kind[0] = 0
    known = np.flatnonzero(kind != 255)
    grid = min(GRID, size)
    wide = np.flatnonzero(np.diff(known) > size)
    for a, b in zip(known[wide].tolist(), known[wide + 1].tolist(), strict=True):
        kind[np.arange(a + grid, b, grid)] = GRID_PENALTY
    at = np.flatnonzero(kind != 255)
    return at.tolist(), kind[at].tolist()


def powers(length: int) -> list[int]:
    """The powers of two that add up to ``length``, largest first: sequences that need no padding."""
    return [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]


class Packer:
    """Takes documents' ids one by one and yields the pieces of finished windows."""

    def __init__(self, sentence: np.ndarray, first_sequence: int, size: int = SEQUENCE, block: int = BLOCK):
        self.sentence, self.sequence, self.size, self.block = sentence, first_sequence, size, block
        self.docs: list[tuple[object, int, np.ndarray, int]] = []  # id, start of these ids in the document, ids, document's tokens
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        bounds = plan(*candidates(ids, ends, self.sentence, self.size), self.size)
        if last:
            tail = powers(bounds[-1] - bounds[-2])
            bounds[-1:] = (bounds[-2] + np.cumsum(tail)).tolist()
        else:
            del bounds[max(2, len(bounds) - AGAIN) :]
        raw = ids.astype("<u4").tobytes()
        i, begin = 0, 0  # the document at hand and where its ids begin in the stream
        for a, b in pairwise(bounds):
            at = a
            while at < b:
                while ends[i] <= at:
                    begin = int(ends[i])
                    i += 1
                doc_id, start, _, tokens = self.docs[i]
                to = min(b, int(ends[i]))
                yield doc_id, start + at - begin, to - at, zlib.crc32(raw[4 * at : 4 * to]), tokens, self.sequence, at - a
                at = to
            self.sequence += 1
        done, rest, begin = bounds[-1], [], 0
        for (doc_id, start, own, tokens), end in zip(self.docs, ends.tolist(), strict=True):
            if end > done:
                skip = max(0, done - begin)
                rest.append((doc_id, start + skip, own[skip:], tokens))
            begin = end
        self.docs, self.held = rest, len(ids) - done


def sentence_ends(tokens: list[str]) -> np.ndarray:
    """For each id whether its token ends a sentence."""
    return np.array([t.removesuffix("</w>")[-1:] in {".", "!", "?"} and t.endswith("</w>") for t in tokens])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", size: int = SEQUENCE, entries: int = CACHE_ENTRIES) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    A null or empty text is the end id alone; repeated rows are packed as often as they stand; an empty table gives no
    row; texts of any length are cut as needed; other columns aren't read. The last window of a partition is cut into
    powers of two, which aren't padded, so small partitions cost no padding either. Ties go to the longer window.
    ``entries`` bounds what a worker remembers of words: fewer take less memory and more time, the result is the same.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, entries)
        packer = Packer(sentence_ends(coder.tokens), TaskContext.get().partitionId() << 40, size)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(np.frombuffer(coder.encode(text.as_py() or ""), "u4"), np.uint32(END_ID))
                rows += packer.add(doc_id, ids)
                if len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows = []
        rows += packer.flush(True)
        if rows:
            yield batch_of(rows)

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return narrow_batches(narrow).mapInArrow(tidy(run, "bpe"), PIECES)
