"""Media columns: progressive JPEG, written from and read back to coefficient arrays, and RGB tensors.

A payload's bytes are stored as quantised DCT coefficients with a quantisation of one, 64 to a block, so the file holds
them without loss. Blocks form three components, the chroma ones of half resolution. The scans are progressive: bands
of the spectrum, each first without its lowest bit and then that bit. Every coded unit ends with a restart marker, so
the reader decodes the units of many files side by side: each numpy step takes the next symbol of thousands of units.
Coefficients are accumulated over the scans, inverse-transformed with integers (no rounding depends on the order of
sums), and chroma is upsampled to full-resolution RGB.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonequarry.llm.common import narrow_batches, tidy

#: Bytes of payload that are coded together, and coded units that are handled in one numpy step.
STEP, UNITS = 1 << 21, 1 << 15
BLOCK, PER_MCU = 64, 6
#: Blocks of an MCU by component: four of luma, one of each chroma.
PART = {1: (0, 1, 2, 3), 2: (4,), 3: (5,)}
#: Scans: components, first and last coefficient, the bit position before and after.
SCRIPT = (((1, 2, 3), 0, 0, 0, 1), ((1,), 1, 20, 0, 1), ((1,), 21, 63, 0, 1), ((2,), 1, 63, 0, 1), ((3,), 1, 63, 0, 1), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((3,), 1, 63, 1, 0), ((1, 2, 3), 0, 0, 1, 0))
TAG = b"payload"


def zigzag() -> np.ndarray:
    """The row-major place of each coefficient in the order of the file."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


def huffman(lengths: dict[int, list[int]]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of symbols by code length: the table's bytes as in the file, and code and length by symbol."""
    counts = bytes(len(lengths.get(n, [])) for n in range(1, 17))
    codes, sizes, code = np.zeros(256, "u8"), np.zeros(256, "i8"), 0
    for n in range(1, 17):
        for s in lengths.get(n, []):
            codes[s], sizes[s] = code, n
            code += 1
        code <<= 1
    return counts + bytes(s for n in range(1, 17) for s in lengths.get(n, [])), codes, sizes


@functools.lru_cache(maxsize=64)
def lookup(table: bytes) -> np.ndarray:
    """Length times 256 plus symbol for each 16 bits that a code may begin."""
    out, code, at = np.zeros(1 << 16, "i8"), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


_RARE = [0x00, 0x01, 0x02, 0x03, 0x04, 0x08]
_REST = [s for s in range(256) if s not in {5, 6, 7, *_RARE} and s & 15 <= 10]
DC_TABLE, DC_CODE, DC_SIZE = huffman({4: list(range(12))})
AC_TABLE, AC_CODE, AC_SIZE = huffman({1: [6], 2: [5], 3: [7], 6: _RARE, 13: _REST})


@functools.lru_cache(maxsize=4096)
def grid(mcus: int) -> tuple[int, int]:
    """Columns and rows of MCUs that hold at least so many."""
    wide = int(np.ceil(np.sqrt(mcus)))
    return wide, -(-mcus // wide)


@functools.lru_cache(maxsize=4096)
def raster(wide: int, high: int, component: int) -> np.ndarray:
    """The place (MCU times six plus block) of each block of a component in raster order."""
    if component > 1:
        return np.arange(wide * high) * PER_MCU + PART[component][0]
    y, x = np.divmod(np.arange(4 * wide * high), 2 * wide)
    return ((y // 2) * wide + x // 2) * PER_MCU + (y % 2) * 2 + x % 2


@functools.lru_cache(maxsize=4096)
def interleaved(mcus: int, parts: tuple[int, ...]) -> np.ndarray:
    """The places of some blocks of each MCU, MCU by MCU."""
    return (np.arange(mcus)[:, None] * PER_MCU + np.array(parts)).reshape(-1)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = segment(0xDB, b"\0" + b"\1" * 64)
TABLES = segment(0xC4, b"\x00" + DC_TABLE) + segment(0xC4, b"\x10" + AC_TABLE)


def joined(values: np.ndarray, sizes: np.ndarray, unit: np.ndarray, units: int, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit strings, in order, as the bytes of their units, each filled up with ones, stuffed and ended by a restart marker.

    ``unit`` is ascending; ``numbers`` are the units' places in their scans. Also where each unit begins, and the end.
    """
    bits = np.bincount(unit, sizes, units).astype("i8")
    fill = -bits % 8
    order = np.argsort(np.concatenate([unit, np.arange(units)]), kind="stable")
    values = np.concatenate([values, (np.uint64(1) << fill.astype("u8")) - np.uint64(1)])[order]
    sizes = np.concatenate([sizes, fill])[order]
    keep = sizes > 0
    values, sizes = values[keep], sizes[keep]
    at = np.cumsum(sizes) - sizes
    total = int((bits + fill).sum())
    words = np.zeros(total // 64 + 2, "u8")
    if len(values):
        left = values << (64 - sizes).astype("u8")
        word, shift = at >> 6, (at & 63).astype("u8")
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] += np.add.reduceat(left >> shift, first)
        over = np.where(shift > 0, left << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        words[word[first] + 1] += np.add.reduceat(over, first)
    data = np.frombuffer(words.byteswap().tobytes(), "u1", total // 8)
    ends = np.cumsum((bits + fill) // 8)
    stuffed = np.flatnonzero(data == 0xFF) + 1
    places = np.concatenate([stuffed, np.repeat(ends, 2)])
    marks = np.empty((units, 2), "u1")
    marks[:, 0], marks[:, 1] = 0xFF, 0xD0 + numbers % 8
    out = np.insert(data, places, np.concatenate([np.zeros(len(stuffed), "u1"), marks.reshape(-1)]))
    starts = np.append(0, ends)
    return out.tobytes(), starts + np.append(0, np.searchsorted(stuffed, ends, "right") + 2 * np.arange(1, units + 1))


def category(magnitude: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.frexp(magnitude.astype("f8"))[1].astype("i8") * (magnitude > 0)


def coded_dc(blocks: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit strings of MCUs' six DC values without their lowest bits; prediction starts anew in each MCU."""
    v = blocks[:, :, 0].astype("i8") >> low
    d = v.copy()
    d[:, 1:4] -= v[:, :3]
    d = d.reshape(-1)
    s = category(np.abs(d))
    extra = np.where(d < 0, d + (1 << s) - 1, d).astype("u8")
    return DC_CODE[s] << s.astype("u8") | extra, DC_SIZE[s] + s, np.repeat(np.arange(len(blocks)), PER_MCU)


def coded_ac(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit strings of blocks' first scan of a band: run and size, then the value, and the end of block where zeros end it."""
    n, width = band.shape
    magnitude = np.abs(band) >> low
    unit, k = np.nonzero(magnitude)
    m = magnitude[unit, k].astype("i8")
    before = np.where(np.append(True, unit[1:] != unit[:-1]) if len(unit) else np.zeros(0, bool), -1, np.append(-1, k[:-1]) if len(k) else k)
    run = k - before - 1
    s = category(m)
    extra = np.where(band[unit, k] < 0, (1 << s) - 1 - m, m).astype("u8")
    symbol = (run & 15) << 4 | s
    values, sizes = AC_CODE[symbol] << s.astype("u8") | extra, AC_SIZE[symbol] + s
    for i in (1, 2, 3):  # runs of sixteen zeros before the symbol
        long = run >> 4 >= i
        values = np.where(long, AC_CODE[0xF0] << sizes.astype("u8") | values, values)
        sizes = np.where(long, AC_SIZE[0xF0] + sizes, sizes)
    open_end = np.flatnonzero(magnitude[:, -1] == 0)
    order = np.argsort(np.concatenate([unit, open_end]), kind="stable")
    values = np.concatenate([values, np.full(len(open_end), AC_CODE[0])])[order]
    sizes = np.concatenate([sizes, np.full(len(open_end), AC_SIZE[0])])[order]
    return values, sizes, np.concatenate([unit, open_end])[order]


def refined_ac(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit strings of blocks' scan for one more bit.

    Where no coefficient becomes nonzero, the end of block comes first and then the known coefficients' bits; the few
    other blocks are coded one by one.
    """
    magnitude = np.abs(band)
    known = magnitude >> (low + 1) > 0
    fresh = np.flatnonzero(((magnitude >> low == 1) & ~known).any(1))
    plain = np.ones(len(band), bool)
    plain[fresh] = False
    unit, k = np.nonzero(known & plain[:, None])
    ending = np.flatnonzero(plain)
    parts = [(np.full(len(ending), AC_CODE[0]), np.full(len(ending), AC_SIZE[0]), ending), ((magnitude[unit, k] >> low & 1).astype("u8"), np.ones(len(unit), "i8"), unit)]
    for b in fresh.tolist():
        own, run, held = [], 0, []
        values = band[b].tolist()
        last = max(i for i, v in enumerate(values) if abs(v) >> low == 1)
        for i, v in enumerate(values):
            if known[b, i]:
                held.append((abs(v) >> low & 1, 1))
            elif abs(v) >> low == 1:
                own += [(int(AC_CODE[run << 4 | 1]), int(AC_SIZE[run << 4 | 1])), (int(v > 0), 1), *held]
                run, held = 0, []
            else:
                if run == 15 and i < last:
                    own += [(int(AC_CODE[0xF0]), int(AC_SIZE[0xF0])), *held]
                    run, held = 0, []
                else:
                    run += 1
        if last < len(values) - 1:
            own += [(int(AC_CODE[0]), int(AC_SIZE[0])), *held]
        parts.append((np.array([x for x, _ in own], "u8"), np.array([x for _, x in own], "i8"), np.full(len(own), b)))
    order = np.argsort(np.concatenate([p[2] for p in parts]), kind="stable")
    return tuple(np.concatenate([p[i] for p in parts])[order] for i in range(3))


def encode(payloads: list[bytes]) -> list[bytes]:
    """Files of payloads whose lengths are positive multiples of 64."""
    counts = [len(p) // BLOCK for p in payloads]
    grids = [grid(-(-n // PER_MCU)) for n in counts]
    mcus = np.array([w * h for w, h in grids])
    starts = np.cumsum(mcus) - mcus
    blocks = np.zeros((int(mcus.sum()), PER_MCU, BLOCK), "i2")
    flat = blocks.reshape(-1, BLOCK)
    for p, at in zip(payloads, (starts * PER_MCU).tolist(), strict=True):
        flat[at : at + len(p) // BLOCK] = np.frombuffer(p, "u1").reshape(-1, BLOCK)
    files = []
    for (w, h), n in zip(grids, counts, strict=True):
        frame = struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        files.append([b"\xff\xd8", segment(0xFE, TAG + struct.pack(">Q", n * BLOCK)), HEAD, segment(0xC2, frame), TABLES, segment(0xDD, struct.pack(">H", 1))])
    orders = {c: np.concatenate([raster(w, h, c) + at for (w, h), at in zip(grids, (starts * PER_MCU).tolist(), strict=True)]) for c in PART}
    for components, first, last, high, low in SCRIPT:
        head = segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low]))
        if first == 0:
            where, sizes = None, mcus
        else:
            where = orders[components[0]]
            sizes = mcus * len(PART[components[0]])
        edges = np.append(0, np.cumsum(sizes))
        numbers = np.arange(edges[-1]) - np.repeat(edges[:-1], sizes)
        pieces, marks, base = [], [], 0
        for a in range(0, int(edges[-1]), UNITS):
            b = min(int(edges[-1]), a + UNITS)
            if first:
                coded = (refined_ac if high else coded_ac)(flat[where[a:b], first : last + 1], low)
            elif high:
                bit = (blocks[a:b, :, 0].reshape(-1) >> low & 1).astype("u8")
                coded = bit, np.ones(len(bit), "i8"), np.repeat(np.arange(b - a), PER_MCU)
            else:
                coded = coded_dc(blocks[a:b], low)
            data, at = joined(*coded, b - a, numbers[a:b])
            pieces.append(data)
            marks.append(at[:-1] + base)
            base += len(data)
        data, marks = b"".join(pieces), np.append(np.concatenate(marks), base)
        for f, a, b in zip(files, marks[edges[:-1]].tolist(), marks[edges[1:]].tolist(), strict=True):
            f += [head, data[a : b - 2]]  # no marker after a scan's last unit
    return [b"".join([*f, b"\xff\xd9"]) for f in files]


@dataclass
class Frame:
    """What a file's segments say; scans: signature, and where the data begin and end in the file."""

    width: int
    height: int
    length: int
    scans: list[tuple[tuple, int, int]]


@functools.lru_cache(maxsize=64)
def huffman_tables(body: bytes) -> dict[int, bytes]:
    """A segment's tables by class and number."""
    out = {}
    while body:
        n = 17 + sum(body[1:17])
        out[body[0]] = body[1:n]
        body = body[n:]
    return out


def parsed(data: bytes, ends: np.ndarray) -> Frame:
    """``ends``: the places of markers that end a scan's data. Files of three components as written above."""
    at, tables, interval, out = 2, {}, 0, Frame(0, 0, 0, [])
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return out
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE and body.startswith(TAG):
            out.length = struct.unpack(">Q", body[len(TAG) :])[0]
        elif marker == 0xC2:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            if n != 3 or [body[7 + 3 * i] for i in range(3)] != [0x22, 0x11, 0x11] or out.width % 16 or out.height % 16:
                raise ValueError("only whole MCUs of three components, the chroma ones halved, are supported")
        elif marker == 0xC4:
            tables |= huffman_tables(body)
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            n = body[0]
            chosen = tuple(body[1 + 2 * i] for i in range(n))
            picks = tuple(body[2 + 2 * i] for i in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get(0x10 | p & 15 if first else p >> 4, b"") for p in picks)
            end = int(ends[np.searchsorted(ends, at)])
            out.scans.append(((chosen, first, last, bits >> 4, bits & 15, used, interval), at, end))
            at = end


class Bits:
    """Reads bits of many units at once from their places in one buffer."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        low, high = int(starts.min()), len(data)
        padded = np.concatenate([data[low:high], np.full(16, 0xFF, "u1")])
        n = len(padded) - 8
        self.words = np.zeros(n, "u8")
        for i in range(8):
            self.words |= padded[i : i + n].astype("u8") << np.uint64(8 * (7 - i))
        self.at = (starts - low) * 8

    def ahead(self, who: np.ndarray) -> np.ndarray:
        """The next 57 bits, left-aligned."""
        at = self.at[who]
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).view("u8")

    def bit(self, who: np.ndarray) -> np.ndarray:
        out = (self.ahead(who) >> np.uint64(63)).view("i8")
        self.at[who] += 1
        return out

    def symbol(self, who: np.ndarray, table: np.ndarray, run: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run, size and the bits of that size (or, for sizes of 0 with ``run``, of the run's size) of the next code."""
        word = self.ahead(who)
        found = table[(word >> np.uint64(48)).view("i8")]
        length, r, s = found >> 8, found >> 4 & 15, found & 15
        extra = np.where((s == 0) & (r < 15), r, s) if run else s
        value = (word << length.view("u8")) >> np.uint64(1) >> (63 - extra).view("u8")
        self.at[who] += length + extra
        return r, s, value.view("i8")


def signed(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)


def read_dc(bits: Bits, flat: np.ndarray, places: np.ndarray, order: list[int], tables: list[np.ndarray], high: int, low: int) -> None:
    """A scan of DC values; ``places``: the blocks of each unit in order, -1 where there are no more; ``order``: components."""
    predicted = np.zeros((len(places), 4), "i8")
    for step in range(places.shape[1]):
        who = np.flatnonzero(places[:, step] >= 0)
        c = order[step % len(order)]
        if high:
            flat[places[who, step], 0] |= (bits.bit(who) << low).astype("i2")
        else:
            _, s, value = bits.symbol(who, tables[c], False)
            predicted[who, c] += signed(value, s)
            flat[places[who, step], 0] = predicted[who, c] << low


def read_ac(bits: Bits, flat: np.ndarray, places: np.ndarray, table: np.ndarray, first: int, last: int, low: int) -> None:
    """A band's first scan: each step takes the next symbol of every unit whose block isn't complete."""
    ended = np.zeros(len(places), "i8")  # blocks still to be skipped
    for step in range(places.shape[1]):
        here = places[:, step]
        skip = (here >= 0) & (ended > 0)
        who = np.flatnonzero((here >= 0) & ~skip)
        ended[skip] -= 1
        k = np.full(len(who), first)
        while len(who):
            r, s, value = bits.symbol(who, table, True)
            over = (s == 0) & (r < 15)
            if over.any():
                ended[who[over]] = (1 << r[over]) + value[over] - 1
            k = k + r
            put = s > 0
            flat[here[who[put]], k[put]] = signed(value[put], s[put]) << low
            k += 1
            go = ~over & (k <= last)
            if not go.all():
                who, k = who[go], k[go]


def refine_ac(bits: Bits, flat: np.ndarray, places: np.ndarray, table: np.ndarray, first: int, last: int, low: int) -> None:
    """A band's scan for one more bit: each step takes the next coefficient of every unit."""
    n = len(places)
    ended, left, fresh, pending = np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n, bool)
    for step in range(places.shape[1]):
        who = np.flatnonzero(places[:, step] >= 0)
        here = places[who, step]
        band = flat[here, first : last + 1]
        for k in range(last - first + 1):
            column = band[:, k]
            known = column != 0
            ask = who[(ended[who] == 0) & ~pending[who]]
            if len(ask):
                r, s, value = bits.symbol(ask, table, True)
                over = (s == 0) & (r < 15)
                ended[ask[over]] = (1 << r[over]) + value[over]
                more = ~over
                pending[ask[more]], left[ask[more]] = True, r[more]
                fresh[ask[more]] = np.where(s[more] > 0, np.where(value[more] > 0, 1, -1), 0)
            if known.any():
                bit = bits.bit(who[known])
                column[known] += (np.sign(column[known]) * (bit << low)).astype("i2")
            rest = np.flatnonzero(~known & pending[who])
            if len(rest):
                w = who[rest]
                put = left[w] == 0
                column[rest[put]] = fresh[w[put]] << low
                pending[w[put]] = False
                left[w[~put]] -= 1
        flat[here, first : last + 1] = band
        ended[who] = np.maximum(ended[who] - 1, 0)
        pending[who] = False


def decode(files: list[bytes]) -> tuple[list[Frame], np.ndarray]:
    """Frames and the coefficients ``(mcu, 6, 64)`` of all files in turn, accumulated scan by scan."""
    raw = np.frombuffer(b"".join(files), "u1")
    edges = np.append(0, np.cumsum([len(f) for f in files]))
    follows = np.append(raw[1:], np.uint8(0))
    full = raw == 0xFF
    restarts = np.flatnonzero(full & (follows >= 0xD0) & (follows <= 0xD7))
    ends = np.flatnonzero(full & (follows != 0) & ((follows < 0xD0) | (follows > 0xD7)))
    stuffed = np.append(False, full[:-1]) & (raw == 0)
    data = raw[~stuffed]
    place = np.cumsum(~stuffed) - 1
    frames = []
    for f, a, b in zip(files, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        frames.append(parsed(f, ends[np.searchsorted(ends, a) : np.searchsorted(ends, b)] - a))
    mcus = np.array([f.width * f.height // 256 for f in frames])
    base = np.append(0, np.cumsum(mcus))
    blocks = np.zeros((int(base[-1]), PER_MCU, BLOCK), "i2")
    flat = blocks.reshape(-1, BLOCK)
    for number in range(max(len(f.scans) for f in frames)):
        alike: dict[tuple, list[int]] = {}
        for i, f in enumerate(frames):
            if number < len(f.scans):
                alike.setdefault(f.scans[number][0], []).append(i)
        for (chosen, first, last, high, low, tables, interval), own in alike.items():
            begin = np.array([frames[i].scans[number][1] for i in own]) + edges[own]
            end = np.array([frames[i].scans[number][2] for i in own]) + edges[own]
            file = np.searchsorted(begin, restarts, "right") - 1
            inside = restarts[(file >= 0) & (restarts < end[file])]
            starts = np.sort(np.concatenate([begin, inside + 2]))
            cuts = list(zip(place[begin].tolist(), place[end].tolist(), strict=True))
            scan = np.concatenate([data[x:y] for x, y in cuts])
            shift = place[begin] - np.append(0, np.cumsum([y - x for x, y in cuts])[:-1])
            starts = place[np.minimum(starts, len(place) - 1)] - shift[np.searchsorted(begin, starts, "right") - 1]
            parts = tuple(p for c in chosen for p in PART[c])
            each = interval * len(parts) if len(chosen) > 1 else interval
            orders = [(interleaved(int(mcus[i]), parts) if len(chosen) > 1 else raster(frames[i].width // 16, frames[i].height // 16, chosen[0])) + int(base[i]) * PER_MCU for i in own]
            if each and not any(len(x) % each for x in orders):
                places = np.concatenate(orders).reshape(-1, each)
            else:  # a scan whose last unit is shorter, or without restarts
                widest = each or max(map(len, orders))
                rows = [np.append(x, np.full(-len(x) % widest, -1)).reshape(-1, widest) for x in orders]
                places = np.concatenate(rows)
            if len(starts) != len(places):
                raise ValueError("a scan's restart markers don't match its size")
            for a in range(0, len(starts), UNITS):
                part, at = places[a : a + UNITS], starts[a : a + UNITS]
                stop = int(starts[a + UNITS]) if a + UNITS < len(starts) else len(scan)
                bits = Bits(scan[:stop], at)
                if first == 0:
                    order = [c for c in chosen for _ in PART[c]] if len(chosen) > 1 else [chosen[0]]
                    read_dc(bits, flat, part, order, [None, *(lookup(t) if t else None for t in (tables + tables[-1:] * 3)[:3])], high, low)
                elif high:
                    refine_ac(bits, flat, part, lookup(tables[0]), first, last, low)
                else:
                    read_ac(bits, flat, part, lookup(tables[0]), first, last, low)
    return frames, blocks


def inverse() -> np.ndarray:
    """64 coefficients (in the file's order) to 64 samples, times 2^14 and rounded: sums of integers are exact."""
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1)[None, :] / 2
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return np.rint(full[zigzag()] * (1 << 14))


INVERSE = inverse()


def samples_of(blocks: np.ndarray) -> np.ndarray:
    """RGB samples ``(mcu, 16, 16, 3)`` of MCUs, with chroma repeated to full resolution."""
    out = np.empty((len(blocks), 16, 16, 3), "u1")
    for a in range(0, len(blocks), 1024):
        part = blocks[a : a + 1024]
        samples = ((part.reshape(-1, BLOCK).astype("f8") @ INVERSE).astype("i4") + (1 << 13) >> 14) + 128
        samples = np.clip(samples, 0, 255).reshape(-1, PER_MCU, 8, 8)
        y = samples[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
        cb, cr = (samples[:, i].repeat(2, 1).repeat(2, 2) - 128 for i in (4, 5))
        # The JFIF colour matrix times 2^16.
        rgb = (y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16))
        for i, channel in enumerate(rgb):
            out[a : a + 1024, :, :, i] = np.clip(channel, 0, 255)
    return out


def tensor(samples: np.ndarray, wide: int) -> np.ndarray:
    """``(height, width, 3)`` of MCUs in rows of ``wide``."""
    return samples.reshape(-1, wide, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(-1, 16 * wide, 3)


def padded(data: bytes) -> bytes:
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def runs(data: list[bytes]) -> Iterator[slice]:
    at, held = 0, 0
    for i, x in enumerate(data):
        held += len(x) + BLOCK
        if held >= STEP:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(data):
        yield slice(at, len(data))


def stored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text's payload as a progressive JPEG file; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.as_py() or b"" for t in batch.column(1)]
            for part in runs(data):
                files = encode([padded(x) for x in data[part]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(files)), pa.array([len(x) for x in data[part]], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("binary").alias("text"))
    return narrow_batches(narrow).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def opened(files: list[bytes]) -> Iterator[tuple[Frame, bytes, np.ndarray]]:
    """Of each file its frame, the payload read back and the RGB tensor."""
    frames, blocks = decode(files)
    payload, samples, at = blocks.astype("u1"), samples_of(blocks), 0
    for f in frames:
        to = at + f.width * f.height // 256
        yield f, payload[at:to].reshape(-1)[: f.length].tobytes(), tensor(samples[at:to], f.width // 16)
        at = to


def rgb(media: DataFrame) -> DataFrame:
    """``(doc_id, height, width, rgb)`` of ``stored``'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [m.as_py() for m in batch.column(1)]
            for part in runs(files):
                found = [(f.height, f.width, t.tobytes()) for f, _, t in opened(files[part])]
                columns = [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(found)), *columns], ["doc_id", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(tidy(run), "doc_id long, height int, width int, rgb binary")


LEVELS = np.arange(256)
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What is read back from ``stored``'s files, and features of their tensors: size, channel means and deviations, CRC.

    Equal payloads have equal files and features, wherever they stand. Rows repeat as they stand; an empty table gives
    no rows; the empty payload is one block of zeros.
    """
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [m.as_py() for m in batch.column(2)]
            for part in runs(files):
                rows = []
                for data, (f, payload, pixels) in zip(files[part], opened(files[part]), strict=True):
                    flat = pixels.reshape(-1, 3)
                    # By value and channel, so that sums are exact and cheap.
                    tallies = [np.bincount(flat[:, i], minlength=256) for i in range(3)]
                    sums, squares = ([int(t @ w) for t in tallies] for w in (LEVELS, LEVELS**2))
                    moments = ",".join(f"{s / len(flat):.4f}:{max(0.0, q / len(flat) - (s / len(flat)) ** 2) ** 0.5:.4f}" for s, q in zip(sums, squares, strict=True))
                    feature = f"{f.width}x{f.height};{moments};{zlib.crc32(pixels):08x}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(rows)), batch.column(1).slice(part.start, len(rows)), *columns], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), DIGEST)
