"""Compressed filings read as streams: a task inflates a file in blocks and keeps the annual report's body alone.

Spark lists the files and deals them to tasks by their sizes without reading them. Exhibits are inflated, as the length
and the check sum need them, but neither kept nor decoded, so memory is that of the body, whatever the file's size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tonequarry.sources.files import opened

BLOCK = 1 << 20
#: White space of a text in Latin-1.
_SPACE = rb"[\t-\r \x85\xa0]"
#: What the pattern ``text.DOCUMENT`` asks for, step by step.
_HEAD = re.compile(rb"<DOCUMENT>" + _SPACE + rb"*<TYPE>(?:10-K405|10K405|10-K|10K)" + _SPACE, re.IGNORECASE)
_OPEN = re.compile(rb"<TEXT>", re.IGNORECASE)
_CLOSE = re.compile(rb"</TEXT>|</DOCUMENT>", re.IGNORECASE)
_MARK = re.compile(rb"<DOCUMENT>" + _SPACE + rb"+", re.IGNORECASE)
#: Longer than any mark without its white space.
_TAIL = 64


class Body:
    """The body of the first annual report in bytes that come in parts: a head, then an opening, then an end."""

    def __init__(self) -> None:
        self.step, self.rest, self.kept = 0, b"", []

    def feed(self, part: bytes) -> None:
        if self.step == 3:
            return
        self.rest += part
        while self.step < 3 and (m := (_HEAD, _OPEN, _CLOSE)[self.step].search(self.rest)):
            if self.step == 2:
                self.kept.append(self.rest[: m.start()])
            self.rest = self.rest[m.end() :]
            self.step += 1
        if self.step == 3:
            self.rest = b""
            return
        if self.step == 0:  # white space behind a mark may go on for any length and says nothing
            self.rest = _MARK.sub(b"<DOCUMENT> ", self.rest)
        cut = max(0, len(self.rest) - _TAIL)
        if self.step == 2:
            self.kept.append(self.rest[:cut])
        self.rest = self.rest[cut:]

    def text(self) -> str | None:
        """None if there is no whole body."""
        return b"".join(self.kept).decode("latin-1") if self.step == 3 else None


def inflated(file: BinaryIO) -> Iterator[bytes]:
    """The parts of a file of one or several compressed members, each checked; zeros behind the last one don't count."""
    member, begun, pending = None, False, b""
    while True:
        data = pending or file.read(BLOCK)
        if not data:
            break
        if member is None:
            if begun and not data.strip(b"\0"):
                pending = b""
                continue
            while len(data) < 2 and (more := file.read(BLOCK)):
                data += more
            if begun:
                data = data.lstrip(b"\0")
            if data[:2] != b"\x1f\x8b":
                raise ValueError(f"not a compressed file: it begins with {data[:2]!r}")
            member, begun = zlib.decompressobj(31), True
        yield member.decompress(data, BLOCK)
        if member.eof:
            member, pending = None, member.unused_data
        else:
            pending = member.unconsumed_tail
    if member is not None:
        raise EOFError("compressed file ends before the end of its stream")


def one(path: str) -> tuple[int | None, str | None, bool, str | None]:
    """``(length, body, ok, error)`` of a file; a file without an annual report has an empty body."""
    body, length = Body(), 0
    try:
        system, name = opened(path)
        with system.open_input_stream(name, compression=None) as file:
            for part in inflated(file):
                length += len(part)
                body.feed(part)
    except Exception as e:  # noqa: BLE001  any bad file is one row, not a failed job
        return None, None, False, f"{type(e).__name__}: {e}"[:200]
    return length, body.text() or "", True, None


def bodies(spark: SparkSession, path: str, pattern: str = "*.txt.gz") -> DataFrame:
    """``(path, length, body, ok, error)``, one row for each file below a folder; length is of the inflated bytes.

    A file that can't be read, isn't compressed or is cut short is a row with the error's first 200 letters. An empty
    file has length zero.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():  # one row a batch: a body may be large
                length, body, ok, error = one(p)
                columns = pa.array([p]), pa.array([length], pa.int64()), pa.array([body], pa.string()), pa.array([ok]), pa.array([error], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns), ["path", "length", "body", "ok", "error"])

    return files.select("path").mapInArrow(read, "path string, length bigint, body string, ok boolean, error string")
