"""What bounds the memory of Python workers: the size of the batches that they get, and what they keep of it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of a batch that goes to a Python worker, at most: texts are long, and a worker holds a few batches.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def narrow_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session hands its rows to Python workers in batches of bounded size.

    These settings of the session change no result; smaller values stay.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < _size(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df


def _size(text: str) -> int:
    """A setting's number of rows or bytes; one with a larger unit counts as unbounded."""
    text = text.lower().removesuffix("b")
    return int(text) if text.lstrip("-").isdigit() else 0


def given_back() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, whose worker gives back what it has freed at the task's end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            given_back()

    return wrapped
