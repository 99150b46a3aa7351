"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonequarry.functions.batches import given_back, narrow_batches  # noqa: F401  others take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where the executors' common files go: the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in this one machine's JVM (as in tests) a temporary folder is used.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


#: What a worker keeps between its tasks, by name, and how it forgets it.
KEPT: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``. The worker, which lives on for other tasks, first forgets what it has kept for tasks
    of another kind than ``keep``; at the end it gives back what it has freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in KEPT.items():
            if name != keep:
                forget()
        try:
            yield from run(batches)
        finally:
            given_back()

    return wrapped


def unused(name: str, *frames: DataFrame) -> str:
    """A column's name that none of the frames has; names differ by more than case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint; the session drops it when nothing refers to it, if so configured."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: compressed, and read by column. For what is large."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that no later step reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Places of the filter that keeps texts out of shuffles that can't concern them.
SLOTS = 1 << 20


def apart(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` may be among ``keys(key)``, and those whose isn't, without moving either.

    Keys are hashed to slots; the table of slots has at most ``SLOTS`` rows, whatever the number of keys, and is
    broadcast. Null keys are in no slot.
    """
    slot = unused("__slot", rows)
    slots = F.broadcast(keys.select(F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias(slot)).distinct())
    slotted = rows.withColumn(slot, F.pmod(F.xxhash64(F.col(column).cast(keys.schema["key"].dataType)), F.lit(SLOTS)))
    return tuple(slotted.join(slots, slot, how).drop(slot) for how in ("left_semi", "left_anti"))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps now instead of at the driver's next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def width(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
