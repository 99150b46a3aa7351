"""A sink of one file for each row, written by the tasks and put in place by one commit.

Tasks write to a folder of their own attempt beside the target. The commit moves what the successful attempts name; an
abort deletes the staged folder, so a failed job leaves nothing and no reader sees half a file. No row passes through
the driver, only names do. Any file system that pyarrow opens by its address will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "tonequarry_files"


@dataclass
class Written(WriterCommitMessage):
    """What one attempt has staged: its folder and the files' names."""

    folder: str
    names: list[str]


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address: a URL, or a path of the local one."""
    if "://" not in address and address.startswith("file:"):
        address = address.removeprefix("file:")
    return fs.FileSystem.from_uri(address)


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str, stage: str, again: bool):
        self.folder, self.stage, self.again = folder, stage, again

    def write(self, iterator: Iterator[Row]) -> Written:
        system, folder = opened(self.folder)
        context = TaskContext.get()
        own = f"{folder}/{self.stage}/{context.partitionId()}-{context.taskAttemptId()}"
        names = []
        for name, content in iterator:
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"no name of a file: {name!r}")
            if not self.again and system.get_file_info(f"{folder}/{name}").type != fs.FileType.NotFound:
                continue
            if not names:
                system.create_dir(own, recursive=True)
            with system.open_output_stream(f"{own}/{name}") as out:
                out.write(bytes(content or b""))
            names.append(name)
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.folder)
        done = [(m.folder, n) for m in messages if m is not None for n in m.names]
        if len({n for _, n in done}) < len(done):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        system.create_dir(folder, recursive=True)
        for own, name in done:
            system.move(f"{own}/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.folder)
        if system.get_file_info(f"{folder}/{self.stage}").type != fs.FileType.NotFound:
            system.delete_dir(f"{folder}/{self.stage}")


class Files(DataSource):
    """``(name string, content binary)`` to files of a folder; options: path, stage, again."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"].rstrip("/"), self.options["stage"], self.options.get("again", "true") == "true")


def write(df: DataFrame, folder: str, name: str, content: str, again: bool = True) -> None:
    """One file for each row. ``again``: files that are there are replaced; else they are left as they are and not rewritten.

    A null content is an empty file; a null name, one with a slash or two rows of one name fail the whole job.
    """
    df.sparkSession.dataSource.register(Files)
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    rows.write.format(NAME).option("path", folder).option("stage", f"_staged-{uuid.uuid4().hex}").option("again", str(again).lower()).mode("append").save()
