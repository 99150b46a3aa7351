"""A keyed table with atomic commits over plain Parquet files.

Rows are dealt to a fixed number of buckets by key. An upsert rewrites the buckets that it touches into new files and
then puts one manifest in place by a rename that fails if the version exists: readers see the old version or the new
one, an interrupted commit leaves the old one, and of two writers who began with the same version one fails. Files are
never changed, so a reader stays with its version. A manifest names each file with the SHA-256 of what is stored.

The driver handles manifests alone: a few names for each bucket, whatever the number of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonequarry.operators import rows
from tonequarry.sources.sinks import digest


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class VersionedTable:
    """The table of one folder, in any store that Spark's Hadoop client opens.

    ``key``: its column, unique in every version. ``fixed``: columns that a later row of a key doesn't change.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, fixed: Sequence[str] = (), buckets: int = 16):
        self.spark, self.folder, self.key, self.fixed, self.buckets = spark, folder.rstrip("/"), key, list(fixed), buckets
        self.schema = T.StructType.fromDDL(schema)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._system.getUri(), spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The committed versions, in order."""
        folder = self._path(f"{self.folder}/versions")
        if not self._system.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._system.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))

    def manifest(self, version: int | None = None) -> dict:
        """``{version, buckets: {number: [{path, sha256, length}]}}`` of a version, the latest by default; version 0 is empty."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return {"version": 0, "buckets": {}}
        if version not in known:
            raise ValueError(f"no version {version}")
        lines = self.spark.read.text(f"{self.folder}/versions/{version}.json", wholetext=True).collect()  # one text of names
        return json.loads(lines[0].value)

    def _files(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = manifest["buckets"] if buckets is None else {str(b): manifest["buckets"].get(str(b), []) for b in buckets}
        paths = [f"{self.folder}/{f['path']}" for files in wanted.values() for f in files]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. Later commits don't change what the frame reads."""
        return self._files(self.manifest(version))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, changes: DataFrame, order: Sequence[Column | str]) -> int:
        """Puts the first row of each key by ``order`` into the table and returns the new version; null keys are left out.

        Changes without a row commit nothing and return the version that stands. Raises ``Conflict`` if another
        writer was first; the caller may then try again from the new version.
        """
        base = self.manifest()
        latest = rows.first_by(changes.where(F.col(self.key).isNotNull()), [self.key], order).select(*self.schema.names)
        latest = latest.withColumn("bucket", self._bucket())
        touched = sorted(r.bucket for r in latest.select("bucket").distinct().collect())  # at most as many as there are buckets
        if not touched:
            return base["version"]
        state = self._files(base, touched)
        merged = rows.upsert(state, latest.drop("bucket"), self.key, self.fixed, [self.key])
        own = f"data/{uuid.uuid4().hex}"
        merged.select(*self.schema.names, self._bucket().alias("bucket")).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{own}")
        return self._commit(base, touched, self._described(own))

    def _described(self, own: str) -> dict[str, list[dict]]:
        """What is stored in a folder: its files by bucket, with their digests, which the tasks make."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.folder}/{own}")
        found = files.select(F.regexp_extract("path", r"bucket=(\d+)/", 1).alias("bucket"), F.regexp_extract("path", r"bucket=\d+/[^/]+$", 0).alias("name"), digest().alias("sha256"), "length")
        out: dict[str, list[dict]] = {}
        for r in found.orderBy("bucket", "name").collect():
            out.setdefault(r.bucket, []).append({"path": f"{own}/{r.name}", "sha256": r.sha256, "length": r.length})
        return out

    def _commit(self, base: dict, touched: list[int], written: dict[str, list[dict]]) -> int:
        version = base["version"] + 1
        kept = {b: files for b, files in base["buckets"].items() if int(b) not in set(touched)}
        text = json.dumps({"version": version, "buckets": kept | written})
        staged, final = (self._path(f"{self.folder}/versions/{n}") for n in (f"_staged-{uuid.uuid4().hex}", f"{version}.json"))
        out = self._system.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(staged, final, none)  # fails if the version is there
        except Exception as e:
            self._system.delete(staged, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is there") from e
            raise
        return version

    def damaged(self, version: int | None = None) -> DataFrame:
        """``(path)`` of a version's files whose stored bytes are missing or have another digest than the manifest says."""
        named = [(f["path"], f["sha256"]) for files in self.manifest(version)["buckets"].values() for f in files]
        wanted = self.spark.createDataFrame(named, "path string, sha256 string")
        there = [p for p, _ in named if self._system.exists(self._path(f"{self.folder}/{p}"))]
        if not there:
            return wanted.select("path")
        stored = self.spark.read.format("binaryFile").option("ignoreCorruptFiles", True).load([f"{self.folder}/{p}" for p in there])
        own = stored.select(F.regexp_extract("path", r"data/[^/]+/bucket=\d+/[^/]+$", 0).alias("path"), digest().alias("sha256"))
        return wanted.join(own, ["path", "sha256"], "left_anti").select("path")
