"""Gives the executors' Python this package where they don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def shipped(spark: SparkSession) -> SparkSession:
    """Adds the package to the session once, unless the workers' search path holds it already."""
    context = spark.sparkContext
    paths = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    if str(ROOT) in paths or any(f.startswith("tonequarry") for f in getattr(context, "_python_includes", [])):
        return spark
    path = Path(tempfile.mkdtemp(prefix="package-")) / "tonequarry.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "tonequarry").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(path))
    return spark
