"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder will do if there is but one machine; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gridlake-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark``, once per application.

    The files are served by the driver, so workers need neither the repository nor a PYTHONPATH.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from a shipped archive
        return
    folder = tempfile.mkdtemp(prefix="gridlake-")
    path = os.path.join(folder, "gridlake-src.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
