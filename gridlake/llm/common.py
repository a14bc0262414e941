"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, by Spark's default file system if it has none: what is opened outside Spark must not turn local."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(there).toString()


def release(spark: SparkSession, times: int = 1) -> None:
    """Let go of shuffle files that nothing refers to any more.

    Spark deletes them when the driver collects its garbage, which a driver with a large heap does late; and what Python let go reaches the JVM a moment later, so
    large steps collect twice.
    """
    for left in reversed(range(times)):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if left:
            time.sleep(0.3)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/gridlake/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once as a Parquet table in the shared folder and read it back.

    A table and not ``checkpoint()``, as a checkpoint keeps its plan's size estimate: that is a product over all joins so far, so
    in a loop it grows until its digits alone stall the planner, and no small side is ever known to be small.
    """
    return _written(df, "step")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same for large tables: what was shuffled to make them is let go. For that, a caller passes ``df`` on and keeps no name for it."""
    out = _written(df, name)
    del df
    release(out.sparkSession, 2)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``checkpointed`` or ``staged``, once all that was made of them is written too."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t._staged_path)
        path.getFileSystem(conf).delete(path, True)


def grouped(rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """``rows`` aggregated by ``keys``, to be joined by them with rows in which a key can be hot.

    Adaptive execution splits a hot key only where an exchange stands just before the join on either side. An aggregate by the join's keys needs
    none and would keep the hot key whole; so the keys come out as aggregates themselves, by which the result is not dealt yet.
    """
    own = {f"_{k}_": k for k in keys}
    return rows.groupBy(*keys).agg(*(F.min(k).alias(n) for n, k in own.items()), *aggregates).drop(*keys).withColumnsRenamed(own)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
