"""Typed rows from a folder into which workbooks of one layout are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import coerce
from ..plans.options import Dtype
from ..session import ship_package
from ..sources.scan import scan_all

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_folder(spark: SparkSession, folder: str, columns: dict[str, tuple[int, str]], sheet: str | None = None, first_row: int = 1) -> DataFrame:
    """``path, sheet, _row`` and the named columns, each from (position, dtype), of the rows from ``first_row`` on of every file that arrives.

    Spark's file source keeps the log of files seen, so a file counts once whatever its name and whenever it comes; tasks read and parse the files.
    """
    ship_package(spark)
    grid = scan_all(spark.readStream.format("binaryFile").schema(FILE).load(folder), sheet=sheet)
    cols = [coerce(F.get("cells", F.lit(at)), Dtype.parse(dtype)).alias(name) for name, (at, dtype) in columns.items()]
    return grid.filter(F.col("_row") >= first_row).select("path", "sheet", "_row", *cols)
