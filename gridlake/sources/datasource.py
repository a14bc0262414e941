"""``spark.read.format("workbook")``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..session import ship_package
from .formats import open_workbook
from .scan import SHEETS, sheet_batches


def _read(uri: str) -> bytes:
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    with store.open_input_stream(at, compression=None) as f:
        return f.read()


def _files(uri: str) -> list[str]:
    from pyarrow import fs

    plain = "://" not in uri and not uri.startswith("file:")
    store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", "file://" + uri if plain else uri))
    info = store.get_file_info(at)
    if info.type == fs.FileType.Directory:
        found = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    else:
        found = [at]
    scheme = uri.split("://")[0] + "://" if not plain and not uri.startswith("file:") else "file://"
    return sorted(scheme + p for p in found if not p.rpartition("/")[2].startswith((".", "_", "~")))


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    """A task a file: the driver lists names and opens nothing."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p) for p in _files(self.options["path"])] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator:
        if not partition.path:
            return
        book = open_workbook(_read(partition.path))
        number = lambda name: int(self.options[name]) if self.options.get(name) else None
        for sheet in [s.name for s in book.metadata.sheets if self.options.get("sheet") in (None, s.name)]:
            yield from sheet_batches(partition.path, book, sheet, number("col_start") or 0, number("width"), number("row_start") or 0, number("row_end"))


class WorkbookSource(DataSource):
    """Options: ``path`` (a file or a folder), ``sheet`` (all if not given), ``col_start``, ``width``, ``row_start``, ``row_end``. Streams: ``stream_folder``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SHEETS

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(WorkbookSource)
