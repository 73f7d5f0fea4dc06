"""A folder of workbooks as a stream: an extension, of use where exports arrive as files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from gridloom.sources.xlsx import SheetReader, SheetSource


@dataclass
class Arrived(InputPartition):
    path: str


class FolderSource(DataSource):
    """Each workbook is read once, when its name sorts after those before; the first gives the schema, and files are renamed into place."""

    @classmethod
    def name(cls) -> str:
        return "sheet_folder"

    def schema(self) -> str:
        return SheetSource({**self.options, "path": os.path.join(self.options["path"], arrivals(self.options["path"])[0])}).schema()

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderReader(dict(self.options), schema)


def arrivals(folder: str) -> list[str]:
    return sorted(n for n in os.listdir(folder) if n.endswith(".xlsx"))


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema_ = options, schema

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        names = arrivals(self.options["path"])
        return {"last": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Arrived(os.path.join(self.options["path"], n)) for n in arrivals(self.options["path"]) if start["last"] < n <= end["last"]]

    def read(self, part: Arrived) -> Iterator[pa.RecordBatch]:
        reader = SheetReader(SheetSource({**self.options, "path": part.path}), self.schema_)
        for stretch in reader.partitions():
            yield from reader.read(stretch)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
