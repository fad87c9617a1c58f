"""Palette documents of a folder, or a single one, as a table: one partition per document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sinks.files import opened

FORMAT = "palette_documents"


@dataclass
class Document(InputPartition):
    path: str


class PaletteReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Document]:
        store, base = opened(self.path)
        found = store.get_file_info(base)
        if found.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(f"no such palette or folder: {self.path}")
        files = store.get_file_info(arrow_fs.FileSelector(base)) if found.type == arrow_fs.FileType.Directory else [found]
        return [Document(x.path) for x in sorted(files, key=lambda x: x.path) if x.type == arrow_fs.FileType.File and x.path.endswith(".json")] or [Document("")]

    def read(self, partition: Document) -> Iterator[tuple[str, str | None]]:
        if not partition.path:
            return
        with opened(self.path)[0].open_input_stream(partition.path) as source:
            raw = source.read()
        try:
            text = raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = None  # told as a fault where it is parsed
        yield partition.path.rsplit("/", 1)[-1].removesuffix(".json"), text


class PaletteDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "palette_id string, json string"

    def reader(self, schema) -> PaletteReader:
        return PaletteReader(self.options["path"])


def palette_documents(spark: SparkSession, path: str) -> DataFrame:
    """palette_id (the file's name) and json of the .json files of a folder, or of one file; json is null where the bytes are no text."""
    spark.dataSource.register(PaletteDocuments)
    return spark.read.format(FORMAT).load(path)
