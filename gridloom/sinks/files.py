"""A sink of many files, written by tasks.

Rows (name, part, body) are fragments of files. All of a file meet in one task, in order of
part, and are streamed into it one by one, so a task holds a fragment and never a file.
Tasks write below a staging folder of the job, each attempt in its own; when all have ended
the driver moves the files to their names, and removes the staging folder. A job that fails
leaves nothing. Files of the same name are replaced.

The path may be local (one machine, or a mount that all share) or a URI that pyarrow's
file systems know.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "file_parts"


@dataclass
class Written(WriterCommitMessage):
    """Folder of a task's attempt and the names of the files in it."""

    folder: str
    names: list[str]


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return arrow_fs.LocalFileSystem(), os.path.abspath(path)


class FilePartsWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = opened(self.path)
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        out, names, last = None, [], None
        try:
            for row in iterator:
                if last is None or row["name"] != last[0]:
                    if out:
                        out.close()
                    if any(part in ("", ".", "..") for part in row["name"].split("/")):
                        raise ValueError(f"not a name of a file: {row['name']}")
                    names.append(row["name"])
                    at = f"{base}/{folder}/{row['name']}"
                    store.create_dir(os.path.dirname(at), recursive=True)
                    out = store.open_output_stream(at)
                elif row["part"] <= last[1]:
                    raise ValueError(f"parts of {row['name']} are not in order")
                out.write(row["body"])
                last = row["name"], row["part"]
        finally:
            if out:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = opened(self.path)
        store.create_dir(base, recursive=True)
        made = set()
        for done in messages:
            for name in done.names if done else ():
                target = f"{base}/{name}"
                if os.path.dirname(target) not in made:
                    store.create_dir(os.path.dirname(target), recursive=True)
                    made.add(os.path.dirname(target))
                store.move(f"{base}/{done.folder}/{name}", target)
        self._clear(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: arrow_fs.FileSystem, base: str) -> None:
        at = f"{base}/{self.staging}"
        if store.get_file_info(at).type != arrow_fs.FileType.NotFound:
            store.delete_dir(at)


class FileParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, part int, body binary"

    def writer(self, schema, overwrite: bool) -> FilePartsWriter:
        return FilePartsWriter(self.options["path"])


def write_files(parts: DataFrame, path: str) -> None:
    """Files of parts (name, part, body) below path; part numbers of a file differ."""
    parts.sparkSession.dataSource.register(FileParts)
    ordered = parts.select("name", "part", "body").repartition("name").sortWithinPartitions("name", "part")
    ordered.write.format(FORMAT).mode("append").save(path)
