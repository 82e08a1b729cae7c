"""A data source of source files: ``spark.read.format("codefiles")``.

The driver lists only the uppermost folders, until there are enough of them to share out; the tasks
list, prune and read what stands below. So neither the time nor the memory of the driver grows with
the number of files. What could not be listed comes out as rows with an error and no content.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scholia.sources.walk import Folder, WalkOptions, open_folder, roots, walk

#: Folders that the driver shares out at most (a folder may hold more than one adds), and the most files in one partition.
FOLDERS, PARTITION_FILES = 1_024, 2_000


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, bool]], folders: list[Folder], errors: list[tuple[str, str]]):
        self.files, self.folders, self.errors = files, folders, errors


class CodeFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        many = lambda name: json.loads(options.get(name, "[]"))
        flag = lambda name: options.get(name, "false").lower() == "true"
        self.paths = many("paths") or [options.get("path", ".")]
        self.walk = WalkOptions(many("exclude"), many("excludedir"), flag("excludehidden"), flag("includevcs"), flag("includevendored"), flag("follow"), many("ignorefiles") or WalkOptions().ignore_files)

    def partitions(self) -> list[InputPartition]:
        folders, top = roots(self.paths)
        files, errors = list(top.files), list(top.errors)
        waiting = deque(folders)
        while waiting and len(waiting) < FOLDERS:
            found = open_folder(waiting.popleft(), self.walk)
            files += [(path, False) for path in found.files]
            errors += found.errors
            waiting.extend(found.folders)
        parts: list[InputPartition] = [_Part(files[i : i + PARTITION_FILES], [], []) for i in range(0, len(files), PARTITION_FILES)]
        parts += [_Part([], [folder], []) for folder in waiting]
        return [*parts, _Part([], [], errors)] if errors or not parts else parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path, error in partition.errors:
            yield path, True, None, error
        for path, explicit in partition.files:
            yield _content(path, explicit)
        for folder in partition.folders:
            for path, error in walk(folder, self.walk):
                yield (path, True, None, error) if error else _content(path, False)


def _content(path: str, explicit: bool) -> tuple:
    try:
        with open(path, "rb") as f:
            return path, explicit, f.read(), None
    except OSError as e:
        return path, explicit, None, e.strerror or str(e)


class CodeFiles(DataSource):
    """Options: ``paths`` and other lists as JSON arrays, flags as true or false; see ``WalkOptions``."""

    @classmethod
    def name(cls) -> str:
        return "codefiles"

    def schema(self) -> str:
        return "path string, explicit boolean, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return CodeFilesReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CodeFiles)
