"""A listing of folders by tasks: names, sizes and times, empty files too.

The driver opens folders level by level only until there are enough of them to deal
out; every task lists what lies below its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENOUGH = 256  #: folders from which on the driver opens no further level


class FolderListing(DataSource):
    """Option ``path``: a folder."""

    @classmethod
    def name(cls):
        return "folder_listing"

    def schema(self):
        return "path string, name string, length long, modified timestamp"

    def reader(self, schema):
        return FolderReader(self.options["path"])


@dataclass
class Below(InputPartition):
    """What lies below a folder, at any depth or directly in it."""

    folder: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        store, base = fs.FileSystem.from_uri(self.path)
        out, level = [], [base]
        while level and len(level) < ENOUGH:
            out += [Below(f, False) for f in level]
            level = [x.path for f in level for x in store.get_file_info(fs.FileSelector(f)) if x.type == fs.FileType.Directory]
        return out + [Below(f, True) for f in level]

    def read(self, partition):
        store, _ = fs.FileSystem.from_uri(self.path)
        for x in store.get_file_info(fs.FileSelector(partition.folder, recursive=partition.deep)):
            if x.type == fs.FileType.File:
                yield x.path, x.base_name, x.size, x.mtime
