"""A writer of one file per key that streams rows and commits in two phases.

Rows come sorted by file name; a task appends them to files in a folder of its own
and holds no more than a batch.  When all tasks have ended, files move to their
places; if the job fails, or a task is given up, its folder goes and no file of it
is seen.
"""

from __future__ import annotations

import gzip
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


class KeyFiles(DataSource):
    """Rows (name, line).  Options: ``path`` (the folder), ``head`` (before the first
    line), ``mark`` (between lines) and ``own`` (each task's files in a folder of the
    task's number: such a folder is put in its place by one rename)."""

    @classmethod
    def name(cls):
        return "key_files"

    def writer(self, schema, overwrite):
        return KeyFilesWriter(self.options["path"], self.options.get("head", ""), self.options.get("mark", "\n"), self.options.get("own", "false") == "true")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]
    to: str


class KeyFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, head: str, mark: str, own: bool = False):
        self.path, self.head, self.mark, self.own = path.rstrip("/"), head.encode(), mark.encode(), own
        self.job = f".writing-{uuid.uuid4().hex}"

    def _store(self):
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator):
        store, base = self._store()
        folder, names, out = f"{base}/{self.job}/{uuid.uuid4().hex}", [], None
        store.create_dir(folder)
        try:
            for batch in iterator:
                for name, lines in _runs(batch):
                    if not names or name != names[-1]:
                        if names and name <= names[-1] or "/" in name:
                            raise ValueError(f"{name!r} is out of order or no file name")
                        if out:
                            out.close()
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                        if name.endswith(".gz"):
                            out = Packed(out)
                        out.write(self.head)
                        names.append(name)
                    else:
                        out.write(self.mark)
                    out.write(pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), self.mark)[0].as_buffer())
        finally:
            if out:
                out.close()
        return Written(folder, names, f"{base}/{TaskContext.get().partitionId():05d}" if self.own else base)

    def commit(self, messages):
        store, base = self._store()
        for m in messages:
            if m and m.names and self.own and store.get_file_info(m.to).type == fs.FileType.NotFound:
                store.move(m.folder, m.to)
                continue
            for name in m.names if m else ():
                store.move(f"{m.folder}/{name}", f"{m.to}/{name}")
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        store, base = self._store()
        if store.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.job}")


class Packed(gzip.GzipFile):
    """A compressed file, closed with the stream that it writes into."""

    def __init__(self, to):
        super().__init__(fileobj=to, mode="wb", compresslevel=1, mtime=0)
        self.to = to

    def close(self):
        super().close()
        self.to.close()


def _runs(batch):
    """(name, its lines as an array of bytes) of rows that follow each other."""
    runs = pc.run_end_encode(batch.column(0))
    lines = pc.fill_null(batch.column(1), "").cast(pa.binary())
    at = 0
    for end, name in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
        yield name, lines.slice(at, end - at)
        at = end


def write_files(rows: DataFrame, path: str, name: Column, order: list, line: Column, head: str = "", mark: str = "\n", folders: int = 0) -> None:
    """One file per ``name`` in the folder ``path``, its lines in ``order``: no key is
    gathered, a file costs its own task.  Rows without a name are left out; files of
    the same name are replaced.  Very many files go into ``folders`` below it, by the
    name's hash: always the same one if their number is."""
    places = [f"o{k}" for k in range(len(order))]
    own = rows.select(name.cast("string").alias("name"), *[F.col(o).alias(p) if isinstance(o, str) else o.alias(p) for o, p in zip(order, places)], line.alias("line")).where("name is not null")
    dealt = own.repartition(folders, "name") if folders else own.repartition("name")
    write_dealt(dealt.sortWithinPartitions("name", *places).select("name", "line"), path, head, mark, bool(folders))


def write_dealt(rows: DataFrame, path: str, head: str = "", mark: str = "\n", own: bool = False) -> None:
    """The same for rows (name, line) that are dealt out already: all of a name lie in
    one task, names in order.  Files are compressed if their names end in ``.gz``."""
    rows.sparkSession.dataSource.register(KeyFiles)
    rows.write.format("key_files").options(path=path, head=head, mark=mark, own=own).mode("append").save()
