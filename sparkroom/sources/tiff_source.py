"""TIFF and DNG files as a data source of Spark: pixels by byte ranges, and whole files
written in two phases.

``register(spark)`` makes the format "tiff" known.

Reading: ``spark.read.format("tiff").load(folder)`` gives path, ifd, y, x, up to three
samples a, b and c, and error. The driver lists files and cuts them into ranges of
``splitBytes`` (64 MB). Up to ``TASKS`` ranges are a task each; more are dealt in order to so
many tasks, or to tasks of ``TASK_BYTES`` if that is more tasks. A task reads for each range
the file's directories and those strips and tiles that begin in it, so a large file is many
tasks and none holds it whole, and many small ones are few. Option
``pages`` ("0,2") reads those pages alone; with ``pushdown`` "true" (and Spark's
``spark.sql.python.filterPushdown.enabled``) filters on ifd do the same. A page or
file that cannot be read is one row with its error.

Writing: rows of name (a path below the folder) and content, by
``df.write.format("tiff").mode("append").save(folder)``. Tasks write below a staging
folder; only when all are done are files moved to their places, so a failed job leaves
none. Two rows of one name are an error, as is a file that is there already, unless the
mode is overwrite, which replaces files of the same names and leaves others."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sparkroom.sources import tiff

SPLIT = 1 << 26
#: Tasks up to which each range is one, bytes of a task beyond, and what opening a file counts.
TASKS, TASK_BYTES, OPEN = 200, 1 << 26, 1 << 14
SUFFIXES = (".tif", ".tiff", ".dng")
ROWS = "path string, ifd int, y long, x long, a double, b double, c double, error string"
ARROW = pa.schema([("path", pa.string()), ("ifd", pa.int32()), ("y", pa.int64()), ("x", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64()), ("error", pa.string())])


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Window:
    """A file of which only the slices that are asked for are read."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, s: slice) -> bytes:
        at, end = max(s.start or 0, 0), min(self.size if s.stop is None else s.stop, self.size)
        return self.file.read_at(end - at, at) if end > at else b""


@dataclass
class Part:
    path: str
    inside: str
    start: int
    end: int


@dataclass
class Task(InputPartition):
    parts: list[Part]


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]
        self.split = max(1, int(options.get("splitBytes", SPLIT)))
        self.pages = {int(p) for p in options["pages"].split(",")} if options.get("pages") else None

    def partitions(self) -> list[Task]:
        parts = self.ranges()
        if len(parts) <= TASKS:
            return [Task([p]) for p in parts]
        ends = np.cumsum([p.end - p.start + OPEN for p in parts])
        tasks = max(TASKS, -(-int(ends[-1]) // TASK_BYTES))
        dealt: dict[int, list[Part]] = {}
        for p, end in zip(parts, ends):
            dealt.setdefault((int(end) - 1) * tasks // int(ends[-1]), []).append(p)
        return [Task(some) for some in dealt.values()]

    def ranges(self) -> list[Part]:
        from pyarrow import fs

        store, base = _store(self.folder)
        found = store.get_file_info(base)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            name = f.path.rpartition("/")[2]
            if f.type != fs.FileType.File or not name.lower().endswith(SUFFIXES) or name.startswith((".", "_")) or "/_temporary-" in f.path[len(base) :]:
                continue
            path = self.folder.rstrip("/") + f.path[len(base.rstrip("/")) :]
            out += [Part(path, f.path, at, min(at + self.split, f.size)) for at in range(0, max(f.size, 1), self.split)]
        return out

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from self.read_part(part)

    def read_part(self, partition: Part) -> Iterator[pa.RecordBatch]:
        wrong = lambda ifd, why: pa.RecordBatch.from_pylist([{"path": partition.path, "ifd": ifd, "error": why}], schema=ARROW)
        first = partition.start == 0
        store, _ = _store(self.folder)
        with store.open_input_file(partition.inside) as file:
            raw = Window(file)
            try:
                found = tiff.pages(raw)
            except tiff.BROKEN as e:
                if first:
                    yield wrong(None, f"{type(e).__name__}: {e}")
                return
            for ifd, page in enumerate(found):
                if self.pages is not None and ifd not in self.pages:
                    continue
                if why := tiff.problem(raw, page):
                    if first:
                        yield wrong(ifd, why)
                    continue
                h, w = page.first(tiff.HEIGHT), page.first(tiff.WIDTH)
                for i, (y, x, rows, cols) in enumerate(tiff.blocks(page)):
                    at, end = tiff.extent(page, i)
                    if partition.start <= at < partition.end:
                        yield self.rows(partition.path, ifd, tiff.decoded(raw[at:end], page, rows, cols)[: h - y, : w - x], y, x)

    @staticmethod
    def rows(path: str, ifd: int, block: np.ndarray, top: int, left: int) -> pa.RecordBatch:
        n = block.shape[0] * block.shape[1]
        y, x = np.indices(block.shape[:2]).reshape(2, -1)
        planes = [pa.array(block[:, :, i].reshape(-1).astype(float)) if i < block.shape[2] else pa.nulls(n, pa.float64()) for i in range(3)]
        return pa.record_batch([pa.array([path] * n), pa.array(np.full(n, ifd, np.int32)), pa.array(y + top), pa.array(x + left), *planes, pa.nulls(n, pa.string())], schema=ARROW)


class PruningReader(Reader):
    """Takes the pages from filters on ifd."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ifd",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.pages = asked if self.pages is None else self.pages & asked
            yield f  # Spark filters as well: rows of files that cannot be read have no page


@dataclass
class Staged(WriterCommitMessage):
    """The list of the files that a task has written."""

    listing: str


class Writer(DataSourceWriter):
    def __init__(self, options, schema: StructType, overwrite: bool) -> None:
        self.folder, self.overwrite = options["path"], overwrite
        self.stage = f"_temporary-{uuid.uuid4().hex}"
        if set(schema.names) != {"name", "content"}:
            raise ValueError(f"rows of name and content are written, not {schema.names}")
        store, root = _store(self.folder)
        store.create_dir(f"{root}/{self.stage}", recursive=True)

    def write(self, iterator: Iterator) -> Staged:
        store, root = _store(self.folder)
        here = f"{root}/{self.stage}/{uuid.uuid4().hex}"
        # not recursive: a task that outlives its job, whose folder is gone, fails here
        store.create_dir(here, recursive=False)
        with store.open_output_stream(f"{here}/names") as names:
            for i, row in enumerate(iterator):
                if not row.name or row.content is None or row.name.startswith("/") or "\n" in row.name or ".." in row.name.split("/"):
                    raise ValueError(f"no file can be written for the name {row.name!r}")
                with store.open_output_stream(f"{here}/{i}") as sink:
                    sink.write(bytes(row.content))
                names.write(f"{row.name}\n".encode())
        return Staged(here)

    def _listed(self, store, messages: list[Staged | None]) -> Iterator[tuple[str, str]]:
        for m in messages:
            if m is not None:
                with store.open_input_stream(f"{m.listing}/names") as f:
                    for i, name in enumerate(f.read().decode().splitlines()):
                        yield f"{m.listing}/{i}", name

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.folder)
        ready = f"{root}/{self.stage}/ready"
        exists = lambda p: store.get_file_info(p).type != fs.FileType.NotFound

        def move(a: str, b: str) -> None:
            store.create_dir(b.rpartition("/")[0], recursive=True)
            store.move(a, b)

        try:
            # names meet below the staging folder first, so that two of one name, or one
            # that is there, are found before any file is in its place
            for staged, name in self._listed(store, messages):
                if exists(f"{ready}/{name}") or (not self.overwrite and exists(f"{root}/{name}")):
                    raise ValueError(f"{name} is there already")
                move(staged, f"{ready}/{name}")
            for _, name in self._listed(store, messages):
                move(f"{ready}/{name}", f"{root}/{name}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.folder)
        if store.get_file_info(f"{root}/{self.stage}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.stage}")


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> Reader:
        return (PruningReader if self.options.get("pushdown") == "true" else Reader)(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiffSource)
