"""Label trees as a Spark format: one small text file an image, empty ones included.

    spark.dataSource.register(LabelTree)
    spark.read.format("label_tree").option("layout", "split").load(root)
    files.write.format("label_tree").mode("append").save(root)
    files.write.format("label_tree").option("packed", "true").mode("append").save(new_root)

Rows are (split, stem, content). Layout `split` is root/{split}/labels/{stem}.txt,
`flat` is root/{stem}.txt with a null split; `auto` reads whichever there is.
A packed tree has the same files as entries of zip archives, in the folders they would
lie in: small files take a block of a disk each, many times their bytes. Reading
takes both kinds. A packed tree is written at once, to a folder without label files.
Paths are of any file system that pyarrow opens by its URI and all executors share.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "split string, stem string, content string"
ARROW = pa.schema([("split", pa.string()), ("stem", pa.string()), ("content", pa.string())])
SUFFIX, PACK = ".txt", ".zip"
#: Most files and bytes of a read task, bytes of a batch, calls to a file system at once, and files and bytes of an archive.
FILES, TASK_BYTES, BATCH_BYTES, AT_ONCE, PACKED, PACK_BYTES = 2_000, 64 << 20, 8 << 20, 16, 20_000, 16 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    system, path = fs.FileSystem.from_uri(uri.replace("file:///", "/").replace("file:/", "/"))
    return system, path.rstrip("/")


def _listed(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))


@dataclass
class Files(InputPartition):
    split: str | None
    folder: str
    names: list[str]


class LabelTree(DataSource):
    """The format; options: path, layout (split, flat or auto), filesPerTask, packed (for writing)."""

    @classmethod
    def name(cls) -> str:
        return "label_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LabelReader:
        return LabelReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LabelWriter:
        return LabelWriter(dict(self.options), overwrite)


class LabelReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.layout, self.most = options["path"], options.get("layout", "auto"), int(options.get("filespertask", options.get("filesPerTask", FILES)))
        if self.layout not in ("split", "flat", "auto"):
            raise ValueError(f"layout {self.layout}: not one of split, flat, auto")
        self.splits: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the split choose folders; Spark applies the others."""
        for f in filters:
            if isinstance(f, EqualTo | In) and tuple(f.attribute) == ("split",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.splits = wanted if self.splits is None else self.splits & wanted
            else:
                yield f

    def _folders(self, system: fs.FileSystem, root: str) -> list[tuple[str | None, str]]:
        kinds = fs.FileType
        found = [x.base_name for x in _listed(system, root) if x.type == kinds.Directory and not x.base_name.startswith((".", "_"))] if self.layout != "flat" else []
        there = {x.path for x in system.get_file_info([f"{root}/{s}/labels" for s in found]) if x.type == kinds.Directory} if found else set()
        splits = [(s, f"{root}/{s}/labels") for s in sorted(found) if f"{root}/{s}/labels" in there]
        chosen: list[tuple[str | None, str]] = [(s, at) for s, at in splits if self.splits is None or s in self.splits]
        flat = self.layout == "flat" or self.layout == "auto" and not splits
        return chosen + ([(None, root)] if flat and self.splits is None else [])

    def partitions(self) -> list[Files]:
        """Files by folder, packed by number and bytes; only names are planned, contents are read by the tasks."""
        system, root = opened(self.root)
        out: list[Files] = []
        for split, folder in self._folders(system, root):
            names, size = [], 0
            for info in sorted(_listed(system, folder), key=lambda x: x.base_name):
                if info.type != fs.FileType.File or not info.base_name.endswith((SUFFIX, PACK)) or info.base_name.startswith("."):
                    continue
                if info.base_name.endswith(PACK):
                    out.append(Files(split, folder, [info.base_name]))
                    continue
                if names and (len(names) >= self.most or size + info.size > TASK_BYTES):
                    out.append(Files(split, folder, names))
                    names, size = [], 0
                names.append(info.base_name)
                size += info.size
            if names:
                out.append(Files(split, folder, names))
        return out or [Files(None, root, [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)

        def content(name: str) -> str:
            with system.open_input_stream(f"{partition.folder}/{name}") as f:
                return f.read().decode("utf-8", "replace")

        def contents() -> Iterator[tuple[str, str]]:
            with ThreadPoolExecutor(AT_ONCE) as pool:
                for at in range(0, len(partition.names), 64):
                    some = partition.names[at : at + 64]
                    yield from zip(some, pool.map(content, some), strict=True)

        def packed(name: str) -> Iterator[tuple[str, str]]:
            with system.open_input_file(f"{partition.folder}/{name}") as f, zipfile.ZipFile(f) as z:
                for entry in z.infolist():
                    yield entry.filename, z.read(entry).decode("utf-8", "replace")

        rows: tuple[list, list] = ([], [])
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.split] * len(rows[0]), pa.string()), pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string())], schema=ARROW)

        for name, text in packed(partition.names[0]) if partition.names and partition.names[0].endswith(PACK) else contents():
            rows[0].append(name[: -len(SUFFIX)])
            rows[1].append(text)
            size += len(text)
            if size >= BATCH_BYTES or len(rows[0]) >= PACKED:
                yield batch()
                rows, size = ([], []), 0
        if rows[0]:
            yield batch()


class Pack:
    """An archive that is filled in memory, a few MB of it, and put into its folder when it is full."""

    def __init__(self, folder: str) -> None:
        self.folder, self.names, self.bytes = folder, 0, io.BytesIO()
        self.zip = zipfile.ZipFile(self.bytes, "w", zipfile.ZIP_DEFLATED)

    def add(self, name: str, content: str) -> bool:
        """Whether it is full with this file."""
        self.zip.writestr(name, content)
        self.names += 1
        return self.names >= PACKED or self.bytes.tell() >= PACK_BYTES

    def put(self, system: fs.FileSystem, own: str) -> str:
        """Its path below own, where it is written."""
        self.zip.close()
        path = f"{self.folder}/labels-{uuid.uuid4().hex}{PACK}".lstrip("/")
        system.create_dir(f"{own}/{self.folder}".rstrip("/"), recursive=True)
        with system.open_output_stream(f"{own}/{path}") as out:
            out.write(self.bytes.getbuffer())
        return path


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class LabelWriter(DataSourceArrowWriter):
    """Tasks write under a folder of this write; the commit moves their files into place, an abort deletes the folder.

    A task that runs again has a folder of its own, and only files of the attempt
    that Spark reports are moved, so nothing is there twice or in part.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.packed = options.get("packed", "false").lower() == "true"
        if self.packed and not overwrite:
            system, root = opened(self.root)
            if any(x.type == fs.FileType.File and x.base_name.endswith((SUFFIX, PACK)) for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))):
                raise ValueError(f"{root}: a packed tree is written to a folder without label files")

    def _staging(self, root: str) -> str:
        return f"{root}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.root)
        own = f"{self._staging(root)}/{TaskContext.get().taskAttemptId()}"
        if self.packed:
            return Written(own, self._packs(iterator, system, own))
        made: set[str] = set()
        files: list[str] = []

        def put(path: str, content: str) -> None:
            with system.open_output_stream(f"{own}/{path}") as out:
                out.write(content.encode())

        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in iterator:
                splits, stems, contents = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("split", "stem", "content"))
                paths = [f"{stem}{SUFFIX}" if split is None else f"{split}/labels/{stem}{SUFFIX}" for split, stem in zip(splits, stems, strict=True)]
                for folder in {p.rpartition("/")[0] for p in paths} - made:
                    system.create_dir(f"{own}/{folder}", recursive=True)
                    made.add(folder)
                list(pool.map(put, paths, (c or "" for c in contents)))
                files += paths
        return Written(own, files)

    def _packs(self, iterator: Iterator[pa.RecordBatch], system: fs.FileSystem, own: str) -> list[str]:
        packs: dict[str | None, Pack] = {}
        files: list[str] = []
        for batch in iterator:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("split", "stem", "content"))
            for split, stem, content in zip(*columns, strict=True):
                if split not in packs:
                    packs[split] = Pack("" if split is None else f"{split}/labels")
                if packs[split].add(f"{stem}{SUFFIX}", content or ""):
                    files.append(packs.pop(split).put(system, own))
        return files + [p.put(system, own) for p in packs.values()]

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        if self.overwrite:
            for info in _listed(system, root):
                if info.path.rpartition("/")[2] != self._staging(root).rpartition("/")[2]:
                    system.delete_dir(info.path) if info.type == fs.FileType.Directory else system.delete_file(info.path)
        done = [m for m in messages if m]
        for folder in {p.rpartition("/")[0] for m in done for p in m.files}:
            system.create_dir(f"{root}/{folder}", recursive=True)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(lambda x: system.move(f"{x[0]}/{x[1]}", f"{root}/{x[1]}"), ((m.folder, p) for m in done for p in m.files)))
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*opened(self.root))

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            system.delete_dir(self._staging(root))


def read_label_tree(spark: SparkSession, root: str, layout: str = "auto", files_per_task: int = FILES) -> DataFrame:
    """(split, stem, content) of the label files below root; a filter on split reads only its folders."""
    spark.dataSource.register(LabelTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("label_tree").options(layout=layout, filesPerTask=files_per_task).load(root)


def write_label_tree(files: DataFrame, root: str, mode: str = "append", *, packed: bool = False) -> None:
    """A file for each row (split, stem, content); a null split puts it straight below root, null content makes it empty.

    packed: the files are entries of archives, which take a few times their bytes
    instead of a block of the disk each; rows of the same name stay entries of their own.
    """
    files.sparkSession.dataSource.register(LabelTree)
    files.select("split", "stem", "content").write.format("label_tree").option("packed", str(packed).lower()).mode(mode).save(root)
