"""Folders of named documents as a data source: every file under its own name, whatever it is, read and written.

    spark.read.format("documents").load(folder)                      # path, name, size, modified, content
    spark.read.format("documents").option("content", "none")...      # what the folder lists, nothing read
    spark.read.format("documents").option("content", "parts")...     # head, middle and tail of each file, by ranges
    spark.read.format("documents").option("unpack", "true")...       # files packed by gzip (name.gz) as what they hold, under their names without .gz
    write_documents(frame, folder)                                   # frame: name, content; packed=True: as name.gz

Names are those of the files, not percent-coded, and hidden ones are read too. Files are opened where the task runs, by pyarrow: paths
without a scheme, file, hdfs, s3, gs and abfss; other stores are left to Spark's own readers (readers.named_texts).

A write is staged beside the folder, each file under a passing name until it is whole, so tasks may be retried or run twice.
A task that is still running when another fails may leave its stage, hidden by its name.
The commit counts what is staged: as many files as documents, or two documents had one name, which is an error, and nothing is published.
Then the stage becomes the folder (overwrite) or its files are moved into it (append).
"""

import gzip
import io
import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMES = ("", "file", "hdfs", "s3", "gs", "abfss")
#: Bytes that one task reads, and files that it opens; bytes that are handed to Spark at once. The largest content that a column takes.
TASK_BYTES, TASK_FILES, BATCH_BYTES, MOST_BYTES = 128 << 20, 5000, 8 << 20, (1 << 31) - (1 << 20)
#: Head, middle and tail of a file that its fingerprint is made of. Fixed values.
PARTS = (8 << 20, 1 << 20, 8 << 20)
LISTED = "path string, name string, size long, modified long"
CONTENTS = {"none": LISTED, "whole": f"{LISTED}, content binary", "parts": f"{LISTED}, head binary, middle binary, tail binary"}


def scheme(path: str) -> str:
    return path.split(":", 1)[0] if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else ""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    kind = scheme(path)
    if kind not in SCHEMES:
        raise ValueError(f"{kind}: isn't opened here; Spark's own readers may")
    if kind in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:(//[^/]*(?=/))?", "", path))
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner.rstrip("/")


#: The suffix of packed files, and the level to which they are packed.
PACKED, LEVEL = ".gz", 4


def part_ranges(size: int, parts: tuple[int, int, int]) -> tuple[tuple[int, int], tuple[int, int], tuple[int, int]]:
    """Start and length of head, middle and tail of so many bytes. The middle is centred and is taken only if it starts past the head; the tail only if it starts past the head or past the middle's end."""
    head, middle, tail = parts
    centre, last = max(0, size // 2 - middle // 2), max(0, size - tail)
    return (0, min(head, size)), (centre, min(middle, size - centre) if centre > head else 0), (last, size - last if last > head or last > centre + middle else 0)


def read_range(file, start: int, length: int) -> bytes:
    if not length:
        return b""
    file.seek(start)
    return file.read(length)


def unpacked(path: str, data: bytes) -> bytes:
    """What a packed file holds, as far as a column takes it."""
    with gzip.open(io.BytesIO(data)) as file:
        held = file.read(MOST_BYTES + 1)
    if len(held) > MOST_BYTES:
        raise ValueError(f"{path} holds more than {MOST_BYTES} bytes, too many for a column")
    return held


@dataclass
class Files(InputPartition):
    """Files (path below the folder, size, modified) that one task reads."""

    folder: str
    files: list[tuple[str, int, int]]

    def __init__(self, folder, files):
        self.folder, self.files = folder, files


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content, self.suffix = options["path"], options.get("content", "whole"), options.get("suffix", "")
        self.unpack = options.get("unpack", "false").lower() == "true"
        self.parts = tuple(map(int, options["parts"].split(","))) if "parts" in options else PARTS
        if self.content not in CONTENTS:
            raise ValueError(f"unknown content {self.content!r}: none, whole or parts")
        if self.unpack and self.content == "parts":
            raise ValueError("parts are of files as they are, not of what packed ones hold")

    def named(self, base: str) -> str:
        """The name of a file, or of what it holds."""
        return base.removesuffix(PACKED) if self.unpack else base

    def partitions(self) -> list[Files]:
        """All files below the folder, in tasks of even weight."""
        store, folder = opened(self.path)
        held, weight, tasks = [], 0, []
        at = store.get_file_info(folder)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        for info in [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder, recursive=True)):
            if info.type != fs.FileType.File or not self.named(info.base_name).endswith(self.suffix):
                continue
            cost = {"none": 0, "whole": info.size, "parts": min(info.size, sum(self.parts))}[self.content]
            if held and (weight + cost > TASK_BYTES or len(held) >= TASK_FILES):
                tasks.append(Files(folder, held))
                held, weight = [], 0
            held.append((info.path[len(folder) :], info.size, info.mtime_ns))
            weight += cost
        return [*tasks, Files(folder, held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = {"none": (), "whole": ("content",), "parts": ("head", "middle", "tail")}[self.content]
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), *[(n, pa.binary()) for n in names]])
        store, _ = opened(self.path)
        rows, weight = [], 0
        for below, size, modified in partition.files:
            path, pieces = partition.folder + below, ()
            if names:
                ranges = part_ranges(size, self.parts) if self.content == "parts" else ((0, size),)
                if any(length > MOST_BYTES for _, length in ranges):
                    raise ValueError(f"{path} has {size} bytes, too many for a column: read its parts, or its hash (file_hashes)")
                with store.open_input_file(path) as file:
                    pieces = tuple(read_range(file, *r) for r in ranges)
                if self.unpack and path.endswith(PACKED):
                    pieces = tuple(unpacked(path, piece) for piece in pieces)
            cost = sum(map(len, pieces))
            if rows and (weight + cost > BATCH_BYTES or len(rows) >= 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, weight = [], 0
            rows.append((path, self.named(posixpath.basename(path)), size, modified, *pieces))
            weight += cost
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def file_name(name: str | None) -> str:
    """The name, if a file can have it."""
    if not name or name in (".", "..") or re.search(r"[/\x00]", name) or len(name.encode()) > 255:
        raise ValueError(f"a file can't be named {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    """How many documents a task has staged."""

    documents: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.packed = options.get("packed", "false").lower() == "true"

    def places(self) -> tuple[fs.FileSystem, str, str]:
        """The store, the folder, and the stage beside it."""
        store, folder = opened(self.path)
        return store, folder, posixpath.join(posixpath.dirname(folder), f".staged-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, _, stage = self.places()
        passing = f"{stage}/passing"
        count = 0
        for batch in iterator:
            # One by one, as a batch of documents may be large.
            for name, content in ((n.as_py(), c.as_py()) for n, c in zip(batch.column("name"), batch.column("content"), strict=True)):
                data = content.encode() if isinstance(content, str) else content or b""
                if self.packed:
                    name, data = name and name + PACKED, gzip.compress(data, LEVEL, mtime=0)
                file_name(name)
                if not count:
                    store.create_dir(passing, recursive=True)
                    store.create_dir(f"{stage}/whole", recursive=True)
                half = f"{passing}/{uuid.uuid4().hex}"
                with store.open_output_stream(half) as file:
                    file.write(data)
                store.move(half, f"{stage}/whole/{name}")
                count += 1
        return Staged(count)

    def commit(self, messages: list[Staged | None]) -> None:
        store, folder, stage = self.places()
        whole = f"{stage}/whole"
        store.create_dir(whole, recursive=True)
        names = [info.base_name for info in store.get_file_info(fs.FileSelector(whole))]
        documents = sum(m.documents for m in messages if m is not None)
        if len(names) != documents:
            store.delete_dir(stage)
            raise ValueError(f"{documents} documents have {len(names)} different names")
        there = store.get_file_info(folder).type == fs.FileType.Directory
        if self.overwrite or not there:
            if there:
                store.move(folder, f"{stage}/old") if isinstance(store, fs.LocalFileSystem) else store.delete_dir(folder)
            if isinstance(store, fs.LocalFileSystem | fs.HadoopFileSystem):
                store.create_dir(posixpath.dirname(folder), recursive=True)
                store.move(whole, folder)
                store.delete_dir(stage)
                return
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda name: store.move(f"{whole}/{name}", f"{folder}/{name}"), names))
        store.delete_dir(stage)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _, stage = self.places()
        if store.get_file_info(stage).type == fs.FileType.Directory:
            store.delete_dir(stage)


class Documents(DataSource):
    """The data source `documents`."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return CONTENTS.get(self.options.get("content", "whole"), LISTED)

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), overwrite)


def read_documents(spark: SparkSession, path: str, content: str = "whole", parts: tuple[int, int, int] = PARTS, suffix: str = "", unpack: bool = False) -> DataFrame:
    """The files below a folder (or one file) whose names end in the suffix: path, name, size, modified (nanoseconds), and their content: 'whole', in 'parts' (head, middle, tail), or 'none'. With `unpack`, files packed by gzip have the name and content of what they hold, and the size that they take."""
    spark.dataSource.register(Documents)
    return spark.read.format("documents").option("content", content).option("suffix", suffix).option("parts", ",".join(map(str, parts))).option("unpack", str(unpack).lower()).load(path)


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite", packed: bool = False) -> None:
    """documents (name, content) as files of these names; `packed` by gzip, under these names and '.gz'. Two documents of one name, or a name that no file can have, are an error, and then the folder stays as it was. With mode 'append' files of other names stay, those of these names are replaced."""
    documents.sparkSession.dataSource.register(Documents)
    # Contents aren't shuffled to bring equal names together: the commit counts what is staged.
    documents.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).write.format("documents").mode(mode).option("packed", str(packed).lower()).save(path)
