"""A data source for files of fixed-width binary records.

``spark.read.format("fixedwidth").load(folder)`` gives ``key binary, value binary, path
string, record bigint`` (``record`` is the 0-based record number in its file). Files are
split at record boundaries and each split is one input partition, in path order. Rows
travel as Arrow batches. ``df.write.format("fixedwidth").save(folder)`` writes key and
value bytes of each row in part files numbered by partition.

What a folder holds is told by its newest manifest, ``_manifest/<number>.json``: the list
of its files with their sizes. Tasks write files of final, job-unique names; a commit is one
manifest, written aside and renamed, so it costs one rename however many files there are,
readers see all of a job or nothing, and files of attempts that failed are never read. An
append lists the older files too, an overwrite removes them once its manifest counts. Of two
jobs that commit at the same time, the later one fails. A folder without a manifest is
read as it is.

Options: ``keyBytes`` (10), ``recordBytes`` (100), ``splitBytes`` (128 MB), ``sync``
(false; true flushes every file to stable storage before it is committed, and is refused
where that cannot be asked for). :func:`read_records` and :func:`write_records` resolve a
path without scheme on the session's default file system.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

BATCH_RECORDS = 65536


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path[5:] if path.startswith("file:") else path


def fixed_binary(block: np.ndarray) -> pa.Array:
    """A contiguous (n, w) byte matrix as a binary column, without a Python loop."""
    n, w = block.shape
    offsets = np.arange(0, (n + 1) * w, w, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(block))])


@dataclass
class _Split(InputPartition):
    path: str
    first: int
    count: int


@dataclass
class _Written(WriterCommitMessage):
    name: str
    size: int


MANIFESTS = "_manifest"


def _manifest(fs: pafs.FileSystem, root: str) -> tuple[int, list[dict]]:
    """Number and file list of the newest manifest; -1 if the folder has none."""
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    numbers = [int(f.base_name[:-5]) for f in found if f.is_file and f.base_name.endswith(".json")]
    if not numbers:
        return -1, []
    with fs.open_input_stream(f"{root}/{MANIFESTS}/{max(numbers)}.json") as handle:
        return max(numbers), json.loads(handle.read())["files"]


def _data_files(fs: pafs.FileSystem, root: str) -> list[tuple[str, int]]:
    """Paths and sizes of the data files, in path order."""
    info = fs.get_file_info(root)
    if info.is_file:
        return [(info.path, info.size)]
    number, listed = _manifest(fs, root)
    if number >= 0:
        return sorted((f"{root}/{f['name']}", f["size"]) for f in listed)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._")


class FixedWidthSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixedwidth"

    def schema(self) -> str:
        return "key binary, value binary, path string, record bigint"

    def _sizes(self) -> tuple[int, int]:
        return int(self.options.get("keyBytes", 10)), int(self.options.get("recordBytes", 100))

    def _folder(self) -> str:
        if not self.options.get("path"):
            raise ValueError("fixedwidth needs a path")
        return self.options["path"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._folder(), *self._sizes(), int(self.options.get("splitBytes", 128 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        names = [f.name for f in schema.fields]
        sync = str(self.options.get("sync", "false")).lower() == "true"
        return _Writer(self._folder(), *self._sizes(), names.index("key"), names.index("value"), overwrite, sync)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, key_bytes: int, record_bytes: int, split_bytes: int):
        self.folder, self.key_bytes, self.record_bytes = folder, key_bytes, record_bytes
        self.per_split = max(split_bytes // record_bytes, 1)

    def partitions(self):
        splits = []
        for path, size in _data_files(*_open(self.folder)):
            if size % self.record_bytes:
                raise ValueError(f"{path}: {size} bytes is not a whole number of {self.record_bytes}-byte records")
            total = size // self.record_bytes
            splits += [_Split(path, at, min(self.per_split, total - at)) for at in range(0, total, self.per_split)]
        return splits or [_Split("", 0, 0)]

    def read(self, split: _Split):
        if not split.count:
            return
        fs, _ = _open(self.folder)
        with fs.open_input_file(split.path) as handle:
            done = 0
            while done < split.count:
                n = min(BATCH_RECORDS, split.count - done)
                first = split.first + done
                data = handle.read_at(n * self.record_bytes, first * self.record_bytes)
                if len(data) != n * self.record_bytes:
                    raise ValueError(f"{split.path}: file ended inside a record")
                block = np.frombuffer(data, np.uint8).reshape(n, self.record_bytes)
                yield pa.RecordBatch.from_arrays(
                    [
                        fixed_binary(block[:, : self.key_bytes]),
                        fixed_binary(block[:, self.key_bytes :]),
                        pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), [split.path]).cast(pa.string()),
                        pa.array(np.arange(first, first + n, dtype=np.int64)),
                    ],
                    ["key", "value", "path", "record"],
                )
                done += n


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder, key_bytes, record_bytes, key_at, value_at, overwrite, sync):
        self.folder, self.key_bytes, self.record_bytes = folder, key_bytes, record_bytes
        self.key_at, self.value_at, self.overwrite, self.sync = key_at, value_at, overwrite, sync
        self.job = uuid.uuid4().hex
        fs, root = _open(folder)
        if sync and not isinstance(fs, pafs.LocalFileSystem):
            raise ValueError(f"sync cannot be asked for on a {fs.type_name} file system")
        self.before = _manifest(fs, root)[0]

    def write(self, iterator):
        fs, root = _open(self.folder)
        context = TaskContext.get()
        # an attempt has a name of its own; only the one that commits is listed
        name = f"part-{context.partitionId():06d}-{self.job[:8]}-{context.taskAttemptId()}"
        size, out = 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = open(f"{root}/{name}", "wb") if self.sync else fs.open_output_stream(f"{root}/{name}")
                block = np.hstack([_bytes_of(batch.column(self.key_at), self.key_bytes),
                                   _bytes_of(batch.column(self.value_at), self.record_bytes - self.key_bytes)])
                out.write(block.tobytes())
                size += block.size
            if out is not None and self.sync:
                out.flush()
                os.fsync(out.fileno())
        finally:
            if out is not None:
                out.close()
        return _Written(name, size)

    def commit(self, messages):
        fs, root = _open(self.folder)
        number, held = _manifest(fs, root)
        if number != self.before:
            raise RuntimeError(f"{root} was written by another job meanwhile")
        older = held if number >= 0 else self._loose(fs, root)
        new = [{"name": m.name, "size": m.size} for m in messages if m is not None and m.size]
        listed = new if self.overwrite else [*older, *new]
        fs.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        aside = f"{root}/{MANIFESTS}/_{self.job}"
        with fs.open_output_stream(aside) as out:
            out.write(json.dumps({"files": listed}).encode())
        fs.move(aside, f"{root}/{MANIFESTS}/{number + 1}.json")
        if self.overwrite:
            for f in older:
                fs.delete_file(f"{root}/{f['name']}")

    def _loose(self, fs, root):
        """Data files of a folder that had no manifest so far, without those of this job."""
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [{"name": f.base_name, "size": f.size} for f in found
                if f.is_file and f.base_name[0] not in "._" and f"-{self.job[:8]}-" not in f.base_name]

    def abort(self, messages):
        fs, root = _open(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        for f in found:
            if f.is_file and f"-{self.job[:8]}-" in f.base_name:
                fs.delete_file(f.path)


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    n = len(column)
    if n == 0:
        return np.empty((0, width), np.uint8)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    if column.null_count or (np.diff(offsets) != width).any():
        raise ValueError(f"expected {width} bytes in every row")
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, width)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FixedWidthSource)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the session's default file system, unless it has one:
    on a cluster, a bare path is not each machine's own disk."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole if "://" in whole else whole.replace(":/", ":///", 1)


def read_records(spark: SparkSession, folder: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("fixedwidth").options(**options).load(qualified(spark, folder))


def write_records(records: DataFrame, folder: str, mode: str = "overwrite", **options) -> None:
    if not folder:
        raise ValueError("an output folder must be set")
    spark = records.sparkSession
    register(spark)
    records.select("key", "value").write.format("fixedwidth").options(**options).mode(mode).save(qualified(spark, folder))
