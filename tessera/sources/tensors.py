"""Tensor files: spark.read.format("safetensors").load(path) gives the values of each tensor, in rows of at most 2^20; `write` makes files of such rows.

A file begins with the size of its header (8 bytes), then the header, JSON with a dtype, shape and byte range for each tensor, then
their bytes. Headers are read to plan; tasks read byte ranges of at most 64 MB, so a tensor may be of any size. `start` is the place of a row's
first value in the tensor; an empty tensor has one row. Paths are files, folders or globs, local or URIs that Arrow's file systems open. 32-bit
integers, 16- and 32-bit and 64-bit floats are known; U64 is an error here rather than being read as floats. Entries without byte range
are skipped.

`read` takes globs of paths and names, which are applied when a read is planned: headers of other files are not read, and ranges of other tensors
neither. (They are options, not conditions pushed down: what Spark 4.1.2 has pushed into a Python source for one plan of a DataFrame stays for its other plans.)
A write puts each task's files into a folder of its own below the target; they move to the target together when all tasks are done, and
go if one fails for good. What a lost task left behind goes with that folder."""

from __future__ import annotations

import fnmatch
import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.sources.files import placed

#: Values in a row and in a task.
ROW, TASK = 1 << 20, 1 << 23
DTYPES = {"I32": "<i4", "U32": "<u4", "F16": "<f2", "F32": "<f4", "F64": "<f8"}
_OTHER = {b"GGUF": "gguf", b"\x93NUMPY": "numpy"}


class TensorError(ValueError):
    pass


def read_header(path: str) -> tuple[dict, int]:
    """Entries by name, and where the bytes begin."""
    if os.path.splitext(path)[1] not in (".safetensors", ".gguf", ".mlx"):
        raise TensorError(f"not supported: {path}")
    system, place = placed(path)
    with system.open_input_file(place) as f:
        head = f.read(8)
        for magic, name in _OTHER.items():
            if head.startswith(magic):
                raise TensorError(f"{name} files are not supported")
        if len(head) < 8:
            raise TensorError("the file is too short")
        size = int.from_bytes(head, "little")
        if size > f.size() - 8:
            raise TensorError("the header is longer than the file")
        entries = json.loads(f.read(size))
    return {k: v for k, v in entries.items() if isinstance(v, dict) and "data_offsets" in v}, 8 + size


def _type(name: str, entry: dict) -> np.dtype:
    if entry["dtype"] not in DTYPES:
        raise TensorError(f"unsupported type {entry['dtype']} of {name}")
    return np.dtype(DTYPES[entry["dtype"]])


def read_values(path: str, name: str, entry: dict, begin: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """A tensor's values from start to stop, flat."""
    kind, (a, b) = _type(name, entry), entry["data_offsets"]
    end = b if stop is None else min(b, a + stop * kind.itemsize)
    system, place = placed(path)
    with system.open_input_file(place) as f:
        return np.frombuffer(f.read_at(end - a - start * kind.itemsize, begin + a + start * kind.itemsize), dtype=kind)


def read_tensor(path: str, name: str, entry: dict, begin: int) -> np.ndarray:
    return read_values(path, name, entry, begin).reshape(entry["shape"])


def write_tensors(path: str, tensors: dict[str, np.ndarray]) -> None:
    names = {np.dtype(v): k for k, v in DTYPES.items()}
    header, blobs, at = {}, [], 0
    for name, x in tensors.items():
        data = np.ascontiguousarray(x).tobytes()
        header[name] = {"dtype": names[x.dtype], "shape": list(x.shape), "data_offsets": [at, at + len(data)]}
        blobs.append(data)
        at += len(data)
    text = json.dumps(header).encode()
    with open(path, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text + b"".join(blobs))


class _Range(InputPartition):
    """Values of a tensor, from start to stop."""

    def __init__(self, path: str, name: str, entry: dict, begin: int, start: int, stop: int):
        self.path, self.name, self.entry, self.begin, self.start, self.stop = path, name, entry, begin, start, stop


def _files(path: str) -> list[str]:
    """The tensor files of a folder, those that fit a glob in a folder, or one file; as URIs where the path is one."""
    from pyarrow import fs

    system, place = placed(path)
    whole = path[: len(path) - len(place)] if path.endswith(place) else ""
    if "*" in place:
        folder, pattern = place.rsplit("/", 1)
    elif system.get_file_info(place).type == fs.FileType.Directory:
        folder, pattern = place, "*.safetensors"
    else:
        return [path]
    found = system.get_file_info(fs.FileSelector(folder))
    return sorted(whole + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.wanted = {k: json.loads(options[k]) if k in options else None for k in ("files", "names")}

    def _wanted(self, option: str, value: str) -> bool:
        globs = self.wanted[option]
        return globs is None or any(fnmatch.fnmatchcase(value, g) for g in globs)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.path):
            if not self._wanted("files", path):
                continue
            entries, begin = read_header(path)
            for name, entry in entries.items():
                if not self._wanted("names", name):
                    continue
                a, b = entry["data_offsets"]
                n = (b - a) // _type(name, entry).itemsize
                out += [_Range(path, name, entry, begin, i, min(i + TASK, n)) for i in range(0, max(n, 1), TASK)]
        return out

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        p = partition
        if p is None:  # nothing to read is one part of Spark's
            return
        for i in range(p.start, max(p.stop, p.start + 1), ROW):
            x = read_values(p.path, p.name, p.entry, p.begin, i, min(i + ROW, p.stop)).astype(np.float64)
            values = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            shape = pa.array([p.entry["shape"]], pa.list_(pa.int64()))
            columns = [pa.array([p.path]), pa.array([p.name]), pa.array([p.entry["dtype"]]), shape, pa.array([i], pa.int64()), values]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "name", "dtype", "shape", "start", "values"])


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


class _Writer(DataSourceArrowWriter):
    """A task's tensors as one file. Its bytes are written as they come, then copied behind the header."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.own = options["path"].rstrip("/"), overwrite, f"_tensors-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, target = placed(self.path)
        file, folder = f"tensors-{uuid.uuid4().hex}.safetensors", f"{target}/{self.own}"
        system.create_dir(folder, recursive=True)
        header: dict[str, dict] = {}
        at, open_, left = 0, None, 0
        with system.open_output_stream(f"{folder}/{file}.bytes") as out:
            for batch in iterator:
                for name, dtype, shape, start, values in zip(*(batch.column(c) for c in ("name", "dtype", "shape", "start", "values")), strict=True):
                    name, start, kind = name.as_py(), start.as_py(), np.dtype(DTYPES.get(dtype.as_py()) or _type(name.as_py(), {"dtype": dtype.as_py()}))
                    data = values.values.to_numpy(zero_copy_only=False).astype(kind).tobytes()
                    if name != open_:
                        if left or name in header:
                            raise TensorError(f"values of {open_ if left else name} are missing, or not in order in one task")
                        size = math.prod(shape.as_py()) * kind.itemsize
                        header[name], open_, left = {"dtype": dtype.as_py(), "shape": shape.as_py(), "data_offsets": [at, at + size]}, name, size
                    begin, end = header[name]["data_offsets"]
                    if start * kind.itemsize != end - begin - left or len(data) > left:
                        raise TensorError(f"values of {name} are missing, or not in order in one task")
                    out.write(data)
                    at, left = at + len(data), left - len(data)
        if left:
            raise TensorError(f"values of {open_} are missing, or not in order in one task")
        if not header:
            return _Written(None)
        text = json.dumps(header).encode()
        with system.open_output_stream(f"{folder}/{file}") as out, system.open_input_stream(f"{folder}/{file}.bytes") as data:
            out.write(len(text).to_bytes(8, "little") + text)
            while some := data.read(8 << 20):
                out.write(some)
        return _Written(file)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, target = placed(self.path)
        system.create_dir(target, recursive=True)
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None and m.file is not None:
                system.move(f"{target}/{self.own}/{m.file}", f"{target}/{m.file}")
        for path in old:
            system.delete_file(placed(path)[1])
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, target = placed(self.path)
        if system.get_file_info(f"{target}/{self.own}").type == fs.FileType.Directory:
            system.delete_dir(f"{target}/{self.own}")


def read(spark: SparkSession, path: str, names: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """Values of the tensors whose names, and files whose paths, fit any of some globs."""
    reader = spark.read.format("safetensors")
    for option, globs in (("names", names), ("files", paths)):
        reader = reader if globs is None else reader.option(option, json.dumps(globs))
    return reader.load(path)


def write(rows: DataFrame, path: str, mode: str = "append", partitions: int | None = None) -> None:
    """Files of rows (name, dtype, shape, start, values) in a folder. A tensor is one task's, which sees its rows in order and holds one at a time."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"no mode {mode!r}")
    rows = rows.select("name", "dtype", "shape", "start", "values")
    dealt = rows.repartition("name") if partitions is None else rows.repartition(partitions, "name")
    dealt.sortWithinPartitions("name", "start").write.format("safetensors").mode(mode).save(path)


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return "path string, name string, dtype string, shape array<bigint>, start bigint, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SafetensorsSource)
