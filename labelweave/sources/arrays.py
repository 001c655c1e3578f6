"""Array files as tables: npy (one array) and npz (a matrix in compressed sparse rows), read and written in parallel.

    sources.register(spark)
    spark.read.format("npy").load(path)      # (instance_id, values), or (instance_id, value) of one dimension
    spark.read.format("npy").option("scores", other).load(path)   # (instance_id, label_id, eta) of two arrays side by side
    spark.read.format("npz").load(path)      # (instance_id, label_id, value)
    write_npy(rows, path, n), write_npz(cells, path, n, m)

A header tells where each row lies, so the driver reads headers alone and plans ranges of rows; a task seeks
its range and emits batches of at most `batchCells` numbers, whatever the file's size. A path may be a file
or a folder, whose files follow one another in the order of their names. Members of an npz file that are
stored as they are can be read from any place; compressed ones have to be unpacked from their start, so
such a file is one task, in bounded memory, unless `partitions` asks for more (each unpacks what it skips).
"""

from __future__ import annotations

import io
import math
import pickle
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from numpy.lib import format as npformat
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Spark's name of each kind of number; unsigned ones and half precision go to the next wider type.
KINDS = {"b1": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "f2": "float", "f4": "float", "f8": "double"}
ARROW = {"boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
#: What a pickled array of lists needs; nothing else is ever called.
HARMLESS = {("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar")}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def files_of(path: str, suffix: str) -> list[str]:
    """The path itself, or the folder's files with the suffix by name."""
    fs, p = filesystem(path)
    if fs.get_file_info(p).type != pafs.FileType.Directory:
        return [path]
    head = path.rstrip("/")
    return sorted(f"{head}/{f.base_name}" for f in fs.get_file_info(pafs.FileSelector(p)) if f.base_name.endswith(suffix) and not f.base_name.startswith(("_", ".")))


class Careful(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in HARMLESS:
            raise pickle.UnpicklingError(f"{module}.{name} does not belong into an array of lists")
        return super().find_class(module, name)


@dataclass
class Header:
    shape: tuple[int, ...]
    fortran: bool
    dtype: np.dtype
    start: int

    @property
    def kind(self) -> str:
        name = f"{self.dtype.kind}{self.dtype.itemsize}"
        if name not in KINDS:
            raise ValueError(f"arrays of {self.dtype} are not read")
        return KINDS[name]

    @property
    def width(self) -> int:
        return math.prod(self.shape[1:])


def header(f) -> Header:
    version = npformat.read_magic(f)
    shape, fortran, dtype = (npformat.read_array_header_1_0 if version == (1, 0) else npformat.read_array_header_2_0)(f)
    return Header(shape, fortran and len(shape) > 1, dtype, f.tell())


class Array:
    """An array in a file, or in a member of an npz file; `take` gives numbers from a place on, `rows` whole rows."""

    def __init__(self, path: str, member: str | None = None):
        fs, p = filesystem(path)
        self.file = fs.open_input_file(p)
        self.base, self.packed = 0, False
        if member is not None:
            self.zip = zipfile.ZipFile(self.file)
            info = self.zip.getinfo(f"{member}.npy")
            self.packed = info.compress_type != zipfile.ZIP_STORED
            if self.packed:
                self.file = self.zip.open(info)
            else:
                self.file.seek(info.header_offset + 26)
                self.base = info.header_offset + 30 + sum(struct.unpack("<HH", self.file.read(4)))
                self.file.seek(self.base)
        self.header = header(self.file)

    def take(self, first: int, n: int) -> np.ndarray:
        """n numbers from the first on, in the order of the file."""
        size = self.header.dtype.itemsize
        self.file.seek(self.header.start + first * size)
        data = self.file.read(n * size)
        if len(data) != n * size:
            raise ValueError("the file is shorter than its header says")
        return np.frombuffer(data, self.header.dtype).astype(self.header.dtype.newbyteorder("="), copy=False)

    def rows(self, first: int, n: int) -> np.ndarray:
        h = self.header
        if h.fortran:
            return np.stack([self.take(c * h.shape[0] + first, n) for c in range(h.width)], axis=1)
        return self.take(first * h.width, n * h.width).reshape(n, *((h.width,) if len(h.shape) > 1 else ()))

    def lists(self) -> list:
        """A pickled array of lists, which can't be read in parts."""
        return list(Careful(io.BytesIO(self.file.read())).load())


@dataclass
class Rows(InputPartition):
    """Rows [first, first + n) of a file whose first row is instance `offset`."""

    path: str
    offset: int
    first: int
    n: int


class Range:
    """Bounds of instance_id from filters; Spark checks them again on what is read."""

    def __init__(self):
        self.low, self.high = 0, math.inf

    def narrow(self, f: Filter) -> None:
        if getattr(f, "attribute", None) != ("instance_id",) or not isinstance(getattr(f, "value", None), int):
            return
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value + (not isinstance(f, LessThan)))

    def plan(self, path: str, offset: int, n: int, step: int) -> list[Rows]:
        low, high = max(0, self.low - offset), max(0, min(n, self.high - offset))
        return [Rows(path, offset, a, min(step, high - a)) for a in range(low, high, step)]


def _lists(flat: np.ndarray, width: int, kind: str) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) // max(1, width) + 1, dtype=np.int32) * width), pa.array(flat, ARROW[kind]))


def _wider(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32) if x.dtype == np.float16 else x


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.range, self.scores = given["path"], Range(), given.get("scores")
        self.bytes, self.cells, self.wanted = (int(given.get(k, v)) for k, v in (("partitionbytes", 64 << 20), ("batchcells", 1 << 20), ("partitions", 0)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.range.narrow(f)
            yield f


class NpyReader(ArrayReader):
    def partitions(self) -> list[InputPartition]:
        out, offset = [], 0
        for path in files_of(self.path, ".npy"):
            h = Array(path).header
            if h.dtype.hasobject:
                out += [Rows(path, offset, 0, h.shape[0])]
            else:
                out += self.range.plan(path, offset, h.shape[0], max(1, self.bytes // max(1, h.width * h.dtype.itemsize)))
            offset += h.shape[0]
        return out or [Rows("", 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        array = Array(part.path)
        if array.header.dtype.hasobject:
            lists = [None if x is None else [int(j) for j in x] for x in array.lists()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lists)) + part.offset), pa.array(lists, pa.list_(pa.int64()))], names=["instance_id", "values"])
            return
        h, scores = array.header, Array(self.scores) if self.scores else None
        step = max(1, self.cells // max(1, h.width))
        for a in range(part.first, part.first + part.n, step):
            n = min(step, part.first + part.n - a)
            x, ids = _wider(array.rows(a, n)), np.arange(a, a + n) + part.offset
            if scores is not None:
                s = _wider(scores.rows(a, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, h.width)), pa.array(x.ravel().astype(np.int32)), pa.array(s.ravel().astype(np.float64))], names=["instance_id", "label_id", "eta"])
            elif len(h.shape) == 1:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x, ARROW[h.kind])], names=["instance_id", "value"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(np.ascontiguousarray(x).ravel(), h.width, h.kind)], names=["instance_id", "values"])


class NpzReader(ArrayReader):
    def partitions(self) -> list[InputPartition]:
        out, offset = [], 0
        for path in files_of(self.path, ".npz"):
            form = Array(path, "format").take(0, 1)[0]
            if (form.decode() if isinstance(form, bytes) else str(form)) != "csr":
                raise ValueError("only matrices in compressed sparse rows are read")
            n, data = int(Array(path, "shape").take(0, 2)[0]), Array(path, "data")
            pieces = self.wanted or (1 if data.packed else math.ceil(data.header.shape[0] * (data.header.dtype.itemsize + 4) / self.bytes))
            out += self.range.plan(path, offset, n, max(1, math.ceil(n / max(1, pieces))))
            offset += n
        return out or [Rows("", 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        starts, index, data = (Array(part.path, x) for x in ("indptr", "indices", "data"))
        for a in range(part.first, part.first + part.n, self.cells):
            n = min(self.cells, part.first + part.n - a)
            at = starts.take(a, n + 1).astype(np.int64)
            for s in range(int(at[0]), int(at[-1]), self.cells):
                size = min(self.cells, int(at[-1]) - s)
                row = np.searchsorted(at, np.arange(s, s + size), "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(row + a + part.offset), pa.array(index.take(s, size).astype(np.int32)), pa.array(_wider(data.take(s, size)), ARROW[data.header.kind])], names=["instance_id", "label_id", "value"])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class BlockWriter(DataSourceArrowWriter):
    """Writes each block of rows as a file of its own, under a name that is made final once all tasks have succeeded."""

    def __init__(self, options: dict, overwrite: bool, suffix: str):
        given = {k.lower(): v for k, v in options.items()}
        self.path, self.suffix, self.overwrite, self.run = given["path"].rstrip("/"), suffix, overwrite, uuid.uuid4().hex
        self.size, self.n, self.m = (int(given[x]) for x in ("blockrows", "rows", "labels"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(f"{root}/_{self.run}", recursive=True)
        names, now, held = [], None, []

        def flush() -> None:
            if now is None:
                return
            name = f"part-{now:09d}{self.suffix}"
            draft = f"{root}/_{self.run}/{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as f:
                f.write(self.block(pa.Table.from_batches(held), now * self.size, min(self.size, self.n - now * self.size)))
            names.append((draft, f"{root}/{name}"))

        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and block[a] != now:
                    flush()
                    now, held = int(block[a]), []
                if a < b:
                    held.append(batch.slice(a, b - a))
        flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        if self.overwrite:
            for old in files_of(self.path, self.suffix):
                if old != self.path:
                    fs.delete_file(f"{root}/{old.rsplit('/', 1)[1]}")
        for message in messages:
            for draft, name in message.names if message else []:
                fs.move(draft, name)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        if fs.get_file_info(f"{root}/_{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_{self.run}")


def _npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    npformat.write_array(out, x, allow_pickle=False)
    return out.getvalue()


class NpyWriter(BlockWriter):
    def block(self, t: pa.Table, first: int, n: int) -> bytes:
        ids, values = t["instance_id"].to_numpy(), t["values"].combine_chunks()
        if not np.array_equal(np.sort(ids), np.arange(first, first + n)):
            raise ValueError(f"rows {first} to {first + n - 1} are not there once each")
        width = np.diff(values.offsets.to_numpy())
        if values.null_count or (width != width[0]).any():
            raise ValueError("rows of an array have to be equally long")
        return _npy(values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[np.argsort(ids)])


class NpzWriter(BlockWriter):
    def block(self, t: pa.Table, first: int, n: int) -> bytes:
        t = t.filter(t["label_id"].is_valid())
        ids, label, value = (t[c].to_numpy() for c in ("instance_id", "label_id", "value"))
        order = np.lexsort((label, ids))
        members = {"indices": label[order].astype(np.int32), "indptr": np.concatenate([[0], np.cumsum(np.bincount(ids - first, minlength=n))]).astype(np.int64), "format": np.array(b"csr"), "shape": np.array([n, self.m]), "data": value[order]}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, x in members.items():
                z.writestr(f"{name}.npy", _npy(x))
        return out.getvalue()


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        if self.options.get("scores"):
            return "instance_id bigint, label_id int, eta double"
        found = files_of(self.options["path"], ".npy")
        if not found:
            raise ValueError("no npy file there")
        h = Array(found[0]).header
        if h.dtype.hasobject:
            return "instance_id bigint, values array<bigint>"
        return f"instance_id bigint, value {h.kind}" if len(h.shape) == 1 else f"instance_id bigint, values array<{h.kind}>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options), overwrite, ".npy")


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        found = files_of(self.options["path"], ".npz")
        if not found:
            raise ValueError("no npz file there")
        return f"instance_id bigint, label_id int, value {Array(found[0], 'data').header.kind}"

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(dict(self.options), overwrite, ".npz")


def register(spark: SparkSession) -> None:
    """Make the formats npy and npz known to the session, and let filters of instance_id reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpySource)
    spark.dataSource.register(NpzSource)


def _write(rows: DataFrame, form: str, path: str, n: int, m: int, block_rows: int) -> None:
    register(rows.sparkSession)
    blocks = math.ceil(n / block_rows)
    partitions = min(max(1, blocks), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8)
    sorted_ = rows.withColumn("block", F.floor(F.col("instance_id") / block_rows)).repartitionByRange(partitions, "block").sortWithinPartitions("block")
    sorted_.write.format(form).mode("overwrite").options(path=path, rows=n, labels=m, blockRows=block_rows).save()


def write_npy(rows: DataFrame, path: str, n: int, *, block_rows: int = 65_536) -> None:
    """Rows (instance_id from 0 to n - 1, values array) as one npy file for each `block_rows` rows; a task holds one block."""
    _write(rows.select("instance_id", "values"), "npy", path, n, 0, block_rows)


def write_npz(cells: DataFrame, path: str, n: int, m: int, *, block_rows: int = 65_536) -> None:
    """Cells (instance_id from 0 to n - 1, label_id below m, value) as npz files of compressed sparse rows, as they are stored
    without packing; rows without cells are empty. A task holds one block of `block_rows` rows."""
    own = cells.select("instance_id", F.col("label_id").cast("int"), "value")
    first = cells.sparkSession.range(0, n, block_rows).select(F.col("id").alias("instance_id"), F.lit(None).cast("int").alias("label_id"), F.lit(None).cast(own.schema["value"].dataType).alias("value"))
    _write(own.unionByName(first), "npz", path, n, m, block_rows)
