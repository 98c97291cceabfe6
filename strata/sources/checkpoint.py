"""Network checkpoints: the zip container that a training framework writes, as a
Spark data source, without that framework.

The container holds a pickled index (tensor name -> storage, offset, sizes, strides)
and one raw record per storage. The index is read with an unpickler that knows a
few names only and calls nothing of what the file names; anything else in
it is refused. The driver reads the index and plans one partition per tensor; each
task then reads its own record. ``spark.read.format("checkpoint").load(path)``
gives the weights table ``(name, shape, values)``. Files are opened with
``pyarrow.fs``, so the store must be one that pyarrow knows (local or mounted
folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import io
import pickle
import struct
import sys
import zipfile
from collections import OrderedDict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, shape array<int>, values array<double>"
#: A larger index is refused: it holds names and sizes, no values.
MAX_INDEX_BYTES = 64 << 20

# Storage names of the format and the numbers they hold.
STORAGES = {"FloatStorage": "f4", "DoubleStorage": "f8", "HalfStorage": "f2", "BFloat16Storage": "bf16", "LongStorage": "i8",
            "IntStorage": "i4", "ShortStorage": "i2", "CharStorage": "i1", "ByteStorage": "u1", "BoolStorage": "?"}


class CheckpointError(ValueError):
    pass


@dataclass(frozen=True)
class Storage:
    kind: str
    key: str
    numel: int


@dataclass(frozen=True)
class Tensor:
    storage: Storage
    offset: int
    shape: tuple[int, ...]
    strides: tuple[int, ...]


def _tensor(storage, offset, shape, strides, *_):
    if not isinstance(storage, Storage) or len(shape) != len(strides) or offset < 0 or any(n < 0 for n in (*shape, *strides)):
        raise CheckpointError("a tensor of the index is malformed")
    if all(shape) and offset + sum((n - 1) * s for n, s in zip(shape, strides)) >= storage.numel:
        raise CheckpointError("a tensor reaches beyond its storage")
    return Tensor(storage, int(offset), tuple(map(int, shape)), tuple(map(int, strides)))


class _Index(pickle.Unpickler):
    _KNOWN = {("collections", "OrderedDict"): OrderedDict, ("torch._utils", "_rebuild_tensor_v2"): _tensor,
              ("torch._utils", "_rebuild_parameter"): lambda data, *_: data}

    def find_class(self, module, name):
        if (module, name) in self._KNOWN:
            return self._KNOWN[module, name]
        if module == "torch" and name in STORAGES:
            return _Kind(STORAGES[name])
        raise CheckpointError(f"refused: the checkpoint's index names {module}.{name}")

    def persistent_load(self, pid):
        if not (isinstance(pid, tuple) and len(pid) == 5 and pid[0] == "storage" and isinstance(pid[1], _Kind)):
            raise CheckpointError("refused: an unknown reference in the checkpoint's index")
        return Storage(pid[1].name, str(pid[2]), int(pid[4]))


@dataclass(frozen=True)
class _Kind:
    name: str


def store(path: str):
    """(file system, path on it) of a path or URI."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path[len("file:"):]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str) -> zipfile.ZipFile:
    where, at = store(path)
    try:
        return zipfile.ZipFile(where.open_input_file(at))
    except zipfile.BadZipFile as e:
        raise CheckpointError(f"{path} is no checkpoint container") from e


def _flat(tree, prefix: str = "") -> Iterator[tuple[str, Tensor]]:
    if isinstance(tree, Tensor):
        yield prefix, tree
    elif isinstance(tree, Mapping):
        for k, v in tree.items():
            yield from _flat(v, f"{prefix}.{k}" if prefix else str(k))


def index(path: str) -> tuple[list[tuple[str, Tensor]], str, str]:
    """Tensors by name (nested dictionaries joined by dots; other values are left
    out), the container's root folder and its byte order."""
    with _open(path) as z:
        at = [n for n in z.namelist() if n.endswith("data.pkl")]
        if len(at) != 1:
            raise CheckpointError(f"{path} has no index")
        if z.getinfo(at[0]).file_size > MAX_INDEX_BYTES:
            raise CheckpointError(f"the index of {path} is larger than {MAX_INDEX_BYTES} bytes")
        root = at[0][:-len("data.pkl")]
        order = z.read(f"{root}byteorder").decode().strip() if f"{root}byteorder" in z.namelist() else "little"
        try:
            tree = _Index(io.BytesIO(z.read(at[0]))).load()
        except CheckpointError:
            raise
        except Exception as e:  # a damaged index can fail anywhere in the unpickler
            raise CheckpointError(f"the index of {path} cannot be read: {e}") from e
    return list(_flat(tree)), root, "<" if order == "little" else ">"


def read_tensor(path: str, root: str, order: str, tensor: Tensor) -> np.ndarray:
    s = tensor.storage
    with _open(path) as z:
        raw = z.read(f"{root}data/{s.key}")
    kind = np.dtype("u2" if s.kind == "bf16" else s.kind).newbyteorder(order)
    if len(raw) < s.numel * kind.itemsize:
        raise CheckpointError(f"storage {s.key} of {path} is cut short")
    flat = np.frombuffer(raw, kind, s.numel)
    if s.kind == "bf16":
        flat = (flat.astype(np.uint32) << 16).view(np.float32)
    flat = flat.astype(np.float64)[tensor.offset:]
    if not all(tensor.shape):
        return np.zeros(tensor.shape)
    return np.lib.stride_tricks.as_strided(flat, tensor.shape, [n * 8 for n in tensor.strides]).copy()


class _One(InputPartition):
    def __init__(self, name: str, tensor: Tensor, root: str, order: str):
        super().__init__(name)
        self.name, self.tensor, self.root, self.order = name, tensor, root, order


class CheckpointReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        tensors, root, order = index(self.path)
        return [_One(name, t, root, order) for name, t in tensors]

    def read(self, partition):
        v = read_tensor(self.path, partition.root, partition.order, partition.tensor)
        yield partition.name, [int(n) for n in v.shape], v.ravel().tolist()


class CheckpointSource(DataSource):
    """``spark.read.format("checkpoint").load(path)`` -> the weights table."""

    @classmethod
    def name(cls):
        return "checkpoint"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        if "path" not in self.options:
            raise CheckpointError("a checkpoint needs a path")
        return CheckpointReader(self.options["path"])


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The weights table ``(name, shape, values)`` of a checkpoint file."""
    spark.dataSource.register(CheckpointSource)
    return spark.read.format("checkpoint").load(path)


# --- writing


def _text(s: str) -> bytes:
    raw = s.encode()
    return b"X" + struct.pack("<I", len(raw)) + raw


def _ints(values) -> bytes:
    return b"(" + b"".join(b"J" + struct.pack("<i", int(v)) for v in values) + b"t"


def save_checkpoint(weights: Mapping[str, np.ndarray], path: str) -> None:
    """Write parameters (bounded by the model) as a checkpoint that the training
    framework can load too: an ordered dictionary of tensors of doubles."""
    empty = b"ccollections\nOrderedDict\n)R"
    body = b"\x80\x02" + empty + b"("
    for k, (name, v) in enumerate(weights.items()):
        v = np.asarray(v, np.float64)
        strides = [int(np.prod(v.shape[i + 1:])) for i in range(v.ndim)]
        storage = b"(" + _text("storage") + b"ctorch\nDoubleStorage\n" + _text(str(k)) + _text("cpu") + b"J" + struct.pack("<i", v.size) + b"tQ"
        body += _text(name) + b"ctorch._utils\n_rebuild_tensor_v2\n(" + storage + b"J" + struct.pack("<i", 0) + _ints(v.shape) + _ints(strides) + b"\x89" + empty + b"tR"
    body += b"u."
    where, at = store(path)
    if "/" in at:
        where.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(at) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.pkl", body)
        z.writestr("archive/byteorder", "little")
        for k, v in enumerate(weights.values()):
            z.writestr(f"archive/data/{k}", np.ascontiguousarray(v, "<f8").tobytes())
        z.writestr("archive/version", "3\n")


register_pickle_by_value(sys.modules[__name__])
