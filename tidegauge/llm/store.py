"""Files in the folder that driver and executors share, and sorted arrays that workers map into memory.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the master is local
(tests, single machine) a temporary folder of this process is used. Every file is written under a temporary
name and renamed. Where its content depends on its task's rows as a set, a task that runs again writes the
same bytes to the same place; where it depends on their order, the attempt is part of the name and of the rows.
Tasks return what they wrote, readers are told, and a file that should be there and is not is an error.
"""

from __future__ import annotations

import atexit
import mmap
import os
import shutil
import sys
import tempfile
import uuid
import weakref
from collections import deque

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
#: Arrays that a process keeps mapped, at most: Linux allows 65,530 maps.
MAPS = 48_000
#: Estimates of so many bytes say that Spark knows no size.
UNKNOWN = 1 << 50
_kept: deque = deque()
_count = 0


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder (URI) for one run of one operator."""
    global _own
    for key, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):  # long texts: a batch of many fills a worker
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
    if not base:
        if _own is None:
            _own = tempfile.mkdtemp(prefix="tidegauge-")
            atexit.register(shutil.rmtree, _own, True)
        base = f"file://{_own}"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    elif "://" not in base:
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    if path.startswith("file://"):
        os.makedirs(path[7:], exist_ok=True)
        if base != f"file://{_own}":
            atexit.register(shutil.rmtree, path[7:], True)
    return path


def saved(df: DataFrame, folder: str, name: str, **by: list[str]) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: it cuts the lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def put(folder: str, name: str, array: np.ndarray) -> None:
    data = np.ascontiguousarray(array)
    if folder.startswith("file://"):
        path = f"{folder[7:]}/{name}"
        tmp = f"{path}.{uuid.uuid4().hex}"
        data.tofile(tmp)
        os.replace(tmp, path)
        return
    fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
    tmp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as out:
        out.write(memoryview(data).cast("B"))
    fs.move(tmp, path)


def drop(folder: str, prefix: str) -> None:
    """Deletes the folder's entries of that prefix: for what no later step, and no task that runs again, can need."""
    fs, path = pafs.FileSystem.from_uri(folder)
    for x in fs.get_file_info(pafs.FileSelector(path)):
        if x.base_name.startswith(prefix):
            fs.delete_dir(x.path) if x.type == pafs.FileType.Directory else fs.delete_file(x.path)


def mapped(folder: str, name: str, dtype, least: int = 1) -> np.ndarray:
    """The array, mapped into memory; from a store without POSIX paths by way of an unlinked local copy. From Python 3.13 on a map keeps no file open.

    Raises FileNotFoundError where there is no such file, OSError where it holds fewer than ``least`` elements.
    """
    if folder.startswith("file://"):
        path, tmp = f"{folder[7:]}/{name}", None
    else:
        fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
        tmp = tempfile.NamedTemporaryFile()
        with fs.open_input_stream(path) as src:
            shutil.copyfileobj(src, tmp)
        tmp.flush()
        path = tmp.name
    size = os.path.getsize(path)
    if size < least * np.dtype(dtype).itemsize:
        raise OSError(f"{folder}/{name} holds {size} bytes, not {least} elements")
    if not size or sys.version_info < (3, 13):
        out = np.memmap(path, dtype=dtype, mode="r") if size else np.zeros(0, dtype)
    else:
        with open(path, "rb") as f:
            out = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), dtype)
    if tmp:
        tmp.close()
    return out


def keep(owner, key, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``arrays``, kept as ``owner._open[key]``; where this process keeps over ``MAPS``, what it opened first is let go, to be opened again when needed."""
    global _count
    owner._open[key] = arrays
    _kept.append((weakref.ref(owner), key, len(arrays)))
    _count += len(arrays)
    while _count > MAPS and len(_kept) > 1:
        of, old, n = _kept.popleft()
        _count -= n
        if (x := of()) is not None:
            x._open.pop(old, None)
    return arrays


def parts_for(df: DataFrame, each: int) -> int:
    """Into how many parts of ``each`` bytes of files the rows fall, by Spark's estimate of the plan's size; 8 at least, or the shuffle partitions if fewer.

    Rows without an estimate (of an RDD, say, for which Spark assumes the largest number) fall into as many parts as there are shuffle partitions.
    Shuffle partitions do not set the number otherwise: blocks go from parts to parts, and would grow with its square.
    """
    size, most = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size >= UNKNOWN:
        return max(1, most)
    return max(1, min(8, most), min(-(-size // each), 1 << 17))


class Lookup:
    """Sorted key arrays dealt over ``shards`` files by the keys' top bits, with value arrays beside them."""

    def __init__(self, folder: str, name: str, shards: int, values: dict[str, str]):
        self.folder, self.name, self.shards, self.values, self._open = folder, name, shards, values, {}
        self.sizes: dict[int, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def sealed(self, sizes: dict[int, int]) -> None:
        """Tells readers how many keys the writers put into each shard; shards without any need no file."""
        self.sizes = {int(s): int(n) for s, n in sizes.items() if n}

    def write(self, shard: int, keys: np.ndarray, **values: np.ndarray) -> None:
        """Files of a shard's sorted keys and of those value arrays that are given."""
        for k, array in values.items():
            put(self.folder, f"{self.name}-{shard}.{k}", array.astype(self.values[k]))
        put(self.folder, f"{self.name}-{shard}.key", keys.astype(np.uint64))

    def shard(self, s: int) -> dict[str, np.ndarray]:
        if s not in self._open:
            n = self.sizes.get(s, 0)
            return keep(self, s, {k: mapped(self.folder, f"{self.name}-{s}.{k}", d, n) if n else np.zeros(0, d) for k, d in (self.values | {"key": "u8"}).items()})
        return self._open[s]

    def of(self, keys: np.ndarray) -> np.ndarray:
        return shard_of(keys, self.shards)

    def find_in(self, keys: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """As ``find``, for keys in any order that lie in the shards given."""
        order = np.lexsort((keys, shard))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        hit, out = self._find(keys[order], shard[order])
        return hit[back], {k: v[back] for k, v in out.items()}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For sorted distinct ``keys``: whether each is there, and its values (0 where it is not)."""
        return self._find(keys, self.of(keys))

    def _find(self, keys: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        hit, out = np.zeros(len(keys), bool), {k: np.zeros(len(keys), d) for k, d in self.values.items()}
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            a, b, f = cuts[s], cuts[s + 1], self.shard(int(s))
            if not len(f["key"]):
                continue
            at = np.minimum(np.searchsorted(f["key"], keys[a:b]), len(f["key"]) - 1)
            ok = f["key"][at] == keys[a:b]
            hit[a:b] = ok
            for k in out:
                out[k][a:b][ok] = f[k][at[ok]]
        return hit, out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: monotone in the key, so shards of sorted keys are contiguous."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Appender:
    """One array in a file of the shared folder, written piece by piece; it appears whole or not at all."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.n = folder, name, 0
        if folder.startswith("file://"):
            self.path, self.fs = f"{folder[7:]}/{name}", None
        else:
            self.fs, self.path = pafs.FileSystem.from_uri(f"{folder}/{name}")
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.tmp) if self.fs else open(self.tmp, "wb")

    def add(self, array: np.ndarray) -> int:
        """The index of the array's first element in the file."""
        at, self.n = self.n, self.n + len(array)
        self.out.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path) if self.fs else os.replace(self.tmp, self.path)
