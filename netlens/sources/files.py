"""Database files: opened once in a process, mapped into memory where they are local."""

from __future__ import annotations

import atexit
import contextlib
import mmap
import os
import re
import shutil
import tempfile
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from netlens.codec import Database
from netlens.kinds import InvalidDatabaseError

_OPEN: OrderedDict[tuple, Database] = OrderedDict()
#: How many databases a process keeps open, and of how many bytes of trees, if there is more than one.
_KEEP, _KEEP_BYTES = 8, 1 << 26
_OWN: list[str] = []


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def open_database(path: str, mapped: bool = True) -> Database:
    """The database at a path or URI; kept by path, change time and size, the last few of them. mapped: into memory, if
    the file is local and its file system can; else its bytes are read."""
    local = _local(path)
    if local:
        stat = os.stat(local)
        key = (local, stat.st_mtime_ns, stat.st_size, mapped)
    else:
        from pyarrow.fs import FileSystem

        fs, name = FileSystem.from_uri(path)
        info = fs.get_file_info(name)
        key = (path, info.mtime_ns, info.size)
    if key not in _OPEN:
        if not key[2]:
            raise InvalidDatabaseError("file is empty")
        if local:
            with open(local, "rb") as f:
                try:
                    if not mapped:
                        raise ValueError
                    data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
                except (OSError, ValueError):  # no mapping on this file system
                    data = f.read()
        else:
            with fs.open_input_stream(name) as f:
                data = f.read()
        _OPEN[key] = Database(data)
    _OPEN.move_to_end(key)
    while len(_OPEN) > _KEEP or len(_OPEN) > 1 and sum(d.tree_bytes for d in _OPEN.values()) > _KEEP_BYTES:
        _OPEN.popitem(last=False)
    return _OPEN[key]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its
    own, which goes with the process; on a cluster that is an error, as executors would each write to their own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="netlens-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def _forget(uri: str) -> None:
    """Delete a published database, if it is still there, when the process ends."""
    from pyarrow.fs import FileSystem

    with contextlib.suppress(OSError):
        fs, name = FileSystem.from_uri(uri)
        fs.delete_file(name)


def place(spark: SparkSession, name: str = "db") -> str:
    """A new URI for a database where all executors can read it; it is deleted when this process ends."""
    from pyarrow.fs import FileSystem

    folder = shared_folder(spark)
    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    out = f"{folder}/netlens-{name}-{uuid.uuid4().hex}.netdb"
    atexit.register(_forget, out)
    return out


def publish(spark: SparkSession, data: bytes, name: str = "db") -> str:
    """The URI of database bytes put where all executors can read them."""
    from pyarrow.fs import FileSystem

    out = place(spark, name)
    fs, path = FileSystem.from_uri(out)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """The table as a checkpoint in the shared folder, which Spark's cleaner deletes when nothing refers to it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder by Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
