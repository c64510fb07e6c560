"""Small files and folders on any file system that pyarrow reaches by URI, and cuts of lineage in the shared folder.

Used on the driver for pointers, run records and the removal of old versions;
tables themselves are written and read by Spark.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from io import BytesIO
from typing import BinaryIO

from pyarrow import fs
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, S3, GCS) and the path there."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def joined(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def exists(uri: str) -> bool:
    system, path = located(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def read_text(uri: str) -> str:
    system, path = located(uri)
    with system.open_input_stream(path) as f:
        return f.read().decode("utf-8")


def write_whole(uri: str, source: BinaryIO) -> None:
    """Copy a stream beside the file and rename: a reader sees the old file or the new one."""
    system, path = located(uri)
    parent, _, name = path.rpartition("/")
    system.create_dir(parent, recursive=True)
    beside = f"{parent}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as out:
        while part := source.read(1 << 20):
            out.write(part)
    system.move(beside, path)


def write_text(uri: str, text: str) -> None:
    write_whole(uri, BytesIO(text.encode("utf-8")))


def names(uri: str) -> list[str]:
    """Names of files and folders right below a folder; none if it does not exist."""
    system, path = located(uri)
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def move(uri: str, to: str) -> None:
    """Rename a file or folder within a file system; the new parent is made if it lacks."""
    (system, path), (_, target) = located(uri), located(to)
    system.create_dir(target.rpartition("/")[0], recursive=True)
    system.move(path, target)


def remove(uri: str) -> None:
    """Remove a file or a folder with all below it."""
    system, path = located(uri)
    kind = system.get_file_info(path).type
    if kind == fs.FileType.Directory:
        system.delete_dir(path)
    elif kind == fs.FileType.File:
        system.delete_file(path)


def size(uri: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    system, path = located(uri)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sum(x.size or 0 for x in found if x.type == fs.FileType.File)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors all see; a local default only in local mode."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` into the shared folder: what follows reads it instead of computing it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def side_by_side(*works: Callable[[], object]) -> list:
    """Run Spark work that does not wait for each other from threads; what they return, or the first error."""
    with ThreadPoolExecutor(max_workers=len(works)) as threads:
        session = SparkSession.getActiveSession()
        return [f.result() for f in [threads.submit(inheritable_thread_target(session)(w) if session else w) for w in works]]
