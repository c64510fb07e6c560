"""Binary files in the shared folder, written by tasks and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that a folder or file lies in (local, HDFS, S3, GCS) and its path there."""
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes) -> None:
    """Write beside and then rename: a reader sees a whole file or none, and a task that runs again writes it anew."""
    system, path = store(uri)
    parent, _, name = path.rpartition("/")
    system.create_dir(parent, recursive=True)
    beside = f"{parent}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as out:
        out.write(data)
    system.move(beside, path)


def read_whole(uri: str) -> bytes:
    system, path = store(uri)
    with system.open_input_stream(path) as f:
        return f.read()
