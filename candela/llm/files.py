"""Binary files that tasks write to the shared folder and read back, by any file system that Arrow knows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import TaskContext


def _at(uri: str):
    """The file system of a file's folder, which is looked up once, and the file's path in it."""
    folder, _, name = uri.rpartition("/")
    system, path = _folder(folder)
    return system, f"{path.rstrip('/')}/{name}"


@functools.cache
def _folder(uri: str):
    from pyarrow import fs

    # Hadoop's names of stores that Arrow knows by others
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{rest}" if rest else uri)


@contextmanager
def created(folder: str, kind: str) -> Iterator[tuple[str, object]]:
    """A new file of this task's attempt and its URI. A retried task writes another; only files that the kept attempts
    name are ever read."""
    context = TaskContext.get()
    name = f"{folder}/{kind}-{context.partitionId() if context else 0:06d}-{uuid.uuid4().hex}"
    system, path = _at(name)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        yield name, out


def read(uri: str, start: int, length: int) -> bytes:
    """Bytes of a file from start on."""
    system, path = _at(uri)
    with system.open_input_file(path) as source:
        source.seek(start)
        return source.read(length)
