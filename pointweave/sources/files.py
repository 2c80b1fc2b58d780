"""Single files in any file system: a plain path is a local one, a URI names its system."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs


def system_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri("file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
    return pyarrow.fs.LocalFileSystem(), path


def open_input(path: str):
    """A seekable binary file; lines are read through a buffer."""
    system, place = system_of(path)
    return io.BufferedReader(system.open_input_file(place))


def size_of(path: str) -> int:
    system, place = system_of(path)
    info = system.get_file_info(place)
    if info.type != pyarrow.fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


@contextmanager
def staged_output(path: str) -> Iterator[io.BufferedWriter]:
    """A binary file that is at ``path`` once it is whole; of a failed write nothing stays."""
    system, place = system_of(path)
    pending = f"{place}.{uuid.uuid4().hex}.partial"
    try:
        with io.BufferedWriter(system.open_output_stream(pending)) as f:
            yield f
        system.move(pending, place)
    except BaseException:
        if system.get_file_info(pending).type != pyarrow.fs.FileType.NotFound:
            system.delete_file(pending)
        raise


def make_folder(path: str) -> None:
    system, place = system_of(path)
    system.create_dir(place, recursive=True)
