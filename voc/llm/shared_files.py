"""Binary files in the folder that driver and executors share, on any file system that pyarrow can open."""

from __future__ import annotations

import numpy as np
import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri.split("://", 1)[1]
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def write(uri: str, data: bytes) -> None:
    """One new file. Names are unique per attempt and only named in the rows of attempts that succeed."""
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


class Reader:
    """Parts of one file."""

    def __init__(self, uri: str):
        system, path = locate(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, size: int) -> bytes:
        return self.file.read_at(size, start)

    def close(self) -> None:
        self.file.close()


def mapped(uri: str, dtype: str, start: int, count: int) -> np.ndarray:
    """``count`` numbers of a file: memory-mapped where the shared folder is mounted, otherwise read."""
    if not count:
        return np.zeros(0, dtype)
    system, path = locate(uri)
    if isinstance(system, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", start, (count,))
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read_at(count * np.dtype(dtype).itemsize, start), dtype)
