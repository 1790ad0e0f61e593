"""Reading and writing byte ranges of files in the shared folder, from inside tasks."""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file name (file:, hdfs:, s3:, gs: or a plain local path)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def create(folder: str, name: str):
    """(name, stream) of a new file that no other attempt of the task writes; only names that reach a manifest count."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}"
    return own, system.open_output_stream(f"{path}/{own}")


class Reader:
    """Open files of a folder for range reads, the most recently used ones only."""

    def __init__(self, folder: str, most: int = 32) -> None:
        self.system, self.path = place(folder)
        self.most, self.open = most, OrderedDict()

    def file(self, name: str):
        if name not in self.open:
            self.open[name] = self.system.open_input_file(f"{self.path}/{name}")
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(name)
        return self.open[name]

    def size(self, name: str) -> int:
        return self.file(name).size()

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self.file(name).read_at(length, offset)
