"""Binary files of tasks in the shared folder, by its own URI scheme."""

from __future__ import annotations

import uuid


def open_fs(uri: str):
    """(file system, path) of a folder or file URI; a bare path is local."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under another name, then move: readers never see half a file, and a task that
    runs again replaces the file by the same content."""
    system, path = open_fs(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def read_range(uri: str, start: int, length: int) -> bytes:
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)
